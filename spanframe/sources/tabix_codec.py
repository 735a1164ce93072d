"""Import and export of TBI and CSI index files. They are as small as a file's bins, so this runs on the driver."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

from spanframe.functions import coords
from spanframe.functions.config import Config, FormatError, from_header, to_header
from spanframe.sources.bgzf import BlockError, decode, encode

Chunk = tuple[int, int]


@dataclass
class Reference:
    name: str
    bins: dict[int, list[Chunk]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)
    first: int = 0
    last: int = 0
    count: int = 0


@dataclass
class Index:
    kind: str
    config: Config
    references: list[Reference]
    min_shift: int = coords.TBI_SHIFT
    depth: int = coords.TBI_DEPTH


def _meta_bin(depth: int) -> int:
    """The number, beyond all bins, under which a reference's extent and count are kept."""
    return coords.level_offset(depth + 1) + 1


def loffset(reference: Reference, bin_: int, depth: int) -> int:
    """The first record that reaches a bin's lowest window."""
    level = max(k for k in range(depth + 1) if bin_ >= coords.level_offset(k))
    window = (bin_ - coords.level_offset(level)) << 3 * (depth - level)
    return reference.linear[window] if window < len(reference.linear) else reference.linear[-1] if reference.linear else 0


def compact(reference: Reference, depth: int) -> Reference:
    """From the leaves up, a bin that lies within one 64 KiB of file joins its parent if there is one; then chunks in a shared block merge."""
    bins = {b: list(c) for b, c in reference.bins.items()}
    for level in range(depth, 0, -1):
        for b in sorted(x for x in bins if coords.level_offset(level) <= x < coords.level_offset(level + 1)):
            chunks, parent = bins[b], (b - 1) >> 3
            if parent in bins and (chunks[-1][1] >> 16) - (chunks[0][0] >> 16) < 65536:
                bins[parent] = sorted(bins[parent] + bins.pop(b))
    for b, chunks in bins.items():
        merged: list[Chunk] = []
        for begin, end in sorted(chunks):
            if merged and begin >> 16 <= merged[-1][1] >> 16:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((begin, end))
        bins[b] = merged
    return Reference(reference.name, bins, reference.linear, reference.first, reference.last, reference.count)


def _names(index: Index) -> bytes:
    return b"".join(r.name.encode("latin-1") + b"\0" for r in index.references)


def _layout(index: Index) -> bytes:
    head, names = to_header(index.config), _names(index)
    return struct.pack("<7i", head["format"], head["sequence"], head["begin"], head["end"], head["comment"], head["skip"], len(names)) + names


def dump(index: Index) -> bytes:
    """The file's bytes, block-compressed."""
    csi = index.kind == "csi"
    out = io.BytesIO()
    if csi:
        layout = _layout(index)
        out.write(b"CSI\1" + struct.pack("<3i", index.min_shift, index.depth, len(layout)) + layout + struct.pack("<i", len(index.references)))
    else:
        out.write(b"TBI\1" + struct.pack("<i", len(index.references)) + _layout(index))
    for reference in (compact(r, index.depth) for r in index.references):
        out.write(struct.pack("<i", len(reference.bins) + bool(reference.bins)))
        for b in sorted(reference.bins):
            chunks = reference.bins[b]
            out.write(struct.pack("<I", b) + (struct.pack("<Q", loffset(reference, b, index.depth)) if csi else b"") + struct.pack("<i", len(chunks)))
            out.write(b"".join(struct.pack("<2Q", *c) for c in chunks))
        if reference.bins:
            out.write(struct.pack("<I", _meta_bin(index.depth)) + (struct.pack("<Q", 0) if csi else b"") + struct.pack("<i4Q", 2, reference.first, reference.last, reference.count, 0))
        if not csi:
            out.write(struct.pack(f"<i{len(reference.linear)}Q", len(reference.linear), *reference.linear))
    out.write(struct.pack("<Q", 0))
    return encode(out.getvalue(), text=False)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize("<" + form)
        if self.at + size > len(self.data):
            raise FormatError("the index is cut off")
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += size
        return out

    def count(self) -> int:
        (n,) = self.take("i")
        if n < 0:
            raise FormatError("a negative count in the index")
        return n


def _read_layout(r: _Reader) -> tuple[Config, list[str]]:
    keys = ("format", "sequence", "begin", "end", "comment", "skip")
    head = dict(zip(keys, r.take("6i")))
    size = r.count()
    (raw,) = r.take(f"{size}s")
    if raw and not raw.endswith(b"\0"):
        raise FormatError("a name in the index has no end")
    names = [x.decode("latin-1") for x in raw.split(b"\0")[:-1]]
    if len(set(names)) != len(names) or any(not n or any(c in n for c in "\t\n\r") for n in names):
        raise FormatError("names in the index are empty, repeated or broken")
    return from_header(head), names


def load(data: bytes) -> Index:
    """Read either kind, told by its magic; anything after the index is an error."""
    try:
        r = _Reader(decode(io.BytesIO(data)))
    except BlockError as e:
        raise FormatError(f"unreadable index: {e}") from None
    (magic,) = r.take("4s")
    if magic not in (b"TBI\1", b"CSI\1"):
        raise FormatError("neither a TBI nor a CSI index")
    csi = magic[:3] == b"CSI"
    shift, depth = coords.TBI_SHIFT, coords.TBI_DEPTH
    if csi:
        shift, depth = r.take("2i")
        if r.count() == 0:
            raise FormatError("the index has no header")
        config, names = _read_layout(r)
        n = r.count()
    else:
        n = r.count()
        config, names = _read_layout(r)
    if n != len(names):
        raise FormatError("names and references of the index differ in number")
    references = []
    for name in names:
        reference = Reference(name)
        offsets = {}
        for _ in range(r.count()):
            (b,) = r.take("I")
            if csi:
                (offsets[b],) = r.take("Q")
            flat = r.take(f"{2 * r.count()}Q")
            chunks = list(zip(flat[::2], flat[1::2]))
            if b == _meta_bin(depth):
                if len(chunks) != 2:
                    raise FormatError("broken metadata in the index")
                (reference.first, reference.last), (reference.count, _) = chunks
            else:
                reference.bins[b] = chunks
        if not csi:
            reference.linear = list(r.take(f"{r.count()}Q"))
        references.append(reference)
    if len(r.data) - r.at not in (0, 8):
        raise FormatError("data follows the index")
    return Index("csi" if csi else "tbi", config, references, shift, depth)


def candidate_chunks(index: Index, name: str, start: int, end: int | None) -> list[Chunk]:
    """Merged chunks that can hold records of ``name`` in [start, end]; beyond the tree there are none."""
    reference = next((r for r in index.references if r.name == name), None)
    return chunks_of(index, reference, start, end) if reference else []


def chunks_of(index: Index, reference: Reference, start: int, end: int | None) -> list[Chunk]:
    most = coords.capacity(index.min_shift, index.depth)
    if start > most:
        return []
    last = min(end or most, most)
    lowest = reference.linear[min((start - 1) >> index.min_shift, len(reference.linear) - 1)] if reference.linear else 0
    found, bins = [], reference.bins
    for level in range(index.depth + 1):
        shift = index.min_shift + 3 * (index.depth - level)
        low, high = coords.level_offset(level) + ((start - 1) >> shift), coords.level_offset(level) + ((last - 1) >> shift)
        # few bins are looked up by number, many are sought among those there are
        asked = range(low, high + 1) if high - low < len(bins) else (b for b in bins if low <= b <= high)
        found += [c for b in asked if b in bins for c in bins[b] if c[1] > lowest]
    return merged_chunks(found)


def merged_chunks(chunks: Iterable[Chunk]) -> list[Chunk]:
    """Sorted chunks of which none meet."""
    merged: list[Chunk] = []
    for begin, stop in sorted(chunks):
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((begin, stop))
    return merged
