"""Blocked gzip: framing, inflating with checks, cutting and writing, block offsets.

A file is a run of gzip members of at most 64 KiB, each with its size in an extra
field, and ends in one empty member. Two policies read it: ``strict`` wants exactly
that one empty member at the end; ``reference`` takes empty members anywhere and
wants the last member to be empty.
"""

from __future__ import annotations

import io
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

#: The empty member that ends a file (a fixed value of the format).
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST_INFLATED = 65536
#: Input bytes in a written block: even stored, its member stays under 64 KiB.
PAYLOAD = 65239


class BlockError(ValueError):
    """A file is not blocked gzip, or is damaged."""


@dataclass(frozen=True)
class Block:
    number: int
    coffset: int
    csize: int
    uoffset: int
    usize: int


def header_size(head: bytes) -> tuple[int, int]:
    """(bytes of the header, bytes of the member) from its first bytes; a short ``head`` is an error."""
    if len(head) < 12:
        raise BlockError("a member is cut off in its header")
    if head[:4] != b"\x1f\x8b\x08\x04":
        raise BlockError("not a blocked gzip member")
    extra = struct.unpack_from("<H", head, 10)[0]
    if len(head) < 12 + extra:
        raise BlockError("a member is cut off in its header")
    at, size = 12, None
    while at + 4 <= 12 + extra:
        tag, length = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if tag == b"BC" and length == 2 and at + 6 <= 12 + extra:
            if size is not None:
                raise BlockError("a member gives its size twice")
            size = struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + length
    if at != 12 + extra or size is None:
        raise BlockError("a member lacks its size field")
    if size < 12 + extra + 8:
        raise BlockError("a member is smaller than its header")
    return 12 + extra, size


def inflate(member: bytes) -> bytes:
    """The checked content of a whole member."""
    begin, size = header_size(member)
    if len(member) != size:
        raise BlockError("a member is cut off")
    crc, length = struct.unpack_from("<II", member, size - 8)
    if length > MOST_INFLATED:
        raise BlockError("a member inflates to more than 64 KiB")
    engine = zlib.decompressobj(-15)
    try:
        data = engine.decompress(member[begin : size - 8], MOST_INFLATED + 1)
    except zlib.error as e:
        raise BlockError(f"damaged member: {e}") from None
    if not engine.eof or engine.unused_data or len(data) != length:
        raise BlockError("a member's length doesn't agree with its content")
    if zlib.crc32(data) != crc:
        raise BlockError("a member's checksum doesn't agree with its content")
    return data


def members(source: BinaryIO, offset: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(compressed offset, whole member) from ``offset`` on; members that begin at ``end`` or later aren't read."""
    source.seek(offset)
    while end is None or offset < end:
        head = source.read(18)
        if not head:
            return
        if len(head) >= 12:
            extra = struct.unpack_from("<H", head, 10)[0]
            if extra > 6:
                head += source.read(12 + extra - len(head))
        _, size = header_size(head)
        member = head + source.read(size - len(head))
        if len(member) != size:
            raise BlockError("the file is cut off")
        yield offset, member
        offset += size


def usize(member: bytes) -> int:
    return struct.unpack_from("<I", member, len(member) - 4)[0]


def checked(found: Iterable[tuple[int, bytes]], policy: str = "strict") -> Iterator[tuple[int, bytes]]:
    """The members that hold data; what the policy forbids raises, at the end too."""
    last, ended = None, False
    for offset, member in found:
        if ended and policy == "strict":
            raise BlockError("data follows the end marker")
        empty = usize(member) == 0
        if empty and policy == "strict":
            if member != EOF_BLOCK:
                raise BlockError("an empty block that is not the end marker")
            ended = True
        last = empty
        if not empty:
            yield offset, member
    if not last:
        raise BlockError("the end marker is missing")


def walk(source: BinaryIO) -> Iterator[tuple[int, int, int]]:
    """(compressed offset, size, content size) of every member: headers and trailers are read, bodies are passed over."""
    offset = 0
    source.seek(0)
    head = _exactly(source, 18)
    while head:
        if len(head) >= 12:
            extra = struct.unpack_from("<H", head, 10)[0]
            if extra > 6:
                source.seek(offset + len(head))
                head += _exactly(source, 12 + extra - len(head))
        _, size = header_size(head)
        source.seek(offset + size - 4)
        tail = _exactly(source, 22)
        if len(tail) < 4:
            raise BlockError("the file is cut off")
        yield offset, size, struct.unpack_from("<I", tail)[0]
        offset, head = offset + size, tail[4:]


def _exactly(source: BinaryIO, n: int) -> bytes:
    """``n`` bytes, fewer at the end only; unbuffered files may give less at a time."""
    out = source.read(n)
    while len(out) < n and (more := source.read(n - len(out))):
        out += more
    return out


def manifest(source: BinaryIO, policy: str = "strict") -> list[Block]:
    """The data blocks in order, from headers and trailers only; what the policy forbids raises."""
    out, uoffset, last, ended = [], 0, False, False
    for offset, size, n in walk(source):
        if ended and policy == "strict":
            raise BlockError("data follows the end marker")
        if n > MOST_INFLATED:
            raise BlockError("a member inflates to more than 64 KiB")
        last = n == 0
        if last and policy == "strict":
            source.seek(offset)
            if _exactly(source, size) != EOF_BLOCK:
                raise BlockError("an empty block that is not the end marker")
            ended = True
        if n:
            out.append(Block(len(out), offset, size, uoffset, n))
            uoffset += n
    if not last:
        raise BlockError("the end marker is missing")
    return out


def decode(source: BinaryIO, policy: str = "strict") -> bytes:
    return b"".join(inflate(m) for _, m in checked(members(source), policy))


def read_range(source: BinaryIO, gzi: Gzi, offset: int, size: int | None = None) -> bytes:
    """``size`` bytes of content from ``offset``. The end marker is only looked for where reading runs to the end."""
    if size == 0:
        return b""
    coffset, skip = gzi.locate(offset)
    found = members(source, coffset)
    found = checked(found) if size is None else found
    out, left = [], size
    for _, member in found:
        data = inflate(member)
        if not data:
            continue
        if skip >= len(data) and skip:
            raise BlockError("the offset lies beyond its block")
        part = data[skip:] if left is None else data[skip : skip + left]
        skip = 0
        out.append(part)
        if left is not None:
            left -= len(part)
            if left == 0:
                break
    return b"".join(out)


def cuts(source: BinaryIO, text: bool = True) -> Iterator[tuple[int, int]]:
    """(offset, size) of the payloads of blocks. A full text block ends after its last line end, if it has one; the rest moves on."""
    at = 0
    while True:
        source.seek(at)
        part = _exactly(source, PAYLOAD)
        if not part:
            return
        size = len(part)
        if text and size == PAYLOAD:
            size = part.rfind(b"\n") + 1 or size
        yield at, size
        at += size


def cut(data: bytes, text: bool = True) -> Iterator[bytes]:
    """The payloads of content in memory."""
    return (data[at : at + size] for at, size in cuts(io.BytesIO(data), text))


def deflate(payload: bytes, level: int = 6) -> bytes:
    """One member; level 0 stores."""
    if not 0 <= level <= 9:
        raise ValueError("compression levels are 0 to 9")
    engine = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = engine.compress(payload) + engine.flush()
    if len(body) + 26 > 65536:
        engine = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = engine.compress(payload) + engine.flush()
    return struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def encode(data: bytes, level: int = 6, text: bool = True) -> bytes:
    return b"".join(deflate(p, level) for p in cut(data, text)) + EOF_BLOCK


class Gzi:
    """Compressed and uncompressed offsets of all blocks but the first."""

    def __init__(self, entries: list[tuple[int, int]]) -> None:
        self.entries = entries

    @classmethod
    def of(cls, blocks: Iterable[Block]) -> Gzi:
        return cls([(b.coffset, b.uoffset) for b in blocks if b.number])

    @classmethod
    def parse(cls, data: bytes, policy: str = "strict") -> Gzi:
        if len(data) < 8:
            raise BlockError("the block index is cut off")
        n = struct.unpack_from("<Q", data)[0]
        if len(data) != 8 + 16 * n:
            raise BlockError("the block index has the wrong size")
        flat = struct.unpack_from(f"<{2 * n}Q", data, 8)
        entries = list(zip(flat[::2], flat[1::2]))
        before = (0, 0)
        for c, u in entries:
            if c <= before[0] or u <= before[1] or c >= 1 << 48 or u - before[1] > MOST_INFLATED or (policy == "strict" and c - before[0] > 65536):
                raise BlockError("the block index is not in order")
            before = (c, u)
        return cls(entries)

    def to_bytes(self) -> bytes:
        return struct.pack(f"<Q{2 * len(self.entries)}Q", len(self.entries), *(x for e in self.entries for x in e))

    def locate(self, offset: int) -> tuple[int, int]:
        """(compressed offset of the block, offset in it) of a content offset."""
        k = bisect_right(self.entries, offset, key=lambda e: e[1]) - 1
        c, u = self.entries[k] if k >= 0 else (0, 0)
        if offset - u >= MOST_INFLATED:
            raise BlockError("the offset lies beyond the index")
        return c, offset - u
