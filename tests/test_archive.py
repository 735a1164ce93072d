"""Blocked gzip: framing, policies, ranges, damage, the data source, and index files."""

import gzip
import io
import os
import random

import pytest

from spanframe.functions.config import PRESETS, FormatError
from spanframe.functions.regions import RegionError, parse_region
from spanframe.operators import native
from spanframe.sources import archive
from spanframe.sources.bgzf import EOF_BLOCK, BlockError, Gzi, cut, decode, deflate, encode, inflate, manifest, read_range
from spanframe.sources.tabix_codec import Index, Reference, candidate_chunks, dump, load

TEXT = b"".join(b"line %d of a text that goes on\n" % k for k in range(12000))
NOISE = random.Random(3).randbytes(150_000)


@pytest.mark.parametrize("data", [b"", b"x", TEXT, NOISE, b"a" * 200_000])
@pytest.mark.parametrize("level", [0, 1, 9])
@pytest.mark.parametrize("text", [True, False])
def test_round_trip(data, level, text):
    packed = encode(data, level, text)
    assert decode(io.BytesIO(packed)) == data and packed.endswith(EOF_BLOCK)
    assert gzip.decompress(packed) == data
    blocks = manifest(io.BytesIO(packed))
    assert sum(b.usize for b in blocks) == len(data) and all(b.usize <= 65239 and b.csize <= 65536 for b in blocks)


def test_text_blocks_end_in_lines():
    parts = list(cut(TEXT, text=True))
    assert len(parts) > 3 and all(p.endswith(b"\n") for p in parts)
    assert b"".join(parts) == TEXT
    assert all(len(p) == 65239 for p in list(cut(TEXT, text=False))[:-1])
    assert list(cut(b"a" * 70_000)) == [b"a" * 65239, b"a" * (70_000 - 65239)]


def test_level_is_checked():
    with pytest.raises(ValueError):
        deflate(b"x", 10)


DAMAGE = {
    "no end": lambda p: p[: -len(EOF_BLOCK)],
    "two ends": lambda p: p + EOF_BLOCK,
    "cut off": lambda p: p[:-40],
    "data after the end": lambda p: p + p,
    "wrong checksum": lambda p: p[:-len(EOF_BLOCK) - 8] + bytes([p[-len(EOF_BLOCK) - 8] ^ 1]) + p[-len(EOF_BLOCK) - 7 :],
    "wrong length": lambda p: p[:-len(EOF_BLOCK) - 4] + b"\1\0\1\0" + p[-len(EOF_BLOCK) :],
    "no size field": lambda p: p[:12] + b"XX" + p[14:],
    "no magic": lambda p: b"PK" + p[2:],
    "an empty block inside": lambda p: EOF_BLOCK + p,
    "plain gzip": lambda p: gzip.compress(b"x"),
    "nothing": lambda p: b"",
}


@pytest.mark.parametrize("name", DAMAGE)
def test_damage(name):
    with pytest.raises(BlockError):
        decode(io.BytesIO(DAMAGE[name](encode(TEXT[:70_000]))))


def test_reference_policy():
    p = encode(TEXT)
    inner = EOF_BLOCK + p + p
    assert decode(io.BytesIO(inner), "reference") == TEXT * 2
    for bad in (DAMAGE["no end"](p), b""):
        with pytest.raises(BlockError):
            decode(io.BytesIO(bad), "reference")


def test_oversized_block():
    with pytest.raises(BlockError):
        inflate(deflate(b"a" * 65_537))


def test_ranges():
    packed = encode(TEXT)
    gzi = Gzi.of(manifest(io.BytesIO(packed)))
    assert Gzi.parse(gzi.to_bytes()).entries == gzi.entries and len(gzi.entries) > 3
    for offset, size in ((0, 10), (65_000, 1000), (100_000, 150_000), (len(TEXT) - 5, 5), (len(TEXT) - 5, 50), (0, 0), (1234, None)):
        assert read_range(io.BytesIO(packed), gzi, offset, size) == TEXT[offset:][: len(TEXT) if size is None else size]
    cut_off = packed[: -len(EOF_BLOCK)]
    assert read_range(io.BytesIO(cut_off), gzi, 5, 10) == TEXT[5:15]
    with pytest.raises(BlockError):
        read_range(io.BytesIO(cut_off), gzi, 5, None)
    with pytest.raises(BlockError):
        read_range(io.BytesIO(packed), gzi, len(TEXT) + 70_000, 1)


@pytest.mark.parametrize("entries", [[(5, 0)], [(5, 9), (5, 12)], [(9, 9), (5, 12)], [(1 << 48, 5)], [(70_000, 5)], [(5, 70_000)]])
def test_bad_index(entries):
    with pytest.raises(BlockError):
        Gzi.parse(Gzi(entries).to_bytes())
    with pytest.raises(BlockError):
        Gzi.parse(Gzi([]).to_bytes() + b"\0")


def test_lines_source(spark, tmp_path):
    lines = [b"short", b"", b"x" * 150_000, "\xe9".encode("latin-1"), b"cr\r"] + [b"row %d" % k for k in range(30_000)]
    path = str(tmp_path / "a.gz")
    with open(path, "wb") as f:
        f.write(encode(b"\n".join(lines), text=False))
    for per_task in (1, 2, 1000):
        got = archive.bgzf_lines(spark, path, blocks_per_task=per_task).orderBy("record_id").collect()
        assert [r.raw.encode("latin-1") for r in got] == lines
        assert [r.line_no for r in got] == list(range(1, len(lines) + 1))
    blocks = archive.blocks(spark, path)
    assert blocks.agg({"usize": "sum"}).first()[0] == len(b"\n".join(lines))
    met = archive.range_of(blocks, 70_000, 100).collect()
    assert [(r.block_no, r.skip, r["take"]) for r in met] == [(1, 70_000 - 65_239, 100)]
    whole = archive.inflated(spark, path).orderBy("block_no").collect()
    assert b"".join(r.data for r in whole) == b"\n".join(lines)


def test_parallel_writer(spark, tmp_path):
    path = str(tmp_path / "w.gz")
    told = archive.write_bgzf(spark, TEXT, path)
    with open(path, "rb") as f:
        packed = f.read()
    assert packed == encode(TEXT) and told["bytes_in"] == len(TEXT) and told["bytes_out"] == len(packed)
    with open(path + ".gzi", "rb") as f:
        assert Gzi.parse(f.read()).entries == Gzi.of(manifest(io.BytesIO(packed))).entries
    assert archive.verify(path)["bytes_out"] == len(TEXT)
    with pytest.raises(FileExistsError):
        archive.write_bgzf(spark, TEXT, path)
    assert sorted(os.listdir(tmp_path)) == ["w.gz", "w.gz.gzi"]


@pytest.mark.parametrize("kind", ["tbi", "csi"])
def test_index_codec(kind):
    refs = [Reference("chr1", {4681: [(0, 500)], 4683: [(500, 900 << 16)]}, [0, 0, 500], 0, 900 << 16, 3), Reference("chr2")]
    again = load(dump(Index(kind, PRESETS["vcf"], refs)))
    assert (again.kind, again.config, [r.name for r in again.references]) == (kind, PRESETS["vcf"], ["chr1", "chr2"])
    assert again.references[0].bins == refs[0].bins and again.references[0].count == 3
    assert candidate_chunks(again, "chr1", 1, 16_384) == [(0, 500)] and candidate_chunks(again, "chr2", 1, None) == []
    assert candidate_chunks(again, "chr1", 1 << 30, None) == []
    for bad in (b"", dump(Index(kind, PRESETS["vcf"], refs))[:-30], encode(b"TBI\1"), encode(b"XXXX")):
        with pytest.raises(FormatError):
            load(bad)
    with pytest.raises(FormatError):
        load(dump(Index(kind, PRESETS["vcf"], [Reference("a"), Reference("a")])))


@pytest.fixture(scope="module")
def vcf(tmp_path_factory):
    r = random.Random(8)
    rows, text = [], ["##fileformat=VCFv4.2", "##contig=<ID=chr1,length=900000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    for ref in ("chr2", "chr1"):
        for pos in sorted(r.randint(1, 800_000) for _ in range(4000)):
            end = pos + r.choice((0, 0, 0, 50, 90_000))
            rows.append((ref, pos, end, f"{ref}\t{pos}\t.\tA\tC\t.\t.\tEND={end};X={'y' * r.randint(0, 60)}"))
            text.append(rows[-1][3])
    path = str(tmp_path_factory.mktemp("vcf") / "a.vcf.gz")
    with open(path, "wb") as f:
        f.write(encode("\n".join(text).encode() + b"\n"))
    return path, rows


@pytest.mark.parametrize("csi", [False, True])
def test_build_and_query(spark, vcf, csi, tmp_path):
    path, rows = vcf
    index = str(tmp_path / "i")
    told = native.build(spark, path, csi=csi, output=index)
    assert (told["records"], told["references"]) == (8000, 2)
    assert native.references(path, index) == ["chr2", "chr1"]
    asked = [parse_region(x) for x in ("chr1:100000-120000", "chr2:5-", "chr1:110000-130000", "chr2:700000")]
    hit = lambda row, q: row[0] == q.ref and row[2] >= q.start and (q.end is None or row[1] <= q.end)
    assert [r.raw for r in native.query_file(spark, path, asked, index=index).collect()] == [x[3] for q in asked for x in rows if hit(x, q)]
    unique = [r.raw for r in native.query_file(spark, path, asked, index=index, unique=True).collect()]
    assert sorted(unique) == sorted(x[3] for x in rows if any(hit(x, q) for q in asked))
    targets = asked[:1]
    assert [r.raw for r in native.query_file(spark, path, targets=targets, index=index).collect()] == [x[3] for x in rows if hit(x, targets[0])]
    with pytest.raises(RegionError):
        native.query_file(spark, path, [parse_region("chr9")], index=index)
    assert len(native.header(path, PRESETS["vcf"])) == 3
    with pytest.raises(FileExistsError):
        native.build(spark, path, csi=csi, output=index)
    os.utime(path, (os.path.getmtime(index) + 10,) * 2)
    with pytest.raises(FormatError):
        native.find_index(path, index)
    os.utime(path, (os.path.getmtime(index) - 10,) * 2)


def test_unsorted_leaves_no_index(spark, tmp_path):
    path = str(tmp_path / "u.bed.gz")
    with open(path, "wb") as f:
        f.write(encode(b"a\t5\t9\na\t1\t3\n"))
    with pytest.raises(FormatError):
        native.build(spark, path)
    assert os.listdir(tmp_path) == ["u.bed.gz"]


def test_empty_input(spark, tmp_path):
    path = str(tmp_path / "e.bed.gz")
    with open(path, "wb") as f:
        f.write(encode(b"#only a header\n"))
    assert native.build(spark, path)["records"] == 0 and native.references(path) == []


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_planning_passes_over_bodies():
    packed = Counting(encode(NOISE * 40, 0, text=False))
    blocks = manifest(packed)
    assert len(blocks) > 80 and packed.taken < 30 * len(blocks) + 100
    with open(os.devnull, "rb"):
        assert [b.coffset for b in blocks] == [b.coffset for b in manifest(io.BytesIO(packed.getvalue()), "reference")]


def test_planning_by_the_block_index(spark, tmp_path):
    path = str(tmp_path / "w.gz")
    archive.write_bgzf(spark, TEXT, path)
    by_index = archive.block_starts(path)
    os.remove(path + ".gzi")
    assert archive.block_starts(path) == by_index


@pytest.mark.parametrize("text", [True, False])
def test_lines_of_any_runs(spark, tmp_path, text):
    """However blocks are dealt out, each line comes once, with the place where the next one begins."""
    path = str(tmp_path / "l.gz")
    data = TEXT + b"x" * 150_000 + b"\n\n" + TEXT[:-1]
    with open(path, "wb") as f:
        f.write(encode(data, 1, text))
    want = data.decode().split("\n")
    for per_task in (1, 2, 1000):
        rows = archive.bgzf_lines(spark, path, blocks_per_task=per_task).orderBy("record_id").collect()
        assert [r.raw for r in rows] == want and [r.line_no for r in rows] == list(range(1, len(want) + 1))
        with open(path, "rb") as f:
            end = manifest(f)[-1]
        assert [r.next_id for r in rows] == [r.record_id for r in rows[1:]] + [end.coffset + end.csize << 16]


def test_pieces_of_chunks(spark, vcf, monkeypatch):
    path, rows = vcf
    with open(path, "rb") as f:
        blocks = manifest(f)
    first = sum(map(len, ("##fileformat=VCFv4.2", "##contig=<ID=chr1,length=900000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"))) + 3
    whole = [(first, blocks[-1].coffset + blocks[-1].csize << 16)]
    for most in (1, 20_000, native.TASK_BYTES):
        monkeypatch.setattr(native, "TASK_BYTES", most)
        found = native.pieces(path, whole, most)
        assert [x[1] for x in found[1:]] == [x[2] for x in found[:-1]] and (found[0][1], found[-1][2]) == whole[0]
        assert len(found) >= (len(blocks) if most == 1 else 1)
    few = native.pieces(path, [(k << 16, (k << 16) + 9) for k in range(0, 1000, 7)], 1 << 22)
    assert len({x[0] for x in few}) < 10
    monkeypatch.setattr(native.pieces, "__defaults__", (1,))
    assert [r.raw for r in native.chunk_lines(spark, path, whole).orderBy("record_id").collect()] == [x[3] for x in rows]


def test_chunks_that_do_not_fit(spark, vcf):
    path, _ = vcf
    with open(path, "rb") as f:
        blocks = manifest(f)
    size = os.path.getsize(path)
    for chunk in ((65535, blocks[1].coffset << 16), (0, 5 << 16 | 3), (0, size + 10 << 16), (blocks[1].coffset << 16, (blocks[1].coffset << 16) + 65535)):
        with pytest.raises(Exception, match="position|member"):
            native.chunk_lines(spark, path, [chunk]).collect()
    with pytest.raises(FormatError):
        native.pieces(path, [(10, 5)])


def test_references_that_the_index_lacks(spark, vcf, tmp_path):
    path, _ = vcf
    index = str(tmp_path / "i")
    native.build(spark, path, output=index)
    found = native.find_index(path, index)
    found.references = [r for r in found.references if r.name == "chr1"]
    with open(index, "wb") as f:
        f.write(dump(found))
    with pytest.raises(Exception, match="not in the index"):
        native.query_file(spark, path, targets=[parse_region("chr1:1-100")], index=index).collect()
