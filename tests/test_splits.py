"""Archives in splits: found, written and read as the sequential code does; as-of joins against plain Python."""

import io
import random
import struct
import zlib
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from spanframe.operators.asof import asof_join
from spanframe.sources import splits
from spanframe.sources.bgzf import EOF_BLOCK, BlockError, Gzi, deflate, encode, manifest, read_range
from spanframe.sources.store import Joined, listed, written

LEAST = splits.LEAST


def put(tmp_path, data, name="a.gz"):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def nested(r):
    """Stored members whose content is an archive of its own, cut anywhere: false members, some of which reach true ones."""
    inner = b"".join(deflate(bytes(r.choices(b"ab\n", k=r.randint(1, 4000))), r.choice([0, 6])) for _ in range(60)) + EOF_BLOCK
    out, at = b"", 0
    while at < len(inner):
        n = r.randint(1, 60000)
        out += deflate(inner[at : at + n], 0)
        at += n
    return out


def bridge():
    """A false member in a stored one that ends exactly where the true one ends."""
    head = struct.pack("<4BI2BH2sH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2)
    content = b"x" * 5000 + head + struct.pack("<H", 4999 + 18 + 8 - 1 + 0) + b"y" * 4999
    return deflate(content, 0)


@pytest.mark.parametrize("seed", range(4))
def test_blocks_are_found(spark, tmp_path, seed):
    r = random.Random(seed)
    data = b"".join(r.choice([lambda: nested(r), bridge, lambda: deflate(r.randbytes(r.randint(1, 60000)), 6), lambda: b"".join(deflate(b"z" * k) for k in range(1, 400))])() for _ in range(12)) + EOF_BLOCK
    path = put(tmp_path, data)
    want = [(b.number, b.coffset, b.csize, b.uoffset, b.usize) for b in manifest(io.BytesIO(data))]
    for split in (LEAST, LEAST + 4097, 1 << 26):
        assert rows(splits.manifest(spark, path, split=split)) == want


def test_what_is_no_archive(spark, tmp_path):
    whole = b"".join(deflate(random.Random(k).randbytes(50000)) for k in range(6))
    bad = {
        "marker": whole, "follows": EOF_BLOCK + whole, "twice": whole + EOF_BLOCK * 2, "cut": whole[:-9], "junk": whole[:100000] + bytes(200) + whole[100200:] + EOF_BLOCK,
        "tail": whole + EOF_BLOCK + b"x", "plain": b"text" * 50000, "nothing": b"", "long": whole + struct.pack("<4BI2BH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, 60) + bytes(31) + struct.pack("<I", 65537) + EOF_BLOCK,
    }
    for name, data in bad.items():
        path = put(tmp_path, data, name)
        with pytest.raises(BlockError):
            splits.manifest(spark, path, split=LEAST).collect()
    for data in (whole + EOF_BLOCK * 2, EOF_BLOCK + whole + EOF_BLOCK, EOF_BLOCK):
        want = [(b.number, b.coffset, b.csize, b.uoffset, b.usize) for b in manifest(io.BytesIO(data), "reference")]
        assert rows(splits.manifest(spark, put(tmp_path, data), "reference", LEAST)) == want


def content(kind, r):
    if kind == "lines":
        return b"".join(bytes(r.choices(b"abc ", k=r.randint(0, 300))) + b"\n" for _ in range(2500))
    if kind == "long":
        return b"".join(bytes([97 + k]) * r.choice([10, 65238, 65239, 65240, 200000]) + b"\n" for k in range(8))
    return {"none": b"q" * 250_000, "short": b"\n" * 200_000, "tail": b"x\n" * 70_000 + b"y" * 65238, "empty": b"", "exact": b"x" * 65238 + b"\n"}[kind]


@pytest.mark.parametrize("kind", ["lines", "long", "none", "short", "tail", "empty", "exact"])
def test_written_as_by_one_writer(spark, tmp_path, kind):
    data = content(kind, random.Random(1))
    cut = len(data) // 3  # the source may be several files
    source = Joined([(put(tmp_path, data[:cut], "one"), cut), (put(tmp_path, data[cut:], "two"), len(data) - cut)])
    for text in (True, False):
        out = str(tmp_path / f"out-{text}.gz")
        told = splits.write_archive(spark, source, out, level=1, text=text, split=LEAST + 11)
        want = encode(data, 1, text)
        assert open(out, "rb").read() == want
        found = manifest(io.BytesIO(want))
        assert open(f"{out}.gzi", "rb").read() == Gzi.of(found).to_bytes()
        assert told == {"bytes_in": len(data), "bytes_out": len(want), "blocks": len(found)}
        with pytest.raises(FileExistsError):
            splits.write_archive(spark, source, out)
    assert not list(tmp_path.glob("*.staged"))


def test_parts_join_to_the_archive(spark, tmp_path):
    data = content("lines", random.Random(2))
    splits.write_parts(spark, Joined.of(put(tmp_path, data)), str(tmp_path / "parts"), split=LEAST)
    assert b"".join(open(p, "rb").read() for p, _ in listed(str(tmp_path / "parts"))) + EOF_BLOCK == encode(data)


def test_ranges(spark, tmp_path):
    r = random.Random(3)
    data = r.randbytes(700_000)
    whole = b"".join(deflate(data[at : at + 30_000], 1) for at in range(0, len(data), 30_000)) + EOF_BLOCK
    path = put(tmp_path, whole)
    asked = [(k, a, n) for k, (a, n) in enumerate([(0, 10), (29_999, 2), (30_000, 30_000), (0, None), (5, 0), (699_999, 100), (700_000, 5), *((r.randrange(700_000), r.randrange(90_000)) for _ in range(30))])]
    blocks = splits.manifest(spark, path, split=LEAST)
    got = {}
    for row in sorted(splits.read_ranges(spark, path, spark.createDataFrame(asked, "id long, offset long, size long"), blocks).collect()):
        got[row.id] = got.get(row.id, b"") + bytes(row.data)
    assert got == {k: x for k, a, n in asked if (x := data[a : None if n is None else a + n])}
    gzi = Gzi.of(manifest(io.BytesIO(whole)))
    assert got[7] == read_range(io.BytesIO(whole), gzi, asked[7][1], asked[7][2])


def test_lines_in_order(spark, tmp_path):
    lines = [(k, f"line {k}") for k in range(5000)]
    random.Random(4).shuffle(lines)
    found = splits.write_lines(spark.createDataFrame(lines, "k long, raw string").repartition(3), [F.col("k")], str(tmp_path / "out"))
    assert found.read(found.size) == "".join(f"line {k}\n" for k in range(5000)).encode()
    with pytest.raises(FileExistsError):
        splits.write_lines(spark.createDataFrame(lines, "k long, raw string"), [F.col("k")], str(tmp_path / "out"))
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_several_files_as_one(tmp_path):
    written(f"file://{tmp_path}/b", [b"345", b"6"])
    joined = Joined([(put(tmp_path, b"012", "a"), 3), (put(tmp_path, b"", "e"), 0), (f"file://{tmp_path}/b", 4)])
    assert joined.size == 7
    for at in range(8):
        for n in range(9):
            joined.seek(at)
            assert joined.read(n) == b"0123456"[at : at + n]


def test_asof(spark):
    r = random.Random(6)
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(k, r.choice(keys), r.choice([None, *range(300)])) for k in range(1500)]
    right = [(r.choice(keys), r.choice([None, *range(300)]), k) for k in range(120)]
    got = asof_join(spark.createDataFrame(left, "id long, key string, at long").repartition(5), spark.createDataFrame(right, "key string, at long, found long"), "at", ["key"])
    held = {}
    for key, at, found in sorted((x for x in right if None not in x[:2]), key=lambda x: x[1:]):
        held.setdefault(key, []).append((at, found))

    def last(key, at):
        own = held.get(key, [])
        k = 0 if at is None else bisect_right(own, (at, 1 << 60))
        return own[k - 1][1] if k else None

    assert rows(got.select("id", F.coalesce("found", F.lit(-1)))) == sorted((i, -1 if (x := last(key, at)) is None else x) for i, key, at in left)
    assert got.columns == ["id", "key", "at", "found"]
    empty = spark.createDataFrame([], "at long, found long")
    assert asof_join(spark.createDataFrame([(1, 5)], "id long, at long"), empty, "at").collect()[0].found is None
    assert asof_join(empty, spark.createDataFrame([(5, 1)], "at long, other long"), "at").collect() == []


def test_command_line(spark, tmp_path, monkeypatch):
    from spanframe import cli

    data = content("lines", random.Random(9))
    source, out, index = put(tmp_path, data, "plain"), str(tmp_path / "out.gz"), str(tmp_path / "named.gzi")
    assert cli.main(["bgzip", source, "-o", out, "--index-output", index, "--compress-level", "1"]) == 0
    assert open(out, "rb").read() == encode(data, 1) and not (tmp_path / "out.gz.gzi").exists()
    assert open(index, "rb").read() == Gzi.of(manifest(io.BytesIO(encode(data, 1)))).to_bytes()
    back = str(tmp_path / "back")
    assert cli.main(["bgzip", "-d", out, "-o", back]) == 0 and open(back, "rb").read() == data
    for wrong in (["-d", out, "-o", back, "-f", "--index-output", index], ["-d", out, "-l", "1"], ["-t", out, "--binary"], ["-d", out, "--index-input", index], [source, "-o", out, "-f", "--index-output", out]):
        assert cli.main(["bgzip", *wrong]) == 1
    splits.inflate_file(spark, out, back, split=LEAST)
    assert open(back, "rb").read() == data


def test_many_requests_of_a_file(spark, tmp_path, monkeypatch):
    """Looked up by the join as one by one."""
    from spanframe.functions.regions import parse_region
    from spanframe.operators import native

    rows = "".join(f"chr{c}\t{k * 700}\t{k * 700 + 900}\n" for c in (1, 2) for k in range(3000))
    path = put(tmp_path, encode(rows.encode(), 1), "a.bed.gz")
    native.build(spark, path)
    asked = [parse_region(f"chr{1 + k % 2}:{1 + k * 997 % 2_000_000}-{k * 997 % 2_000_000 + 1 + k % 3000}") for k in range(40)]
    held = native.find_index(path)
    want = native.candidates(spark, held, asked)
    lines = sorted(r.raw for r in native.query_file(spark, path, asked).collect())
    monkeypatch.setattr(native, "ONE_BY_ONE", 10)
    assert native.candidates(spark, held, asked) == want
    assert sorted(r.raw for r in native.query_file(spark, path, asked).collect()) == lines
