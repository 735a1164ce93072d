"""Sequences from a file whose layout is known, against slices of the sequences themselves."""

import gzip
import hashlib
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spanframe import cli
from spanframe.functions.config import FormatError
from spanframe.functions.regions import Slice, resolve_sequence
from spanframe.operators import sequence
from spanframe.sources.bgzf import EOF_BLOCK, Gzi, decode, deflate, encode, manifest
from spanframe.sources.fasta import fai_text, read_fai, read_fasta
from spanframe.sources.text import text_lines

CYCLE = "acgTNrySKMBDHV-"
#: name, header, length, line, line end, whether the last line has its end
LAYOUT = [("long", "long description", 26_217, 101, "\n", True), ("crlf", "crlf description", 127, 31, "\r\n", True), ("colon", "colon", 137, 67, "\n", True), ("colon:2-7", "colon:2-7", 19, 19, "\n", True), ("MT", "MT", 83, 41, "\n", True), ("last", " last x", 83, 83, "\n", False)]


def bases(n):
    return (CYCLE * (n // 15 + 1))[:n]


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    out, fai = "", ""
    for name, header, n, line, end, ended in LAYOUT:
        out += f">{header}{end}"
        fai += f"{name}\t{n}\t{len(out)}\t{line}\t{line + len(end)}\n"
        seq = bases(n)
        out += "".join(seq[k : k + line] + end for k in range(0, n, line))
        if not ended:
            out = out[: -len(end)]
    path = tmp_path_factory.mktemp("fa") / "a.fa"
    path.write_bytes(out.encode())
    return str(path), fai


def test_index(spark, fasta):
    path, fai = fasta
    lines = read_fasta(spark, path)
    assert fai_text(sequence.build_fai(lines)) == fai
    assert sequence.stride_violations(lines).count() == 0


def test_fetch_and_wrap(spark, fasta, tmp_path):
    path, fai = fasta
    (tmp_path / "x.fai").write_text(fai)
    index = read_fai(spark, str(tmp_path / "x.fai"))
    sequence.validate_fai(index)
    lengths = {r["name"]: r["length"] for r in index.collect()}
    asked = ["long:1-350", "long:65,00-66,10", "crlf:30-67", "{colon}:2-7", "{colon:2-7}", "MT", "last:1-83", "long:26210-26300", "long:1-350", "MT:100-200"]
    slices = [resolve_sequence(x, lengths) for x in asked]
    found = sequence.fetch(spark, read_fasta(spark, path), slices)
    assert [r.seq for r in found.orderBy("ordinal").collect()] == [bases(lengths[s.ref])[s.start : s.end] for s in slices]
    widths = {name: line for name, _, _, line, *_ in LAYOUT}
    for width in (None, 17, 0):
        text = [r.text for r in sequence.to_fasta(found, index, width).orderBy("ordinal").collect()]
        for s, t in zip(slices, text):
            body, w = bases(lengths[s.ref])[s.start : s.end], widths[s.ref] if width is None else width
            rows = [body[k : k + w] for k in range(0, len(body), w)] if w else [body] if body else []
            assert t == "\n".join([">" + s.header, *rows])


def test_fetch_by_seeking(spark, fasta, tmp_path):
    path, fai = fasta
    (tmp_path / "x.fai").write_text(fai)
    index = read_fai(spark, str(tmp_path / "x.fai"))
    lengths = {r["name"]: r["length"] for r in index.collect()}
    slices = [resolve_sequence(x, lengths) for x in ("long:1-350", "long", "crlf:30-67", "crlf", "last:1-83", "MT:100-200", "long:26210-26300")]
    want = [bases(lengths[s.ref])[s.start : s.end] for s in slices]
    with open(path, "rb") as f:
        raw = f.read()
    packed = tmp_path / "x.fa.gz"
    packed.write_bytes(EOF_BLOCK + b"".join(deflate(raw[k : k + 5000]) + (EOF_BLOCK if k == 10_000 else b"") for k in range(0, len(raw), 5000)) + EOF_BLOCK)
    with open(packed, "rb") as f:
        gzi = Gzi.of(manifest(f, "reference")).to_bytes()
    for part in (1 << 20, 100):
        got = sequence.fetch_indexed(spark, path, index, slices, part=part).orderBy("ordinal").collect()
        assert [r.seq for r in got] == want
    got = sequence.fetch_indexed(spark, str(packed), index, slices, gzi).orderBy("ordinal").collect()
    assert [r.seq for r in got] == want
    wrong = index.withColumn("line_bases", F.col("line_bases") - 1)
    with pytest.raises(Exception, match="fit the file"):
        sequence.fetch_indexed(spark, path, wrong, slices[:1]).collect()


def test_compressed_inputs(spark, fasta, tmp_path):
    path, fai = fasta
    with open(path, "rb") as f:
        raw = f.read()
    half = len(raw) // 2
    files = {"b.fa.gz": encode(raw[:half], text=False) + encode(raw[half:], text=False), "m.fa.gz": gzip.compress(raw[:half]) + gzip.compress(raw[half:]), "m.fa": gzip.compress(raw)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        assert fai_text(sequence.build_fai(read_fasta(spark, str(tmp_path / name)))) == fai, name


def test_dictionary(spark, fasta):
    path, _ = fasta
    lines = read_fasta(spark, path).filter("ref not like '%:%'")
    text = sequence.dictionary_text(spark, lines, alias=True, uri="file:///r.fa", assembly="as", species="s p").split("\n")
    assert text[0] == "@HD\tVN:1.0\tSO:unsorted" and text[-1] == ""
    expected = [f"@SQ\tSN:{n}\tLN:{k}\tM5:{hashlib.md5(bases(k).upper().encode()).hexdigest()}\tAN:{a}\tUR:file:///r.fa\tAS:as\tSP:s p" for (n, _, k, *_), a in zip([x for x in LAYOUT if ":" not in x[0]], ("chrlong", "chrcrlf", "chrcolon", "chrMT,chrM,M", "chrlast"))]
    assert text[1:-1] == expected
    with pytest.raises(FormatError):
        sequence.dictionary(spark, lines, uri="a\tb")
    with pytest.raises(FormatError):
        sequence.dictionary(spark, read_fasta(spark, path).withColumn("ref", F.lit("a,b")))


@pytest.mark.parametrize("text", ["", "ACGT\n>a\nAC\n", ">a\nA\n>a\nC\n", ">a", ">\nAC\n"])
def test_rejects(spark, tmp_path, text):
    (tmp_path / "r.fa").write_text(text)
    with pytest.raises(FormatError):
        read_fasta(spark, str(tmp_path / "r.fa"))


@pytest.mark.parametrize("text", [">a\nACG\nAC\nACG\n", ">a\nAC\nACG\n", ">a\nAC\n\nAC\n", ">a\nAC\r\nAC\nA\n"])
def test_ragged(spark, tmp_path, text):
    (tmp_path / "r.fa").write_bytes(text.encode())
    assert sequence.stride_violations(read_fasta(spark, str(tmp_path / "r.fa"))).count() > 0


def test_text_lines_over_splits(spark, tmp_path):
    rows = [f"line {k} {'x' * (k % 50)}" for k in range(5000)]
    (tmp_path / "t.txt").write_bytes("\n".join(rows).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = text_lines(spark, str(tmp_path / "t.txt")).orderBy("record_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.raw for r in got] == rows and [r.line_no for r in got] == list(range(1, 5001))


def test_command_line(spark, fasta, tmp_path, capfd, caplog):
    path, fai = fasta
    bed = tmp_path / "a.bed"
    bed.write_text("#h\nchr1\t0\t10\talpha\nchr1\t10\t25\tbeta\nchr2\t2\t19\tgamma\n")
    gz = str(tmp_path / "a.bed.gz")
    run = lambda *a: cli.main(list(a))
    assert run("bgzip", str(bed), "-o", gz) == 0 and run("bgzip", "-t", gz) == 0
    assert run("bgzip", str(bed), "-o", gz) == 1  # it exists
    assert run("bgzip", str(bed), "-o", str(bed), "-f") == 1  # it is the input
    with open(gz, "rb") as f:
        assert decode(f) == bed.read_bytes()
    assert run("tabix", "build", gz) == 0
    out = tmp_path / "o"
    assert run("--json", "tabix", "query", gz, "chr2", "chr1:5", "-o", str(out)) == 0
    assert json.loads(capfd.readouterr().out.splitlines()[-1])["report"]["summary"] == {"lines": 2, "bytes_out": out.stat().st_size}
    assert out.read_text() == "chr2\t2\t19\tgamma\nchr1\t0\t10\talpha\n"
    assert run("tabix", "list", gz, "-o", str(out), "-f") == 0 and out.read_text() == "chr1\nchr2\n"
    assert run("tabix", "query", gz, "--header-only", "-o", str(out), "-f") == 0 and out.read_text() == "#h\n"
    assert run("tabix", "query", gz) == 1 and run("tabix", "query", gz, "chr7") == 1
    assert run("--json", "tabix", "query", gz, "chr1") == 1
    assert json.loads(capfd.readouterr().out.splitlines()[-1])["status"] == "error"
    assert run("bgzip", "-d", gz, "-b", "3", "-s", "4", "-o", str(out), "-f") == 0 and out.read_bytes() == bed.read_bytes()[3:7]
    assert run("faidx", "build", path, "-o", path + ".fai", "-f") == 0
    with open(path + ".fai") as f:
        assert f.read() == fai
    assert run("faidx", "query", path, "MT:1-5", "-o", str(out), "-f") == 0 and out.read_text() == f">MT:1-5\n{bases(5)}\n"
    # outputs may not be sidecars that are read without being named
    for command in (("tabix", "query", gz, "chr1", "-o", gz + ".tbi", "-f"), ("faidx", "query", path, "MT", "-o", path + ".fai", "-f")):
        assert run(*command) == 1
    assert run("faidx", "query", path) == 1 and run("bgzip", "-r", "-") == 1
    assert run("faidx", "query", path, "MT:1-99999999", "-o", str(out), "-f") == 0 and "past the end" in caplog.text
    with pytest.raises(SystemExit) as e:
        run("tabix", "query")
    assert e.value.code == 2


class Stdin:
    def __init__(self, data):
        self.buffer = io.BytesIO(data)


def test_command_line_streams(spark, tmp_path, monkeypatch, capfdbinary):
    data = b"".join(b"row %d\n" % k for k in range(40_000))
    out = str(tmp_path / "o.gz")
    monkeypatch.setattr("sys.stdin", Stdin(data))
    assert cli.main(["bgzip", "-o", out]) == 0
    with open(out, "rb") as f:
        packed = f.read()
    assert packed == encode(data) and sorted(os.listdir(tmp_path)) == ["o.gz", "o.gz.gzi"]
    monkeypatch.setattr("sys.stdin", Stdin(packed))
    capfdbinary.readouterr()
    assert cli.main(["bgzip", "-d", "-"]) == 0 and capfdbinary.readouterr().out == data
    monkeypatch.setattr("sys.stdin", Stdin(data))
    assert cli.main(["bgzip", "-"]) == 0 and capfdbinary.readouterr().out == packed
    monkeypatch.setattr("sys.stdin", Stdin(packed[:-40]))
    assert cli.main(["bgzip", "-t", "-"]) == 1


def test_compressed_reference(spark, fasta, tmp_path):
    """One command makes both indexes of a compressed reference, with empty blocks in it too; a query then needs nothing else."""
    path, fai = fasta
    with open(path, "rb") as f:
        data = f.read()
    packed, run = str(tmp_path / "r.fa.gz"), lambda *a: cli.main(list(a))
    with open(packed, "wb") as f:
        f.write(encode(data[:50], text=False)[:-28] + EOF_BLOCK + encode(data[50:], text=False))
    assert run("faidx", "build", packed) == 0
    with open(packed + ".fai") as f:
        assert f.read() == fai
    with open(packed + ".gzi", "rb") as f:
        assert len(Gzi.parse(f.read(), "reference").entries) == 1
    for request in ("MT:1-5", "MT:3-40"):
        a, b = str(tmp_path / "a"), str(tmp_path / "b")
        assert run("faidx", "query", packed, request, "-o", a, "-f") == run("faidx", "query", path, request, "-o", b, "-f") == 0
        with open(a) as x, open(b) as y:
            assert x.read() == y.read()
    assert run("faidx", "build", packed) == 1  # both are there
    assert run("faidx", "build", path, "-f", "--gzi-output", str(tmp_path / "x")) == 1


@pytest.mark.parametrize("row", ["a\t9223372036854775807\t10\t1\t2", "a\t100\t9223372036854775800\t60\t61"])
def test_index_rows_beyond_any_file(spark, tmp_path, row):
    (tmp_path / "x.fai").write_text(row + "\n")
    with pytest.raises(FormatError):
        sequence.validate_fai(read_fai(spark, str(tmp_path / "x.fai")))
    (tmp_path / "y.fai").write_text("a" * (1 << 20) + "\t1\t1\t1\t2\n")
    with pytest.raises(FormatError):
        read_fai(spark, str(tmp_path / "y.fai"))


@pytest.mark.parametrize("width", [None, 1, 7, 60, 1000, 0])
def test_rows_of_whole_lines(spark, tmp_path, width):
    r = random.Random(8)
    seqs = {f"s{k}": "".join(r.choice("ACGT") for _ in range(n)) for k, n in enumerate([1, 59, 60, 61, 1000, 5003])}
    (tmp_path / "a.fa").write_text("".join(f">{n}\n" + "\n".join(s[k : k + 60] for k in range(0, len(s), 60)) + "\n" for n, s in seqs.items()))
    lines = read_fasta(spark, str(tmp_path / "a.fa"))
    fai = sequence.build_fai(lines)
    slices = [Slice(f"{n}:{a}", n, a, b) for n, s in seqs.items() for a, b in [(0, len(s)), (min(13, len(s)), len(s)), (len(s) // 2, len(s) // 2 + 1), (0, 0)]]
    asked = sequence.slices_df(spark, slices)
    for found in (sequence.parts(spark, lines, asked), sequence.parts_indexed(spark, str(tmp_path / "a.fa"), fai, asked, part=777)):
        got = sequence.fasta_rows(asked, found, fai, width, row=240).orderBy("ordinal", "block").collect()
        want = []
        for s in slices:
            body, w = seqs[s.ref][s.start : s.end], {None: min(60, len(seqs[s.ref]))}.get(width, width) or 1 << 40
            want += [f">{s.header}", *(body[k : k + w] for k in range(0, len(body), w))]
        assert "\n".join(x.text for x in got).split("\n") == want
        assert width == 0 or max(len(x.text) for x in got) <= max(240, 2 * (width or 60)) + 240


def test_long_regions_take_linear_time(spark):
    import time

    n = 4_000_000
    found = spark.createDataFrame([(0, "h", "r", "ACGT" * (n // 4))], "ordinal long, header string, ref string, seq string")
    fai = spark.createDataFrame([("r", 60)], "name string, line_bases long")
    began = time.perf_counter()
    text = sequence.to_fasta(found, fai).first().text
    assert time.perf_counter() - began < 20 and text.count("\n") == -(-n // 60) and not text.endswith("\n")
