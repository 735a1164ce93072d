"""Layouts, line parsing, grammars and coordinates against plain Python."""

import pytest
from pyspark.sql import functions as F

from spanframe.functions import coords, records, sequences
from spanframe.functions.config import PRESETS, FormatError, custom, detect, from_header, resolve, to_header
from spanframe.functions.records import parse_line
from spanframe.functions.regions import RegionError, Request, parse_region, read_region_lines, resolve_sequence

GOOD = [
    ("bed", "chr1\t0\t10\ta", ("chr1", 1, 10)),
    ("gff", "chr1\ts\tgene\t11\t25\t.\t+\t.\tid", ("chr1", 11, 25)),
    ("sam", "r\t0\tchr1\t1\t9\t5M2D3M\t*\t0\t0\tA\tI", ("chr1", 1, 10)),
    ("sam", "r\t0\tchr1\t7\t9\t*\t*\t0\t0\tA\tI", ("chr1", 7, 7)),
    ("sam", "r\t0\tchr1\t7\t9\t4S3I\t*\t0\t0\tA\tI", ("chr1", 7, 7)),
    ("vcf", "chr1\t7\t.\tAC\tA\t.\t.\tDP=1", ("chr1", 7, 8)),
    ("vcf", "chr1\t20\t.\tA\tG\t.\t.\tEND=35;CIEND=1", ("chr1", 20, 35)),
    ("vcf", "chr1\t20\t.\tAAAA\tG\t.\t.\tEND=21", ("chr1", 20, 23)),
    ("vcf", "chr1\t20\t.\tA\tG\t.\t.\tEND=.", ("chr1", 20, 20)),
    ("vcf", "chr1\t020\t.\tA\tG\t.\t.\tCIEND=5", ("chr1", 20, 20)),
]
BAD = [
    ("gff", "chr1\ts\tgene\t0\t25\t.\t+\t.\tid"),
    ("gff", "chr1\ts\tgene\t26\t25\t.\t+\t.\tid"),
    ("bed", "chr1\t5"),
    ("bed", "chr1\t5\t5"),
    ("bed", "\t5\t6"),
    ("bed", "chr1\t-5\t6"),
    ("bed", "chr1\t5\t6e1"),
    ("bed", "chr1\t5\t18446744073709551616"),
    ("bed", "a\0b\t5\t6"),
    ("sam", "r\t0\tchr1\t1\t9\t10M5\t*\t0\t0\tA\tI"),
    ("sam", "r\t0\tchr1\t1\t9\t10Q\t*\t0\t0\tA\tI"),
    ("sam", "r\t0\tchr1\t1\t9\t0M\t*\t0\t0\tA\tI"),
    ("sam", "r\t0\t*\t1\t9\t5M\t*\t0\t0\tA\tI"),
    ("vcf", "chr1\t7\t.\t.\tA\t.\t.\tDP=1"),
    ("vcf", "chr1\t7\t.\tA\tA\t.\t.\tEND=6"),
    ("vcf", "chr1\t7\t.\tA\tA\t.\t.\tEND=9;END=9"),
]


@pytest.mark.parametrize("kind,raw,expected", GOOD)
def test_good_line(kind, raw, expected):
    assert parse_line(raw, PRESETS[kind]) == expected


@pytest.mark.parametrize("kind", PRESETS)
def test_columns_agree_with_driver_rule(spark, kind):
    rows = [(k, k + 1, raw + end) for k, (n, raw, _) in enumerate(GOOD) if n == kind for end in ("", "\r")]
    found = records.records(spark.createDataFrame(rows, "record_id long, line_no long, raw string"), PRESETS[kind]).collect()
    assert sorted((r["ref"], r["start"], r["end"]) for r in found) == sorted(x for n, _, x in GOOD if n == kind for _ in range(2))


@pytest.mark.parametrize("kind,raw", BAD)
def test_bad_line(spark, kind, raw):
    with pytest.raises(FormatError):
        parse_line(raw, PRESETS[kind])
    with pytest.raises(Exception, match="USER_RAISED|raise_error|Exception"):
        records.records(spark.createDataFrame([(0, 1, raw)], "record_id long, line_no long, raw string"), PRESETS[kind]).collect()


def test_trim_takes_one_carriage_return(spark):
    df = spark.createDataFrame([("a\r\r",), ("a\r",), ("a",)], "raw string").select(records.trim_end(F.col("raw")).alias("x"))
    assert [r.x for r in df.collect()] == ["a\r", "a", "a"]


def test_meta_lines(spark):
    config = custom(1, 2, 3, comment="%", skip=1)
    df = spark.createDataFrame([(1, "head"), (2, "%c"), (3, "d"), (4, "#e")], "line_no long, raw string")
    assert [r.line_no for r in df.filter(~records.is_meta(F.col("raw"), F.col("line_no"), config)).collect()] == [3, 4]


def test_bins_against_a_loop(spark):
    def slow(start, end, shift, depth):
        for level in range(depth, 0, -1):
            s = shift + 3 * (depth - level)
            if (start - 1) >> s == (end - 1) >> s:
                return ((1 << 3 * level) - 1) // 7 + ((start - 1) >> s)
        return 0

    cases = [(1 + 7919 * k % 500000, 1 + 7919 * k % 500000 + 3 ** (k % 12)) for k in range(300)]
    for shift, depth in ((14, 5), (4, 6), (10, 3)):
        cap = coords.capacity(shift, depth)
        rows = [(a, min(b, cap)) for a, b in cases if a <= cap]
        df = spark.createDataFrame(rows, "s long, e long").select("s", "e", coords.reg2bin(F.col("s"), F.col("e"), shift, depth).alias("b"), coords.bins_of(F.col("s"), F.col("e"), shift, depth).alias("all"))
        for r in df.collect():
            assert r.b == slow(r.s, r.e, shift, depth)
            assert r.b in r["all"] and 0 in r["all"]


@pytest.mark.parametrize("shift,formatted,declared,depth", [(10, False, None, 9), (14, False, None, 8), (25, False, None, 4), (31, False, None, 4), (10, True, 1000, 7), (14, True, 1000, 6)])
def test_csi_depth(shift, formatted, declared, depth):
    assert coords.csi_depth(shift, formatted, declared) == depth


def test_csi_depth_rejects():
    for shift in (0, 32):
        with pytest.raises(ValueError):
            coords.csi_depth(shift)
    with pytest.raises(ValueError):
        coords.csi_depth(1, True, 1 << 40)


def test_configs():
    assert resolve("bed") == PRESETS["bed"] and resolve() is None
    assert resolve(sequence=2) == custom(2, 4, 5)
    for bad in (dict(sequence=0), dict(sequence=4), dict(comment="\t"), dict(comment="##"), dict(skip=-1)):
        with pytest.raises(FormatError):
            custom(**bad)
    with pytest.raises(FormatError):
        resolve("bed", skip=1)
    for name in ("sam", "vcf"):
        assert from_header(to_header(PRESETS[name])) == PRESETS[name]
    assert from_header(to_header(PRESETS["bed"])) == PRESETS["bed"]
    assert from_header(to_header(custom(2, 3, 4, True, "%", 7))) == custom(2, 3, 4, True, "%", 7)


def test_detection():
    assert detect("x.VCF.gz", "") == PRESETS["vcf"]
    assert detect("x", "@SQ\tSN:a\n") == PRESETS["sam"]
    assert detect("x.gtf", GOOD[1][1] + "\n") == PRESETS["gff"]
    assert detect("x.txt", "#c\nchr1\t0\t10\n") == PRESETS["bed"]
    for name, sample in (("x.bed", "##fileformat=VCFv4\n"), ("x.txt", "words\n"), ("x.txt", ""), ("x.vcf", "chr1\t1\n")):
        with pytest.raises(FormatError):
            detect(name, sample)


@pytest.mark.parametrize("text,expected", [
    ("chr1", ("chr1", 1, None)), ("chr1:20", ("chr1", 20, 20)), ("chr1:1,000-2,000", ("chr1", 1000, 2000)), ("chr1:5-", ("chr1", 5, None)),
    ("chr1:-7", ("chr1", 1, 7)), ("chr1:-", ("chr1", 1, None)), ("HLA:A:1-2", ("HLA:A", 1, 2)), ("c:007", ("c", 7, 7)),
])
def test_region(text, expected):
    assert parse_region(text) == Request(text, *expected)


@pytest.mark.parametrize("text", ["", ":5", "chr1:", "chr1:0", "chr1:5-2", "chr1:1,00", "chr1:x", "chr1:+5", "a\tb:1", "chr1:1-2-3", "chr1:99999999999999999999"])
def test_bad_region(text):
    with pytest.raises(RegionError):
        parse_region(text)


def test_region_lines():
    lines = ["#c\n", "\n", "chr2\t1\t20\textra\r\n"]
    assert read_region_lines(lines, bed=False) == [Request("chr2:1-20", "chr2", 1, 20)]
    assert read_region_lines(["chr1\t0\t5"], bed=True) == [Request("chr1:1-5", "chr1", 1, 5)]
    for bad in ("chr1\t1", "chr1\ta\t5", "chr1\t0\t5", "chr1\t6\t5"):
        with pytest.raises(RegionError):
            read_region_lines([bad], bed=False)


def test_sequence_region():
    names = {"a": 100, "colon": 137, "colon:2-7": 19}
    get = lambda t: (lambda s: (s.ref, s.start, s.end))(resolve_sequence(t, names))
    assert get("a") == ("a", 0, 100) and get("a:20") == ("a", 19, 100) and get("a:1,0-2,0") == ("a", 9, 20)
    assert get("{colon}:2-7") == ("colon", 1, 7) and get("{colon:2-7}") == ("colon:2-7", 0, 19)
    assert get("a:90-500") == ("a", 89, 100) and get("a:101-200") == ("a", 100, 100)
    for bad in ("none", "colon:2-7", "a:0-1", "a:5-2", "a:18446744073709551616", "{a", "a:"):
        with pytest.raises(RegionError):
            resolve_sequence(bad, names)


def test_sequence_columns(spark):
    df = spark.createDataFrame([("acgTN-", "M"), ("", "chr1"), ("ab cd\tef", "MT")], "s string, n string")
    got = df.select(sequences.wrap(sequences.graphic(F.col("s")), 3).alias("w"), sequences.aliases(F.col("n")).alias("a"), sequences.is_sam_name(F.col("n")).alias("ok")).collect()
    assert [tuple(r) for r in got] == [("ACG\nTN-", "chrM,chrMT,MT", True), ("", "1", True), ("ABC\nDEF", "chrMT,chrM,M", True)]
    assert not any(r[0] for r in spark.createDataFrame([("*a",), ("=b",), ("a,b",), ("a b",), ("",)], "n string").select(sequences.is_sam_name(F.col("n"))).collect())
