"""Requests as tables and detection over many files give what the rules for single ones give."""

import random

import pytest
from pyspark.sql import functions as F

from spanframe.functions.config import PRESETS, FormatError, detect, detect_files
from spanframe.functions.regions import RegionError, parse_region, resolve_sequence
from spanframe.functions.request_tables import parse_regions, raise_first, resolve_regions


def texts(r, n, alphabet, names):
    out = ["", ":", "-", "{", "}", "{}", "{a}", "{a}:", "a\t:1", "a:1\n", "a:" + "9" * 40, "a:9223372036854775807", "a:9223372036854775808", "a:18446744073709551616-", "a:1-18446744073709551615", "a:001-002", "a:1,000-2,0000", "a:１-2"]
    for _ in range(n):
        out.append(r.choice(names) + "".join(r.choice(alphabet) for _ in range(r.randint(0, 6))))
    return out


def test_interval_requests(spark):
    asked = texts(random.Random(1), 3000, "0123,:--a{}", ["", "a", "a:", "a:1", "HLA:A:"])
    got = parse_regions(spark.createDataFrame([(k, x, "x") for k, x in enumerate([*asked, None])], "ordinal long, region string, name string")).orderBy("ordinal").collect()
    assert got[-1].error == "no request" and got[0].name == "x"
    for text, row in zip(asked, got):
        try:
            want = parse_region(text)
        except RegionError:
            assert row.error and row.ref is None and row.start is None, text
        else:
            assert (row.error, row.ref, row.start, row.end) == (None, want.ref, want.start, want.end), text


def test_sequence_requests(spark):
    lengths = {"a": 100, "a:2-7": 30, "b:c": 10, "": 5, "{x": 7, "a:1": 3}
    asked = texts(random.Random(2), 3000, "0123,:--a{}", ["", "a", "a:", "a:2-7", "b:c", "b:c:", "{a", "{a}", "{a:2-7}:", "{x"])
    index = spark.createDataFrame(list(lengths.items()), "name string, length long")
    got = resolve_regions(spark.createDataFrame(list(enumerate(asked)), "ordinal long, request string"), index).orderBy("ordinal").collect()
    assert len(got) == len(asked)
    for text, row in zip(asked, got):
        try:
            want = resolve_sequence(text, lengths)
        except RegionError as e:
            assert row.error and row.ref is None, (text, e)
        else:
            assert (row.error, row.ref, row.start, row.end) == (None, want.ref, want.start, want.end), text


def test_first_error_raises(spark):
    good = parse_regions(spark.createDataFrame([(0, "a:1-2"), (1, "b")], "ordinal long, region string"))
    assert [r.ref for r in raise_first(good).orderBy("ordinal").collect()] == ["a", "b"]
    with pytest.raises(RegionError, match="request 1"):
        raise_first(parse_regions(spark.createDataFrame([(2, ":"), (0, "a"), (1, "b:0")], "ordinal long, region string")))
    assert parse_regions(good.select("ordinal", "region").limit(0)).collect() == []


def test_files(spark):
    r = random.Random(3)
    heads = ["##fileformat=VCFv4.2", "##gff-version 3", "@HD\tVN:1", "@XX\t1", "#x", "", "\r"]
    rows = ["c\t1\t2", "c\t1\tA\tC\t.\t.\t.\tDP=1;END=5", "c\ts\tf\t3\t9", "r\t0\tc\t5\t9\t3M2D", "c\t0\tx\tG\t0\t4\t1\tEND=", "junk", "c\t5\t5\t1\t1\r"]
    names = ["a.bed", "b.vcf.gz", "dir.sam/c", "d.GTF", "e.txt", "f.sam.bgz", "gff", "g.bed.zip"]
    files = {f"{k}/{r.choice(names)}": [r.choice(heads + rows) for _ in range(r.randint(1, 4))] for k in range(400)}
    lines = spark.createDataFrame([(p, k, x) for p, own in files.items() for k, x in enumerate(own)], "path string, line_no long, raw string")
    got = {x.path: x for x in detect_files(lines.repartition(5)).collect()}
    assert set(got) == set(files)
    kinds = {c: n for n, c in PRESETS.items()}
    for path, own in files.items():
        try:
            want = kinds[detect(path, "\n".join(own))]
        except FormatError as e:
            assert got[path].format is None and got[path].error.split(":")[0] == str(e).split(":")[0]
        else:
            assert (got[path].format, got[path].error) == (want, None)
