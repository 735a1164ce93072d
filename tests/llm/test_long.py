"""Long and odd texts: the time follows their length, nothing raises, and layout doesn't matter."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanframe.llm import line_dedup, media, pii, secrets, segments

MB = 1 << 20


@pytest.mark.parametrize("text", ["see section 1.2.3). 4 people came", "1.(2.3.4", "10.0/.0.1", "1. .2.3", "(1.2).3.4"])
def test_dotted_numbers_with_brackets(text):
    assert pii.added_spans(text, pii.base_spans(text), *pii.trained()) == []


def test_drawn_numbers():
    """What can stand in and between numbers: candidates lie in the text and added spans touch nothing."""
    r, model = random.Random(4), pii.trained()
    for k in range(20_000):
        text = "".join(r.choice("0123456789...().+/- ") for _ in range(r.randint(1, 24)))
        base = pii.base_spans(text)
        for start, end, kind in pii.candidates(text):
            assert 0 <= start < end <= len(text) and kind in (1, 2, 3)
        if k % 20 == 0:
            spans = sorted(s[:2] for s in pii.added_spans(text, base, *model))
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_drawn_numbers_in_spark(spark):
    r = random.Random(5)
    rows = [(k, "".join(r.choice("0123456789...().+/- a") for _ in range(60))) for k in range(2000)]
    assert pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


@pytest.mark.parametrize("end", ["", ">"])
@pytest.mark.parametrize("piece", ["<a ", "<a b='", '<a b="', "<a b='>' ", "<!--", "<", "</a", "<?", "<script>", "<style>x", "&amp", "<a =", "<div>", "<figure>", "'\"<a>"])
def test_pages_of_unclosed_tags(piece, end):
    began = time.perf_counter()
    media.sequence(piece * (MB // len(piece)) + end)
    assert time.perf_counter() - began < 20


def test_tags_and_text():
    page = "a <b>x</b> < 3 &lt;i&gt; <img src=a alt='x>y'><IMG SRC='u\"v' /><!-- <img src=c> --><script>if (1<2) '<img src=d>'</script> e <open"
    assert [(i["kind"], i["text"] or i["src"], i["alt"]) for i in media.sequence(page)] == [("text", "a x < 3 <i>", None), ("media", "a", "x>y"), ("media", 'u"v', None), ("text", "e <open", None)]
    assert [i["text"] for i in media.sequence("<p>x<a b='c>d</p>e")] == ["xd", "e"]


def test_many_lines(spark):
    """100,000 lines, of which every other text repeats all."""
    body = "\n".join(f"line {k} of some words" for k in range(100_000))
    docs = spark.createDataFrame([(1, body), (2, body), (3, "head\n" + body)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark, docs, told=True, passages=True).collect()}
    assert time.perf_counter() - began < 120
    assert got[1].text == body and got[2].text == "" and got[3].text == "head" and got[3].n_lines == 100_001


def test_kept_lines(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [0, 2]), (["a"], [0]), (["a", "b"], []), (["a", "b", "c"], [2])], "x array<string>, gone array<int>")
    assert [r[0] for r in df.select(line_dedup._without(F.col("x"), F.col("gone"))).collect()] == [["b", "d"], [], ["a", "b"], ["a", "b"]]


def test_token_runs(spark):
    rows = [(1, "eyJ" * (MB // 3)), (2, "x" * 20 + "eyJaaaaaaaaaaaa.eyJbbbbbbbbbbbb.cccccccccccc"), (3, "a=eyJaaaaaaaaaaaa.eyJbbbbbbbbbbbb.cccccccccccc;eyJaaaaaaaaaaaa.eyJbbbbbbbbbbbb.cccccccccccc")]
    began = time.perf_counter()
    got = {r.doc_id: [s.start for s in r.found if secrets.RULES[s.rule].kind == "jwt"] for r in secrets.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 60 and got == {1: [], 2: [], 3: [2, 47]}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_copies_wherever_they_lie(spark, parts):
    rows = [(1, "two words here")] * 4 + [(2, "two words here"), (3, "other")] + [(None, "none")] * 2
    got = segments.sample(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), k=2)
    found = sorted(map(tuple, got.filter("doc_id = 1").select("copy", "sample", "ids", "perturbed").collect()))
    assert [r[:2] for r in found] == [(c, s) for c in range(4) for s in range(2)]
    assert len({r[3] for r in found}) == 8
    first = test_copies_wherever_they_lie.__dict__.setdefault("first", found)
    assert found == first
    assert sorted(r.copy for r in got.filter("doc_id IS NULL AND sample = 0").collect()) == [0, 1]
