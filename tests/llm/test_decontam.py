import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm.decontam import LETTERS, Grams, decontaminate, scan

ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, "short item"), (3, ""), (4, None), (None, "no id here"), (2, "the other of two"), (5, "漢字 été x1")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("gram", F.lit("x")).withColumn("n", F.lit("x"))


def brute(text, items, n=10):
    words = (text or "").encode().translate(LETTERS).split()
    hit, found = set(), set()
    for item, body in items:
        own = (body or "").encode().translate(LETTERS).split()
        size = min(n, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1 if own else 0):
            if tuple(words[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


def test_hashes_against_brute_force():
    r = random.Random(2)
    draw = lambda n: " ".join(r.choice("abc") for _ in range(n))
    for _ in range(200):
        items = [(k, draw(r.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(4)]
        grams = []
        for k, body in items:
            own = body.split()
            size = min(10, len(own))
            grams += [(str(k), size, " ".join(own[j : j + size])) for j in range(len(own) - size + 1) if own]
        text = draw(r.choice([0, 5, 12, 60])) + " Q " + draw(20)
        hit, found = Grams(list(dict.fromkeys(grams))).hits(text.encode().translate(LETTERS).split())
        assert (len(hit), int(np.sum(hit)), found) == brute(text, items)


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_hard_rows(spark, hard, nothing, items, most):
    extra = spark.createDataFrame([(20, "Say: THE quick-brown fox, jumps over the lazy dog AGAIN! A short item.", "en", "a"), (21, "a short-item no id here 漢字\tété x1?", "en", "a"), (22, "word " * 30_000 + "short item " + "word " * 30_000, "en", "a")], "doc_id long, text string, lang string, source string")
    every = hard.unionByName(extra, allowMissingColumns=True).withColumn("leak", F.lit("mine"))
    marked, name = scan(spark, every, items, most=most)
    assert name != "leak" and marked.columns == [*every.columns, name]
    got = sorted((repr((r.doc_id, r.text)), (r[name].n_words, r[name].n_hit, sorted(r[name]["items"]))) for r in marked.collect())
    assert got == sorted((repr((r.doc_id, r.text)), brute(r.text, ITEMS)) for r in every.collect())
    for r in marked.filter("doc_id >= 20").collect():
        for s in r[name].spans:
            assert len(r.text[s.start : s.end].encode().translate(LETTERS).split()) == s.words
    assert scan(spark, nothing, items, most=most)[0].collect() == []
    assert scan(spark, every, items.limit(0), most=most)[0].filter(F.col(name)["n_hit"] > 0).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_removal(spark, items, most):
    docs = spark.createDataFrame([(1, "Clean text.", 11), (2, "A short item, then more.", 24), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate(spark, docs, items, most=most).collect()}
    assert got == {1: ("Clean text.", 11), 2: ("A , then more.", 14), 3: (None, None)}
    assert sorted(r.doc_id for r in decontaminate(spark, docs, items, whole=True, most=most).collect()) == [1, 3]
