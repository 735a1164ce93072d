import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanframe.llm import ranking
from spanframe.llm.decontam import LETTERS
from spanframe.llm.ranking import Segment, _found, build, search, unvarint, varint

tokens = lambda text: (text or "").encode().translate(LETTERS).decode().split()


def brute(docs, queries, k):
    """Scores by definition: (query, rank, key, score)."""
    bags = [(key, Counter(t)) for key, text in docs if (t := tokens(text))]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for name, text in queries:
        asked, scores = Counter(tokens(text)), []
        for key, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, times in asked.items() if t in bag)
            if score:
                scores.append((-score, key is None, key or 0, key))
        out += [(name, r + 1, key, -s) for r, (s, _, _, key) in enumerate(sorted(scores)[:k])]
    return out


def test_bytes():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31 - 1])
    data, at = varint(values)
    assert unvarint(data.tobytes()).tolist() == values.tolist() and at.tolist()[-1] == len(data)


@pytest.mark.parametrize("block, stretch", [(1, 0), (4, 2), (128, 512)])
def test_walk_against_brute_force(monkeypatch, block, stretch):
    monkeypatch.setattr(ranking, "BLOCK", block)
    monkeypatch.setattr(ranking, "STRETCH", stretch)
    r = random.Random(block)
    for _ in range(60):
        words = [f"t{k}" for k in range(r.choice([3, 20]))]
        docs = [(k, " ".join(r.choices(words, [1 / (j + 1) for j in range(len(words))], k=r.choice([1, 5, 40])))) for k in range(r.randint(1, 150))]
        segments, n, total = [], len(docs), sum(len(tokens(t)) for _, t in docs)
        for start in range(0, n, 60):
            segment = Segment()
            for key, text in docs[start : start + 60]:
                segment.add(key, [t.encode() for t in tokens(text)])
            segments += segment.rows(str(start), n, total, pa.int64()).to_pylist()
        df = Counter(t for _, text in docs for t in set(tokens(text)))
        query = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in words if t in df]
        query = [q for q in query if q[1]]
        got = sorted((-s, key) for _, s, key in _found([query], iter((s["segment"], s["term"], s["blocks"], s["ids"], s["sizes"]) for s in segments), n, total, 5))
        assert [(key, -s) for s, key in got] == [x[2:] for x in brute(docs, [(0, " ".join(words))], 5)]


def test_blocks_are_skipped(monkeypatch):
    """What can't reach the threshold stays compressed."""
    opened = []
    real = ranking.Postings.open
    monkeypatch.setattr(ranking.Postings, "open", lambda self, k: opened.append(k) or real(self, k))
    segment, n = Segment(), 20_000
    for k in range(n):
        segment.add(k, [b"common"] * (1 if k < n - 2000 else 30) + [b"filler"] * (1 + k % 40))
    rows = segment.rows("0", n, segment.words, pa.int64()).to_pylist()
    blocks = next(len(r["blocks"]) for r in rows if r["term"] == "common")
    list(_found([[("common", 1000)]], iter((s["segment"], s["term"], s["blocks"], s["ids"], s["sizes"]) for s in rows), n, segment.words, 5))
    assert len(set(opened)) < blocks / 2


def test_hard_rows(spark, hard, nothing):
    items = spark.createDataFrame([(1, "One TWO"), (2, None), (3, ""), (4, "word other one"), (1, "漢字"), (None, "null"), (5, "absent")], "item_id long, text string").withColumn("item", F.lit("x")).withColumn("term", F.lit("x"))
    docs = [(r.doc_id, r.text) for r in hard.collect()]
    want = brute(docs, [(1, "One TWO 漢字"), (4, "word other one"), (None, "null")], 3)
    for asked in (1 << 18, 2):
        got = [tuple(r) for r in search(spark, build(spark, hard), items, k=3, asked=asked).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert search(spark, build(spark, nothing), items).collect() == []
    assert search(spark, build(spark, hard), items.limit(0)).collect() == []


def test_segments(spark, docs, rows, monkeypatch, sf):
    """Whatever the segments: the function that tasks get has its bounds with it."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(brute([(i, t) for i, t, *_ in rows], [(r.item_id, r.text) for r in items.collect()], 20))
    got = search(spark, build(spark, docs.repartition(9)), items).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == want
