"""The pipeline's near dedup against all pairs."""

import random
from fractions import Fraction

import pytest

import corpus_pipeline
from spanframe.llm import near


def slow_sets(texts):
    out = {}
    for d, text in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        out[d] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def slow_links(sets):
    keys = sorted(sets)
    similar = lambda x, y: x == y or Fraction(len(x & y), len(x | y)) >= Fraction(4, 5)
    return [(a, b) for i, b in enumerate(keys) for a in keys[:i] if 4 * len(sets[a]) <= 5 * len(sets[b]) and 4 * len(sets[b]) <= 5 * len(sets[a]) and similar(sets[a], sets[b])]


def slow_classes(sets):
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in slow_links(sets):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {k: find(k) for k in root}


def planted():
    """Texts of 30 to 300 words with copies some of whose words are replaced, on both sides of the bound."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(3000)}"
    texts = []
    for _ in range(60):
        words = [word() for _ in range(r.randint(30, 300))]
        texts.append(words)
        for _ in range(4):
            copy = list(words)
            for _ in range(r.randint(1, max(1, len(words) // 25))):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy[r.randint(0, 3) :])
    return [(k, " ".join(x)) for k, x in enumerate(texts)]


@pytest.mark.parametrize("most_late", [near.MOST_LATE, 50, 0])
def test_near_copies(spark, monkeypatch, most_late):
    monkeypatch.setattr(near, "MOST_LATE", most_late)
    texts = planted()
    want = slow_classes(slow_sets(texts))
    assert 60 <= len(set(want.values())) < len(want) - 60
    got = near.classes(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component for r in got} == want


def test_stage_keeps_no_near_copy(spark, sf, docs, rows):
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    want = slow_classes(slow_sets([(d, t) for d, t, *_ in rows]))
    assert kept == set(want.values())


def test_stage_on_planted_copies(spark, sf):
    texts = planted()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string"), sf).collect()}
    assert kept == set(slow_classes(slow_sets(texts)).values())


def test_late_pairs_alone(spark, monkeypatch):
    """Prefix filtering loses no pair even if nothing was joined before."""
    texts = planted()
    monkeypatch.setattr(near, "early_pairs", lambda spark, reps, *rest: reps.select(*(near.F.lit(0).cast("long").alias(c) for c in near.PAIR)).limit(0))
    got = near.classes(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component for r in got} == slow_classes(slow_sets(texts))


def test_many_copies_make_few_pairs(spark):
    """A group of near copies is joined through a few of its members, not pair by pair."""
    r = random.Random(4)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for k in range(600):
        words = list(base)
        words[r.randrange(200)] = f"x{k}"
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = []
    plain = near.similar

    def counted(spark, docs, reps, found, *rest):
        pairs.append(found.count())
        return plain(spark, docs, reps, found, *rest)

    near.similar = counted
    try:
        got = near.classes(spark, docs).collect()
    finally:
        near.similar = plain
    assert {r.component for r in got} == {0}
    assert sum(pairs) < 600 * 120 and pairs[1] < 600


def test_near_hard(spark, hard, nothing):
    kept = near.keep_one(spark, hard)
    assert kept.columns == hard.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "2", "6", "7", "8", "None", "None"]
    assert near.classes(spark, nothing).count() == 0
