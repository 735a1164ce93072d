"""Near duplicates by the Jaccard similarity of word shingles: SimHash links first, then what they miss.

Two texts are linked if the sets of their shingles have a Jaccard similarity of at
least ``part`` of ``whole`` (4 of 5). Fingerprints alone can't tell: such pairs
differ in up to a quarter of the bits of a SimHash, and Hamming balls that wide hold
whole tables. So links come in two rounds, each pair checked on the whole sets:

* Multi-index hashing links the fingerprints of the shingles that lie 3 bits apart at
  most; beside it each frequent shingle offers one text to the others that have it.
  What this joins is one class from here on.
* Prefix filtering finds every pair that is left. With the shingles of both texts in
  one order, the first few of each must have one in common: those beyond 8/9 of the
  shorter and 4/5 of the longer text, as a similarity of 4/5 needs. Pairs within a
  class are not asked for again, and a 1,024-bit parity sketch of each set rules pairs
  out, since sketches differ in no more bits than sets do in shingles.

The order puts rare shingles first. Counts are gathered from all texts as sums of what
each stretch of ``STRETCH`` shingles holds at least twice, so a frequent shingle is
never missed; the ``MOST_LATE`` most frequent come last. Any order gives the same links,
a better one fewer pairs. Texts with equal sets are one row in all of this.

Defined cases: words are those of ``simhash.fingerprint``; null, empty and blank texts
have no shingle and are copies of each other; fewer words than a shingle make one
shingle; texts of any length count whole; a class is named after its smallest key (null
keys count last); an empty table gives no rows; other columns pass through ``keep_one``.
Shingles are hashes of 62 bits, sets with equal 128-bit digests are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import simhash
from spanframe.llm.columns import small_batches
from spanframe.llm.components import components
from spanframe.plans.bitmap import split
from spanframe.plans.scratch import mark, release, stored

SHINGLE = 5
PART, WHOLE = 4, 5
#: What the order of shingles is learned from; these change the time and no result.
STRETCH, MOST_LATE = 1 << 20, 100_000
LATE = np.int64(1 << 62)
#: Texts of candidates up to which their numbers and keys are broadcast (a few MB), so that no text is shuffled.
BROADCAST_ASKED = 100_000
SKETCH = 16  # longs
SKETCHES = [f"s{k}" for k in range(SKETCH)]
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingled(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all shingles of whole texts, repeats included, end to end, and how many each text has."""
    from xxhash import xxh64_intdigest

    words = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(xxh64_intdigest, chain.from_iterable(words)), U64, int(counts.sum()))
    # a text with fewer words than a shingle is filled up with one word that no text has
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    if len(short):
        at = np.repeat(np.cumsum(counts)[short], shingle - counts[short])
        hashes = np.insert(hashes, at, U64(0x5851F42D4C957F2D))
        counts[short] = shingle
    sizes = np.maximum(counts - shingle + 1, 0)
    begin = np.repeat(np.cumsum(counts) - counts - np.cumsum(sizes) + sizes, sizes)
    first = begin + np.arange(int(sizes.sum()))
    out = np.zeros(len(first), U64)
    for k in range(shingle):
        out = _mix(out * U64(0x9E3779B97F4A7C15) + hashes[first + k])
    return out, sizes


def distinct(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of texts as sorted hashes of 62 bits, end to end, and their sizes."""
    values = (hashes >> U64(2)).view(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, owner))
    values = values[order]
    new = np.ones(len(values), bool)
    if len(values):
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(sizes))


def fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The SimHash of each text as a signed long; 0 without shingles."""
    out, at = np.zeros(len(sizes), np.int64), 0
    for d, n in enumerate(sizes.tolist()):
        if n:
            ones = np.zeros(64, np.int64)
            for a in range(at, at + n, 1 << 16):
                bits = np.unpackbits(hashes[a : min(at + n, a + (1 << 16))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.uint32)
            out[d] = np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0]
            at += n
    return out


def frequent(spark: SparkSession, docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> np.ndarray:
    """The most frequent shingles of all texts, the rarer first: at most ``MOST_LATE``."""
    small_batches(spark)
    stretch = STRETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            again = times > 1
            return pa.RecordBatch.from_arrays([pa.array(values[again]), pa.array(times[again].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            values, _ = distinct(*shingled(batch.column(0).to_pylist(), shingle))
            held.append(values)
            size += len(values)
            if size >= stretch:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    counts = docs.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = counts.orderBy(F.desc("n"), "h").limit(MOST_LATE).collect()  # bounded by MOST_LATE
    return np.array([r.h for r in reversed(most)], np.int64)


def ordered(values: np.ndarray, sizes: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The sets in the common order, as numbers that rise in it; ``late`` come last, in their order."""
    if not len(late) or not len(values):
        return values
    by = np.argsort(late)
    known = late[by]
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    values = np.where(known[place] == values, LATE + by[place], values)
    return values[np.lexsort((values, np.repeat(np.arange(len(sizes)), sizes)))]


def prefixes(spark: SparkSession, docs: DataFrame, late: np.ndarray, key: str, text: str, shingle: int, part: int, whole: int) -> DataFrame:
    """(k, t, id, n, fp, prefix, sketch...) for every row: key, text hash, digest of the set, its size, its fingerprint, the first shingles in the common order and the parity sketch."""
    small_batches(spark)
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    names = ["k", "t", "id", "n", "fp", "prefix", *SKETCHES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            hashes, repeats = shingled(batch.column(2).to_pylist(), shingle)
            values, sizes = distinct(hashes, repeats)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            ids = [xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            bits = np.zeros((len(sizes), 64 * SKETCH), np.uint8)
            if len(values):
                np.bitwise_xor.at(bits, (np.repeat(np.arange(len(sizes)), sizes), values & (64 * SKETCH - 1)), 1)
            sketch = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            heads = np.where(sizes > 0, sizes - -(-sizes * part // whole) + 1, 0)
            at = np.repeat(cuts[:-1] - np.cumsum(heads) + heads, heads) + np.arange(int(heads.sum()))
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(heads)]).astype(np.int32)), pa.array(ordered(values, sizes, late)[at]))
            made = [pa.array(ids, pa.binary()), pa.array(sizes.astype(np.int64)), pa.array(fingerprints(hashes, repeats)), prefix, *(pa.array(np.ascontiguousarray(x)) for x in sketch.T)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    return rows.mapInArrow(run, f"k {dict(rows.dtypes)['k']}, t long, id binary, n long, fp long, prefix array<long>, " + ", ".join(f"{s} long" for s in SKETCHES))


def may_be_similar(part: int, whole: int) -> Column:
    """For columns ending in a and b: their sizes and sketches allow the similarity."""
    sizes = (F.col("na") * part <= F.col("nb") * whole) & (F.col("nb") * part <= F.col("na") * whole)
    apart = sum((F.bit_count(F.col(f"{s}a").bitwiseXOR(F.col(f"{s}b"))) for s in SKETCHES), F.lit(0))
    return sizes & (apart * (part + whole) <= (F.col("na") + F.col("nb")) * (whole - part))


def side(df: DataFrame, which: str, *columns: str) -> DataFrame:
    """``df`` with the columns of a set (and ``columns``) named for one side of a pair."""
    return df.select(*(F.col(c).alias(f"{c}{which}") for c in ("no", "n", *columns, *SKETCHES)), *(c for c in ("h",) if c in df.columns))


PAIR = ("noa", "nob", "na", "nb")


def early_pairs(spark: SparkSession, reps: DataFrame, tokens: DataFrame, part: int, whole: int) -> DataFrame:
    """(noa, nob, na, nb) of pairs that join most of what is similar, as many as there are sets and ``tokens``."""
    sets = reps.select("no", "n", *SKETCHES)
    by_print = stored(spark, reps.groupBy("fp").agg(F.min("no").alias("head")), "prints")
    near = simhash.links(spark, by_print.select("fp"))
    heads = lambda fp, no: by_print.select(F.col("fp").alias(fp), F.col("head").alias(no))
    linked = near.join(heads("a", "x"), "a").join(heads("b", "y"), "b").select("x", "y")
    alike = reps.join(by_print, "fp").filter("no != head").select(F.col("head").alias("x"), F.col("no").alias("y"))
    # each shingle offers the text that a hash picks
    offers = tokens.groupBy("h").agg(F.min(F.struct(F.xxhash64("h", "no").alias("by"), "no")).alias("offer")).select("h", F.col("offer.no").alias("x"))
    offered = tokens.join(offers, "h").filter("no != x").select("x", F.col("no").alias("y"))
    pairs = linked.union(alike).union(offered).select(F.least("x", "y").alias("noa"), F.greatest("x", "y").alias("nob")).distinct()
    return pairs.join(side(sets, "a"), "noa").join(side(sets, "b"), "nob").filter(may_be_similar(part, whole)).select(*PAIR)


def late_pairs(spark: SparkSession, reps: DataFrame, tokens: DataFrame, roots: DataFrame, part: int, whole: int) -> DataFrame:
    """(noa, nob, na, nb) of all pairs with different roots that may be similar."""
    rooted = tokens.join(roots.withColumnRenamed("node", "no"), "no", "left").withColumn("root", F.coalesce("root", "no"))
    rooted = stored(spark, rooted, "rooted")
    mixed = stored(spark, rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("h"), "mixed")
    full = rooted.join(mixed, "h").join(reps.select("no", "n", *SKETCHES), "no")
    full = stored(spark, full.withColumn("near", F.col("place") % 2 == 1).withColumn("pos", F.shiftright("place", 1)), "asked")
    shorter = side(full.filter("near"), "a", "root", "pos")
    longer = side(full, "b", "root", "pos")
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("noa") < F.col("nob")))
    # what may be shared before this shingle, itself, and behind it
    most = F.least("posa", "posb") + F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    enough = most * (part + whole) >= (F.col("na") + F.col("nb")) * part
    met = shorter.join(longer, "h").filter((F.col("roota") != F.col("rootb")) & first & enough & may_be_similar(part, whole))
    return met.select(*PAIR).distinct()


def similar(spark: SparkSession, docs: DataFrame, reps: DataFrame, pairs: DataFrame, key: str, text: str, shingle: int, part: int, whole: int) -> DataFrame:
    """(a, b): the pairs whose whole sets are similar."""
    pairs = stored(spark, pairs, "pairs")
    ids = pairs.select(F.explode(F.array("noa", "nob")).alias("no")).distinct()
    asked = stored(spark, reps.select("no", "least").join(ids, "no", "left_semi").select("no", "least.k", "least.t"), "asked")
    few = asked.limit(BROADCAST_ASKED + 1).count() <= BROADCAST_ASKED
    # only texts of candidates move
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    maybe, _ = split(spark, rows, F.struct("k", "t"), asked, F.struct("k", "t"))
    maybe, named = maybe.alias("r"), (F.broadcast(asked) if few else asked).alias("u")
    met = maybe.join(named, F.col("r.k").eqNullSafe(F.col("u.k")) & F.col("r.t").eqNullSafe(F.col("u.t"))).select("no", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # equal rows: a set comes once from each task
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            new = [i for i, no in enumerate(numbers) if not (no in told or told.add(no))]
            batch = batch.take(pa.array(new, pa.int64()))
            values, sizes = distinct(*shingled(batch.column(1).to_pylist(), shingle))
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["no", "found"])

    sets = stored(spark, met.mapInArrow(run, "no long, found array<long>"), "sets")
    both = pairs.join(sets.select(F.col("no").alias("noa"), F.col("found").alias("fa")), "noa").join(sets.select(F.col("no").alias("nob"), F.col("found").alias("fb")), "nob")
    shared = F.size(F.array_intersect("fa", "fb"))
    return stored(spark, both.filter(shared * (part + whole) >= (F.col("na") + F.col("nb")) * part).select(F.col("noa").alias("a"), F.col("nob").alias("b")).distinct(), "similar")


def classes(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """(key, component): ``component`` is the smallest key whose text can be reached by links."""
    late = frequent(spark, docs, text, shingle)
    begun = mark()
    rows = stored(spark, prefixes(spark, docs, late, key, text, shingle, part, whole), "prefixes")
    once = [F.first(c).alias(c) for c in ("n", "fp", "prefix", *SKETCHES)]
    reps = rows.groupBy("id").agg(F.min("k").alias("least_key"), F.min(F.struct("k", "t")).alias("least"), *once)
    # numbers are unique and, once written, fixed
    reps = stored(spark, reps.withColumn("no", F.monotonically_increasing_id()), "sets")
    rows = stored(spark, rows.select("k", "id"), "members")
    release(spark, begun, reps, rows)
    some = reps.filter("n > 0")
    # the shorter text of a pair needs fewer of its first shingles than the longer one
    near = F.col("pos") < F.col("n") - F.ceil(F.col("n") * (2 * part) / (part + whole)) + 1
    # three numbers a token: its place in the set, and in the last bit whether the shorter text's are enough
    place = (F.col("pos") * 2 + near.cast("int")).alias("place")
    every = some.select("no", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "no", place).repartition("h")
    # counted and picked where they lie: both read one shuffle
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("place") % 2).alias("near")).filter("times > 1 AND near = 1").select("h")
    tokens = stored(spark, every.join(shared.hint("merge"), "h"), "tokens")
    check = lambda pairs: similar(spark, docs, reps, pairs, key, text, shingle, part, whole)
    early = check(early_pairs(spark, some, tokens, part, whole))
    more = check(late_pairs(spark, some, tokens, components(spark, early), part, whole))
    roots = reps.select("id", "no", "least_key").join(components(spark, early.union(more)), F.col("no") == F.col("node"), "left").select("id", "least_key", F.coalesce("root", "no").alias("root"))
    roots = stored(spark, roots, "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("least_key").alias("component")), "root").select("id", "component")
    return rows.select("k", "id").join(named, "id").select(F.col("k").alias(key), "component")


def keep_one(spark: SparkSession, docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The row of ``docs`` that names each class; rows of one key stay or go together, rows without a key stay."""
    begun = mark()
    return simhash.keep_named(spark, docs, classes(spark, docs, key=key, **options), key, begun)
