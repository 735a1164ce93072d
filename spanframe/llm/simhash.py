"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is the majority of that bit over the hashes of a text's word
shingles. Fingerprints that differ in 3 bits or fewer agree up to one bit in at
least one 32-bit half: each half is looked up in a table of halves together with
the halves one bit away, and what is fetched is checked over all 64 bits. Of two
halves one bit apart, only that with the clear bit asks, so each pair is fetched once.

All of this is on distinct fingerprints: a group of copies is one row. Halves that
more than ``hot`` fingerprints share are looked up under longer keys: the pair
agrees up to one bit in a 16-bit quarter of its other half as well, and no such
key is shared by more than 2^16 fingerprints.

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other; fewer words than a shingle make one shingle; an empty table gives
no rows; rows that repeat all get the same class; a class is named after its
smallest key (null keys count last).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.columns import small_batches
from spanframe.llm.components import components
from spanframe.plans.bitmap import split, unused
from spanframe.plans.scratch import mark, release, stored

SHINGLE = 3
SEED = 42
BITS_APART = 3
HOT = 2000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority fingerprint of a whole text; bytes are lower-cased from A to Z only and split at ASCII white space."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    parts = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, fp long")


def _flips(value: Column, width: int) -> Column:
    """The value and every value with one of its clear bits set."""
    clear = F.filter(F.array(*(F.lit(1 << b).cast("long") for b in range(width))), lambda bit: value.bitwiseAND(bit) == 0)
    return F.concat(F.array(value), F.transform(clear, lambda bit: value.bitwiseOR(bit)))


def _half(fp: Column, k: int, width: int = 32) -> Column:
    return F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def links(spark: SparkSession, prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) for fingerprints of ``prints`` (distinct fp) that differ in 1 to 3 bits; a pair may come twice."""
    fp = F.col("fp")
    # a key is the 32 bits of a half, unsigned, and which half it is
    named = lambda k, half: half.bitwiseOR(F.lit(k << 32).cast("long"))
    table = prints.select("fp", F.explode(F.array(*(named(k, _half(fp, k)) for k in (0, 1)))).alias("key"))
    each = lambda values, named, k: F.transform(values, lambda x: named(k, x))
    asked = prints.select("fp", F.explode(F.concat(*(each(_flips(_half(fp, k), 32), named, k) for k in (0, 1)))).alias("key"))
    crowded = stored(spark, table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key"), "crowded")

    def met(asked: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
        pairs = asked.withColumnRenamed("fp", "a").join(table.withColumnRenamed("fp", "b"), on)
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        return pairs.filter((F.col("a") != F.col("b")) & (apart <= BITS_APART)).select("a", "b")

    if crowded.isEmpty():
        return met(asked, table, ["key"])
    other = F.when(F.shiftright("key", 32) == 0, _half(fp, 1)).otherwise(_half(fp, 0))
    quarter = lambda q: F.shiftright(other, 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))
    tag = lambda q, value: value.bitwiseOR(F.lit(q << 16).cast("long"))
    longer_table = table.join(crowded, "key", "left_semi").select("fp", "key", F.explode(F.array(*(tag(q, quarter(q)) for q in (0, 1)))).alias("sub"))
    # which of two fingerprints asks is settled by the half; in the other half either may have the bit, so both ways are asked
    near = lambda value: F.concat(F.array(value), F.transform(F.array(*(F.lit(1 << b).cast("long") for b in range(16))), lambda bit: value.bitwiseXOR(bit)))
    longer_asked = asked.join(crowded, "key", "left_semi").select("fp", "key", F.explode(F.concat(*(each(near(quarter(q)), tag, q) for q in (0, 1)))).alias("sub"))
    plain = met(asked.join(crowded, "key", "left_anti"), table.join(crowded, "key", "left_anti"), ["key"])
    return plain.union(met(longer_asked, longer_table, ["key", "sub"]))


def classes(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(key, fp, component): ``component`` is the smallest key whose fingerprint can be reached by links."""
    rows = stored(spark, fingerprints(spark, docs, key, text, shingle), "fingerprints")
    prints = stored(spark, rows.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    edges = stored(spark, links(spark, prints.select("fp"), hot), "links")
    roots = prints.join(components(spark, edges), prints["fp"] == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = stored(spark, roots, "roots")
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "component")
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_named(spark: SparkSession, docs: DataFrame, found: DataFrame, key: str = "doc_id", begun: int | None = None) -> DataFrame:
    """``docs`` without the rows whose class in ``found`` (key, component) is named after another key.

    What was stored for ``found`` since the mark ``begun`` is released.
    """
    (name,) = unused(docs, "__gone")
    gone = found.filter(F.col("component") != F.col(key)).select(F.col(key).alias(name))
    gone = stored(spark, gone.distinct(), "gone")
    if begun is not None:
        release(spark, begun, gone)
    maybe, others = split(spark, docs, F.col(key), gone, F.col(name))
    return maybe.join(gone, F.col(key) == F.col(name), "left_anti").unionByName(others)


def keep_one(spark: SparkSession, docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The row of ``docs`` that names each class; rows of one key stay or go together, rows without a key stay."""
    begun = mark()
    return keep_named(spark, docs, classes(spark, docs, key=key, **options), key, begun)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes(spark, docs).select("doc_id", fp.alias("fingerprint"), F.col("component").alias("component_id"))
