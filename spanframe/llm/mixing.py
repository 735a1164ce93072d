"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target number of words (its weight's share, water-filled under
a cap on repeats). A source is taken whole as many times as its target allows;
the rest is a weighted sample without replacement: documents in the order of
``-ln(u) / quality``, prefix-summed up to what is left of the target.

Only DataFrame functions run here. Prefix sums go over range partitions, so a
source that holds a third of all rows is spread over as many tasks as any other.

What is taken of a source is a number of whole epochs and a prefix of its order, so
``apply_mix`` needs one row a source, the last place taken: texts are not shuffled.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; an empty table gives an empty result;
equal rows are sampled one by one (ties broken by text hash), as many of them as ``mix``
takes; a very long text is one row like any other, its source misses the target by less
than its size; columns beyond those named are ignored by ``mix`` and kept by
``apply_mix``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.plans.ordering import ranked
from spanframe.plans.scratch import mark, release, stored

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>!]"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, words: Column) -> Column:
    """Between 0 and 1: the fewer symbols a word, the likelier a document is drawn."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0))
    return 1.0 / (1.0 + 10.0 * symbols / (words + 1))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("long") + 0.5) / float(1 << 52)


def source_targets(spark: SparkSession, sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, source_size, source_start, target): one row a source.

    Weights repeat over the sources in code-point order, null last. A target that would pass
    ``max_epochs`` times its source stops there; the excess is shared again by weight. Sources sorted by
    cap over weight fill up in that order, so the water level is found from prefix sums, without a loop.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = ranked(spark, per, [F.col("source").asc_nulls_last()], "place", {"source_start": "source_size"})
    per = per.select(
        "source", "source_size", "source_start", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long").alias("weight")
    ).withColumn("cap", F.col("source_size") * max_epochs)
    per = stored(spark, per, "sources")
    level = ranked(spark, per, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], "place", {"cap_before": "cap", "weight_before": "weight"})
    whole = per.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = level.crossJoin(F.broadcast(whole)).select(  # one row on the right
        "place", F.col("cap") / F.col("weight") >= (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")), ((F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))).alias("level")
    ).toDF("place", "above", "level")
    level = level.filter("above").agg(F.min_by("level", "place").alias("level"))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return stored(spark, per.crossJoin(F.broadcast(level)).select("source", "source_size", "source_start", target.alias("target")), "targets")


def _weighed(docs: DataFrame, seed: int, key: str, text: str, source: str, *carried: Column) -> DataFrame:
    """(key, source, size, tie, sample_key) and ``carried`` for every row."""
    words = word_count(F.col(text))
    base = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"), *carried)
    others = [c for c in base.columns if c not in ("key", "source", "size", "tie", "text")]
    return base.select("key", "source", "size", "tie", (-F.log(uniform(F.col("key"), seed)) / quality_weight(F.col("text"), F.col("size"))).alias("sample_key"), *others)


def _mixed(spark: SparkSession, docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: int, key: str, text: str, source: str) -> DataFrame:
    """(key, source, size, tie, sample_key, source_size, target, epochs, extra) for every row of ``docs``."""
    base = stored(spark, _weighed(docs, seed, key, text, source), "weighed")  # texts are read once; range partitioning samples its input first
    order = [F.col("source").asc_nulls_last(), F.col("sample_key"), F.col("key"), F.col("tie")]
    run = stored(spark, ranked(spark, base, order, "place", {"ahead": "size"}), "mix")
    targets = source_targets(spark, run, weights, max_epochs)
    at = run.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("ahead") - F.col("source_start") + F.col("size") / 2.0 <= rest)
    return at.withColumn("epochs", epochs).select("key", F.col("d.source").alias("source"), "size", "tie", "sample_key", "source_size", "target", "epochs", extra.alias("extra"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(key, size, source_size, target, taken, copies, sample_key, source, tie) for every row of ``docs``.

    ``copies`` is how often the row is taken whole; ``taken`` is that times its size. The last document of a
    fractional epoch is in if its midpoint lies below what is left, which brings the sum nearest the target.
    """
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("extra").cast("long")).otherwise(0).cast("long")
    found = _mixed(spark, docs, weights, max_epochs, seed, key, text, source).withColumn("copies", copies)
    return found.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "sample_key", "source", "tie")


def apply_mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, the copies of a row behind one another."""
    begun = mark()
    found = stored(spark, _mixed(spark, docs, weights, max_epochs, seed, key, text, source), "mixed")
    place = F.struct("sample_key", "key", "tie")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    cuts = found.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("extra"), place)).alias("cut"))
    # rows that tie with the last place taken: how many there are and how many are in
    ties = found.alias("f").join(cuts.alias("c"), same("f", "c")).filter(place == F.col("cut")).groupBy("f.source").agg(F.count(F.lit(1)).alias("tied"), F.sum(F.col("extra").cast("long")).alias("inside"))
    cuts = stored(spark, cuts.alias("c").join(ties.alias("t"), same("c", "t"), "left").select("c.source", "epochs", "cut", "tied", "inside"), "cuts")
    release(spark, begun, cuts)
    rows = _weighed(docs, seed, key, text, source, F.struct("*").alias("row")).filter("size > 0").alias("d").join(cuts.alias("c"), same("d", "c"))
    whole = (place < F.col("cut")) | ((place == F.col("cut")) & (F.col("tied") == F.col("inside")))
    partly = F.coalesce((place == F.col("cut")) & (F.col("tied") > F.col("inside")), F.lit(False))
    times = F.col("epochs") + F.coalesce(whole, F.lit(False)).cast("long")
    copied = lambda df: df.filter("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("row.*")
    out = copied(rows.filter(~partly).select("row", times.alias("times")))
    if cuts.filter("tied > inside").isEmpty():
        return out
    # equal rows of which some are in: any of them
    equal = rows.filter(partly).select("row", "d.source", "epochs", "inside", F.monotonically_increasing_id().alias("id"))
    equal = stored(spark, ranked(spark, equal, [F.col("source").asc_nulls_last(), F.col("id")], "nth"), "equal")
    first = equal.groupBy("source").agg(F.min("nth").alias("first"))
    numbered = equal.alias("e").join(first.alias("f"), same("e", "f"))
    return out.union(copied(numbered.select("row", (F.col("epochs") + (F.col("nth") - F.col("first") < F.col("inside")).cast("long")).alias("times"))))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!]')) AS symbols,
         (CAST('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
keyed AS (SELECT *, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * symbols / (size + 1)::DOUBLE)) AS sample_key FROM base),
run AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY sample_key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed),
per AS (
  SELECT source, sum(size) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM base GROUP BY source),
level AS (
  SELECT *, source_size * 3 AS cap,
         coalesce(sum(source_size * 3) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before,
         sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight, row_number() OVER (ORDER BY source_size * 3 / weight::DOUBLE, source NULLS LAST) AS place
  FROM per WINDOW w AS (ORDER BY source_size * 3 / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (
  SELECT min_by((all_size - cap_before)::DOUBLE / (all_weight - weight_before)::DOUBLE, place) AS level FROM level
  WHERE cap / weight::DOUBLE >= (all_size - cap_before)::DOUBLE / (all_weight - weight_before)::DOUBLE),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least((source_size * 3)::DOUBLE, coalesce(water.level, 'inf'::DOUBLE) * weight) AS target FROM per, water)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * (floor(target / source_size) + CASE WHEN ahead + size / 2.0::DOUBLE <= target - floor(target / source_size) * source_size THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM run JOIN targets ON run.source IS NOT DISTINCT FROM targets.source
"""
