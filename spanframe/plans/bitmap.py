"""Splitting a wide table by a set of keys before it is shuffled.

A join that changes a few rows of a table with long texts would move all of it.
Keys are hashed into a bitmap of fixed size, which is broadcast as words of 64
bits: rows whose bit is clear can't be among the keys and go past the join, the
others are joined exactly. A bitmap that fills up sends more rows into the join
and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.plans.scratch import stored

#: 2^24 bits are at most 2^18 words: a broadcast of a few MB, however many keys there are.
BITS = 24


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has them already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def split(spark: SparkSession, df: DataFrame, df_key: Column, keys: DataFrame, key: Column, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` that may have a key in ``keys``, rows that have none); null keys hash like any value."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    place, word, held = unused(df, "__place", "__word", "__bits")
    set_ = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").bitwiseAND(F.lit(63).cast("long")).cast("int")))
    words = keys.select(spot(key).alias("spot")).groupBy(F.shiftright("spot", 6).alias(word)).agg(set_.alias(held))
    words = stored(spark, words, "bitmap")
    marked = df.withColumn(place, spot(df_key)).join(F.broadcast(words), F.shiftright(place, 6) == F.col(word), "left")
    bit = F.call_function("shiftright", F.coalesce(held, F.lit(0).cast("long")), F.col(place).bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    drop = lambda x: x.drop(place, word, held)
    return drop(marked.filter(bit)), drop(marked.filter(~bit))
