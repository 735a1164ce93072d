"""Global order without a single-task window.

``Window.orderBy`` with no partition moves the whole table to one task. Here rows
are range-partitioned on the order, each range is numbered by itself, and the
totals of the ranges (one row per partition) are prefix-summed and added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.plans.scratch import stored

PART = "__range"


def dealt(df: DataFrame, order: Sequence[Column], name: str = "ranges") -> DataFrame:
    """``df`` written in ranges of ``order``, which ``PART`` numbers: a key that most rows share lies in several, side by side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(spark, df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), name)


def carried(ranges: DataFrame, key: str, value: Column) -> DataFrame:
    """(PART, key, carry): the largest ``value`` that the key has in earlier ranges, where it has one.

    Only keys that begin in an earlier range are among them: one a range at most, as ranges follow the key.
    """
    tops = ranges.groupBy(PART, key).agg(F.max(value).alias("__top"))
    before = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return tops.select(PART, key, F.max("__top").over(before).alias("carry")).filter("carry IS NOT NULL")


def ranked(
    spark: SparkSession,
    df: DataFrame,
    order: Sequence[Column],
    rank: str = "rank",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """``df`` with its 0-based position in ``order`` and, for each ``sums[new] = column``, the total of
    ``column`` over the rows before (exclusive prefix sum).

    ``order`` should be total (end in a key): a hot value is then split over several ranges. Rows that tie
    keep one arbitrary order per run. The ranges are written once, so a recomputed task sees the same rows.
    """
    sums = sums or {}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(spark, df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")
    totals = [F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__s_{k}") for k, c in sums.items())]
    # one row per range: as many as there are shuffle partitions, whatever the input
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.groupBy(PART)
        .agg(*totals)
        .select(
            PART,
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"),
            *(F.coalesce(F.sum(f"__s_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in sums),
        )
    )
    within = Window.partitionBy(PART).orderBy(*order)
    ahead = within.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.withColumn(rank, F.row_number().over(within) - 1)
        .withColumns({k: F.coalesce(F.sum(c).over(ahead), F.lit(0)) for k, c in sums.items()})
        .join(F.broadcast(starts), PART)
        .withColumns({rank: F.col(rank) + F.col("__n"), **{k: F.col(k) + F.col(f"__s_{k}") for k in sums}})
        .drop(PART, "__n", *(f"__s_{k}" for k in sums))
    )
