"""As-of join: for each row the last row of another table at or before it, over any number of keys.

Both sides are dealt into ranges of (key, place) together; in a range the last row seen is carried along, and
what a range begins with comes from the ranges before, one row a range. A key that most rows share lies in several
ranges, side by side, and no row meets more than one other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.plans.ordering import PART, carried, dealt


def asof_join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = ()) -> DataFrame:
    """All rows of ``left`` with the columns of the row of ``right`` (keys aside) that has the largest ``on`` at or below theirs.

    Rows without such a one keep nulls, as do those whose ``on`` or a key is null. Of rows that tie on the right that with the
    largest values counts. ``left`` may not have columns of the names that come from ``right``.
    """
    value = [c for c in right.columns if c not in (*by, on)]
    key = F.struct(*(F.col(c) for c in by)) if by else F.lit(0)
    whole = F.col(on).isNotNull()
    for c in by:
        whole = whole & F.col(c).isNotNull()
    own, other = F.struct(*(F.col(c) for c in left.columns)), F.struct(F.col(on).alias("__at"), *(F.col(c) for c in value))
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    at = left.schema[on].dataType
    asks = left.filter(whole).select(key.alias("__key"), F.col(on).alias("__on"), F.lit(1).alias("__side"), own.alias("__own"), none(right, other).alias("__other"))
    gives = right.filter(whole).select(key.alias("__key"), F.col(on).cast(at).alias("__on"), F.lit(0).alias("__side"), none(left, own).alias("__own"), other.alias("__other"))
    ranges = dealt(asks.unionByName(gives), [F.col("__key"), F.col("__on"), F.col("__side"), F.xxhash64("__own")], "asof")
    seen = Window.partitionBy(PART, "__key").orderBy("__on", "__side", "__other").rowsBetween(Window.unboundedPreceding, 0)
    last = carried(ranges, "__key", F.col("__other"))
    near = ranges.withColumn("__near", F.last("__other", ignorenulls=True).over(seen)).filter("__side = 1").join(F.broadcast(last), [PART, "__key"], "left")
    found = near.select("__own.*", F.coalesce("__near", "carry").alias("__found"))
    out = found.select(*left.columns, *(F.col("__found")[c].alias(c) for c in value))
    lost = left.filter(~F.coalesce(whole, F.lit(False)))
    return out.unionByName(lost.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in value)))
