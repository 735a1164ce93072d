"""Requests as tables: both grammars as column expressions, for any number of requests.

What can't be read is a row with an ``error`` and no reference, not an exception; ``raise_first`` turns the first
into one. The rules are those of ``regions``, which reads single requests on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.coords import LONG_MAX
from spanframe.functions.regions import RegionError

LAST_COLON = r"(?s)\A(.*):([^:]*)\z"
GROUPED = r"\A([0-9]{1,3}(,[0-9]{3})+|[0-9]+)\z"
RANGE = r"\A[0-9,]+(-[0-9,]*)?\z"
ULONG_MAX = (1 << 64) - 1


def _number(text: Column) -> Column:
    """The value of digits and commas, null beyond 38 digits."""
    plain = F.regexp_replace(F.regexp_replace(text, ",", ""), r"\A0+(?=[0-9])", "")
    return F.when(plain.rlike(r"\A[0-9]{1,38}\z"), plain.cast("decimal(38,0)"))


def _parted(df: DataFrame, span: str) -> DataFrame:
    """Low, dash and high of a range's text, whose dash is its first."""
    dash = F.instr(span, "-")
    low = F.when(dash > 0, F.substring_index(span, "-", 1)).otherwise(F.col(span))
    return df.withColumns({"__low": low, "__dash": dash > 0, "__high": F.when(dash > 0, F.substring(F.col(span), dash + 1, F.length(span))).otherwise(F.lit(""))})


def parse_regions(requests: DataFrame, region: str = "region") -> DataFrame:
    """``requests`` with ref, start, end (1-based inclusive; null is open) and error, of the interval grammar."""
    colon = F.col(region).contains(":")
    df = requests.withColumns({"__name": F.when(colon, F.regexp_extract(region, LAST_COLON, 1)).otherwise(F.col(region)), "__span": F.when(colon, F.regexp_extract(region, LAST_COLON, 2))})
    df = _parted(df, "__span").withColumns({"__a": _number(F.col("__low")), "__b": _number(F.col("__high"))})
    far = lambda text, value: (F.col(text) != "") & (F.col(value).isNull() | ~F.col(value).between(1, LONG_MAX))
    wrong = lambda text: (F.col(text) != "") & ~F.col(text).rlike(GROUPED)
    start = F.when(F.coalesce("__low", F.lit("")) == "", F.lit(1)).otherwise(F.col("__a")).cast("long")
    end = F.when(F.col("__dash"), F.col("__b")).when(F.col("__span").isNotNull(), F.col("__a")).cast("long")
    error = (
        F.when(F.col(region).isNull(), "no request")
        .when((F.col("__name") == "") | F.col("__name").rlike(r"[\x00\t\n\r]"), "invalid reference name")
        .when(F.col("__span") == "", "nothing after the colon")
        .when(wrong("__low"), "invalid position").when(far("__low", "__a"), "position out of range")
        .when(wrong("__high"), "invalid position").when(far("__high", "__b"), "position out of range")
        .when(F.col("__b") < F.coalesce("__a", F.lit(1)), "ends before it begins")
    )
    df = df.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    return df.select(*requests.columns, good(F.col("__name")).alias("ref"), good(start).alias("start"), good(end).alias("end"), "error")


def resolve_regions(requests: DataFrame, index: DataFrame, request: str = "request") -> DataFrame:
    """``requests`` with ref, start, end (0-based half-open, clipped) and error, of the sequence grammar, by an index (name, length).

    The whole request may be a name, or a name with a range; both are looked up by equal joins, and if it can be both,
    braces around the name have to say which.
    """
    braced = F.col(request).startswith("{")
    close = F.instr(request, "}")
    inside = F.when(close > 0, F.substring(F.col(request), F.lit(2), close - 2))
    rest = F.when(close > 0, F.substring(F.col(request), close + 1, F.length(request)))
    colon = F.col(request).contains(":")
    df = requests.withColumns({
        "__open": braced & (close.isNull() | (close == 0) | ((rest != "") & ~rest.startswith(":"))), "__braced": braced,
        "__name": F.when(braced, inside).when(colon, F.regexp_extract(request, LAST_COLON, 1)).otherwise(F.col(request)),
        "__span": F.when(braced, F.when(rest != "", F.substring(rest, F.lit(2), F.length(rest)))).when(colon, F.regexp_extract(request, LAST_COLON, 2)),
        "__whole": F.when(~braced & colon, F.col(request)),
    })
    df = df.join(index.select(F.col("name").alias("__name"), F.col("length").alias("__length")), "__name", "left")
    df = df.join(index.select(F.col("name").alias("__whole"), F.col("length").alias("__all")), "__whole", "left")
    whole = F.col("__all").isNotNull()
    two = whole & F.col("__length").isNotNull() & F.col("__span").rlike(RANGE)
    df = df.withColumns({"__span": F.when(~whole, F.col("__span")), "__name": F.when(whole, F.col("__whole")).otherwise(F.col("__name")), "__length": F.coalesce("__all", "__length"), "__two": two})
    df = _parted(df, "__span").withColumns({"__a": _number(F.col("__low")), "__b": _number(F.col("__high"))})
    wrong = lambda text, value: (F.col(text) != "") & (~F.regexp_replace(text, ",", "").rlike(r"\A[0-9]+\z") | F.col(value).isNull() | (F.col(value) > F.lit(str(ULONG_MAX)).cast("decimal(38,0)")))
    error = (
        F.when(F.col(request).isNull(), "no request").when(F.col("__open"), "unbalanced braces").when(F.coalesce("__two", F.lit(False)), "two readings")
        .when(F.col("__length").isNull(), "no sequence").when(wrong("__low", "__a"), "invalid position")
        .when((F.col("__low") == "") & ~F.col("__dash"), "nothing after the colon").when(F.col("__a") == 0, "position 0")
        .when(wrong("__high", "__b"), "invalid position").when(F.coalesce("__a", F.lit(1)) > F.col("__b"), "ends before it begins")
    )
    first = F.least(F.coalesce("__a", F.lit(1)) - 1, F.col("__length")).cast("long")
    end = F.least(F.coalesce("__b", F.col("__length")), F.col("__length")).cast("long")
    df = df.withColumns({"error": error, "__first": first, "__end": end})
    good = lambda c: F.when(F.col("error").isNull(), c)
    return df.select(*requests.columns, good(F.col("__name")).alias("ref"), good(F.col("__first")).alias("start"), good(F.greatest("__first", "__end")).alias("end"), "error")


def raise_first(requests: DataFrame, order: str = "ordinal") -> DataFrame:
    """The requests, if all of them can be read; else the first error in order raises."""
    bad = requests.filter("error IS NOT NULL").orderBy(order).first()
    if bad:
        raise RegionError(f"request {bad[order]}: {bad['error']}")
    return requests.drop("error")
