"""An extension: interval requests against a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators.overlap import overlap_join


def stream_overlap(stream: DataFrame, requests: DataFrame) -> DataFrame:
    """Each arriving record once for each request that it meets: a stateless join with a static, broadcast side."""
    return overlap_join(stream, requests, "broadcast")


def windowed_hits(stream: DataFrame, requests: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Hits of each request by event-time window; records later than ``late`` are dropped by the watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a point in time
    hits = stream_overlap(timed.withWatermark(time, late), requests)
    return hits.groupBy(F.window(time, window).alias("window"), "ordinal").agg(F.count(F.lit(1)).alias("n"))
