"""Plain text by physical lines, numbered in file order without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def peek(spark: SparkSession, path: str, n: int, from_end: bool = False) -> bytes:
    """The first (or last) ``n`` bytes of a file on any file system of Spark's, read by the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        n = min(n, size)
        stream.seek(size - n if from_end else 0)
        return bytes(stream.readByte() & 0xFF for _ in range(n))
    finally:
        stream.close()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, line_no, raw) of one file; ``raw`` has no line feed but keeps a carriage return.

    Spark reads a file in splits, in each of which lines come in order. Their numbers are the lines of the
    splits before (one small row a split, counted in a first pass) plus the place in the split, so the lines
    themselves never move. Bytes that are not UTF-8 stay as they are in the string.
    """
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("raw"))
    order = Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("__split").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    starts = splits.select("__split", "__first", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__lines"))
    place = F.col("__lines") + F.col("__at") - F.col("__first")
    return raw.join(F.broadcast(starts), "__split").select(place.alias("record_id"), (place + 1).alias("line_no"), "raw")


def header_lines(lines: DataFrame, comment: str, by: str | None = None) -> DataFrame:
    """The comment lines before the first line that is none: of one file, or of each that the column ``by`` names."""
    body = lines.filter(~F.col("raw").startswith(comment))
    first = F.min("record_id").alias("__body")
    ahead = F.col("__body").isNull() | (F.col("record_id") < F.col("__body"))
    heads = lines.filter(F.col("raw").startswith(comment))
    if by is None:
        return heads.crossJoin(F.broadcast(body.agg(first))).filter(ahead).drop("__body")  # one row
    return heads.join(body.groupBy(by).agg(first), by, "left").filter(ahead).drop("__body")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a plain file or, told by its first bytes, of a block archive."""
    from spanframe.sources.archive import bgzf_lines

    if peek(spark, path, 4) == b"\x1f\x8b\x08\x04":
        return bgzf_lines(spark, path)
    return text_lines(spark, path)
