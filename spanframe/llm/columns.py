"""Small column helpers of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that a Python worker holds at once: memory stays bounded when texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body (and lambdas in it) refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to ``rows`` and ``size`` bytes, unless they are smaller already.

    The session keeps this: plans run after the operators that made them have returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= size:
        spark.conf.set(name, f"{size}b")
