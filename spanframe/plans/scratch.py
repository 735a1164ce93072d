"""Intermediate tables in the folder that every executor shares.

A written table cuts lineage and survives a lost executor: a later stage rereads
the files instead of recomputing them from the input.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: The tables that this process has written and not released.
_made: list[str] = []


def stored(spark: SparkSession, df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back; ``bucket`` partitions it by a column."""
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(bucket) if bucket else df.write
    _made.append(path)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the tables written after the mark ``since``, but for those that ``kept`` read: nothing else may need them any more."""
    bare = lambda path: path.split(":", 1)[-1].lstrip("/")
    used = {bare(name.rsplit("/", 1)[0]) for df in kept for name in df.inputFiles()} & set(map(bare, _made))
    if len(used) < len(kept):
        return  # what is kept can't be told from the rest
    gone = [path for path in _made[since:] if bare(path) not in used]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)
