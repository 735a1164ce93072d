"""Sharding by longest-processing-time scheduling.

Groups that must stay together (here equal texts) are taken from the largest to
the smallest; each goes to the least-loaded shard of a heap. The heap needs only
the sizes: groups of one size are interchangeable, so the driver runs it over
(size, number of groups) pairs, of which n bytes have fewer than sqrt(2 n). Which
group of a size is which is settled by its rank among them, computed over range
partitions; neither groups nor documents ever come together in one place.

Defined cases: null texts form one group of size 1 a row, equal to no text; an
empty table gives no rows; repeated rows stay with their group; a group larger
than a fair share stays whole, and the other shards share the rest; a text of any length
is a size and a hash; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice, tee

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.plans.ordering import ranked
from spanframe.plans.scratch import shared_dir, stored


def lpt(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For (size, count) pairs, the largest size first: how many groups of that size each shard gets.

    Equal sizes go to the least-loaded shard again and again; the lower shard wins a tie. Long runs of a
    size are poured up to a common level at once, which leaves fewer groups than shards for the heap.
    """
    loads = [0] * shards
    for size, count in classes:
        given, left = [0] * shards, count
        if left > 4 * shards:
            low, high = 0, max(loads) + size * count
            fits = lambda level: [max(0, -(-(level - load) // size)) for load in loads]  # noqa: E731  starts below the level
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if sum(fits(middle)) <= left else (low, middle - 1)
            given = fits(low)
            left -= sum(given)
        heap = [(load + n * size, k) for k, (load, n) in enumerate(zip(loads, given))]
        heapq.heapify(heap)
        for _ in range(left):
            load, k = heap[0]
            given[k] += 1
            heapq.heapreplace(heap, (load + size, k))
        loads = [load + n * size for load, n in zip(loads, given)]
        yield size, given


PLANNED = 50_000  # rows of the plan that the driver holds at once


def planned(spark: SparkSession, classes: Iterable[tuple[int, int, int]], shards: int) -> DataFrame:
    """(load, first, ends) for (size, count, first place), the largest size first: the places at which each shard's groups of a size end, from its first.

    The heap runs as the sizes stream by; what it says is written in parts.
    """
    path = f"{shared_dir(spark)}/scratch/plan-{uuid.uuid4().hex}"
    kinds = pa.schema([("load", pa.int64()), ("first", pa.int64()), ("ends", pa.list_(pa.int64()))])
    classes, again = tee(classes)
    rows = ((size, first, list(accumulate(given))) for (_, _, first), (size, given) in zip(again, lpt(((size, n) for size, n, _ in classes), shards)))
    spark.createDataFrame(kinds.empty_table()).write.parquet(path)
    while part := list(islice(rows, PLANNED)):
        table = pa.table([pa.array(c, t) for c, t in zip(zip(*part), kinds.types)], schema=kinds)
        spark.createDataFrame(table).write.mode("append").parquet(path)
    return spark.read.schema("load long, first long, ends array<long>").parquet(path)


def shard(spark: SparkSession, docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of ``docs``; slots are gapless in each shard."""
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(F.col(text), 256), F.lit("")).alias("together"),
    )
    rows = stored(spark, rows, "sized")
    groups = rows.groupBy("together").agg(F.sum("size").alias("load"))
    groups = stored(spark, ranked(spark, groups, [F.col("load").desc(), F.col("together")], "place"), "groups")
    classes = groups.groupBy("load").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    plan = planned(spark, ((r.load, r.n, r.first) for r in classes.orderBy(F.desc("load")).toLocalIterator()), shards)
    placed = groups.join(plan, "load").select("together", F.size(F.filter("ends", lambda end: end <= F.col("place") - F.col("first"))).alias("shard"))
    rows = rows.join(placed, "together").select("key", "size", "text_crc32", "shard")
    rows = ranked(spark, rows, [F.col("shard"), F.col("key"), F.col("size"), F.col("text_crc32")], "place")
    rows = stored(spark, rows, "placed")
    begins = rows.groupBy("shard").agg(F.min("place").alias("begin"))  # one row a shard
    return rows.join(F.broadcast(begins), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - F.col("begin")).alias("slot")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(spark, docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
