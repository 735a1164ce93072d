"""Block archives as tables: a data source of blocks and lines, range reads, and a parallel writer.

Runs of blocks come from the block index beside the file, if it is as new as the file, or
else from tasks that find the blocks of their splits (``splits``). A task reads its run by
seeking, yields the lines that begin in its blocks and reads on to finish the last. Paths
have to be visible to driver and executors alike; elsewhere ``inflated``
reads whole files through Spark's own file sources.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanframe.plans.scratch import stored
from spanframe.sources import splits
from spanframe.sources.bgzf import EOF_BLOCK, BlockError, Gzi, inflate, manifest, members, usize
from spanframe.sources.store import Joined, opened

BLOCKS_A_TASK = 1024
BLOCK_SCHEMA = "block_no long, coffset long, csize long, uoffset long, usize long"


ROWS_A_BATCH = 8192


class _Run(InputPartition):
    def __init__(self, number: int, first: int, end: int) -> None:
        self.number, self.first, self.end = number, first, end  # compressed offsets


def block_starts(path: str, policy: str = "strict") -> tuple[list[int], int]:
    """The compressed offsets of the data blocks, and where the last one ends."""
    index = f"{path}.gzi"
    size = os.path.getsize(path)
    with open(path, "rb", buffering=0) as f:
        if policy == "strict" and os.path.exists(index) and os.path.getmtime(index) >= os.path.getmtime(path):
            f.seek(max(0, size - len(EOF_BLOCK)))
            if f.read(len(EOF_BLOCK)) != EOF_BLOCK:
                raise BlockError("the end marker is missing")
            with open(index, "rb") as g:
                starts = [0, *(c for c, _ in Gzi.parse(g.read()).entries)]
            if starts[-1] < size - len(EOF_BLOCK):
                return starts, size - len(EOF_BLOCK)
        found = manifest(f, policy)
    return [b.coffset for b in found], found[-1].coffset + found[-1].csize if found else 0


def lines_between(f: BinaryIO, begin: int, end: int | None, aligned: bool = True, strict: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(position, position after it, line) of the lines that begin in [begin, end), virtual positions; without an end, of all from ``begin`` on.

    If ``begin`` is not ``aligned``, it is a block's and may lie inside a line, which then belongs to what comes before.
    Positions that the file's blocks don't have raise; ``strict`` raises on blocks without content as well.
    """
    skipping = not aligned and not _after_line_end(f, begin >> 16)
    carry, origin, follow, content, last = [], None, begin, begin, 1 << 63 if end is None else end
    for offset, member in members(f, begin >> 16):
        data = inflate(member)
        at, follow = begin & 0xFFFF if offset == begin >> 16 else 0, (offset + len(member)) << 16
        content = follow if data else content
        if not data and strict and follow <= last and end is not None:
            raise BlockError("a block without content before the end marker")
        if at > len(data) or (offset == last >> 16 and last & 0xFFFF > len(data)):
            raise BlockError("a position lies beyond its block")
        if offset < last >> 16 < follow >> 16:
            raise BlockError("a position is not in a block")
        while at < len(data):
            here = (offset << 16) + at
            if origin is None and here >= last:
                return
            stop = data.find(b"\n", at)
            if stop < 0:
                if not skipping:
                    carry.append(data[at:])
                    origin = here if origin is None else origin
                break
            if not skipping:
                line = data[at:stop] if not carry else b"".join([*carry, data[at:stop]])
                yield here if origin is None else origin, follow if stop + 1 == len(data) else (offset << 16) + stop + 1, line
            skipping, carry, origin, at = False, [], None, stop + 1
        if origin is None and follow >= last:
            return
    if end is not None and follow < end:
        raise BlockError("a position lies beyond the file")
    if origin is not None:
        yield origin, content, b"".join(carry)


def _after_line_end(f: BinaryIO, coffset: int) -> bool:
    """Whether the block before ``coffset`` ends a line; members are at most 64 KiB, so it begins in the 64 KiB before."""
    back = min(coffset, 65536)
    f.seek(coffset - back)
    raw = f.read(back)
    for at in range(len(raw)):
        if raw[at : at + 4] == b"\x1f\x8b\x08\x04":
            try:
                parts = [m for _, m in members(io.BytesIO(raw[at:]))]
                data = b"".join(inflate(m) for m in parts)
            except ValueError:
                continue
            if data:
                return data.endswith(b"\n")
    return coffset == 0


class _LineReader(DataSourceReader):
    def __init__(self, path: str, policy: str, per_task: int) -> None:
        self.path, self.policy, self.per_task = path, policy, per_task

    def partitions(self) -> list[_Run]:
        starts, end = block_starts(self.path, self.policy)
        bounds = [*starts[:: self.per_task], end]
        return [_Run(k, a, b) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]

    def read(self, run: _Run) -> Iterator[pa.RecordBatch]:
        if isinstance(run, _Run):
            yield from _lines_of(self.path, self.policy, run.number, run.first, run.end)


LINES = ["record_id", "next_id", "run", "place", "raw"]


def _lines_of(path: str, policy: str, number: int, first: int, end: int) -> Iterator[pa.RecordBatch]:
    with opened(path) as f:
        found, place = lines_between(f, first << 16, end << 16, aligned=False, strict=policy == "strict"), 0
        while rows := list(islice(found, ROWS_A_BATCH)):
            n = len(rows)
            columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([number] * n, pa.int64()), pa.array(range(place, place + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[2].decode("latin-1") for x in rows], pa.string())], names=LINES)
            place += n


class BgzfLines(DataSource):
    """``spark.read.format("bgzf_lines").load(path)``: (record_id, next_id, run, place, raw), ids being virtual positions.

    Without a block index its planner reads all headers of the file; ``bgzf_lines`` finds them in tasks.

    ``next_id`` is the position after the line, ``run`` is the run of blocks in which a line begins and ``place`` its number there, from 0.

    Options: ``policy`` (strict or reference), ``blocksPerTask``.
    """

    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "record_id long, next_id long, run long, place long, raw string"

    def reader(self, schema) -> _LineReader:
        return _LineReader(self.options["path"], self.options.get("policy", "strict"), int(self.options.get("blocksPerTask", BLOCKS_A_TASK)))


def bgzf_lines(spark: SparkSession, path: str, policy: str = "strict", blocks_per_task: int = BLOCKS_A_TASK, numbered: bool = True) -> DataFrame:
    """(record_id, next_id, line_no, raw): the lines of a block archive. Ids are virtual positions, so they order lines as the file does.

    As for plain text, lines are numbered from the counts of the runs before, and don't move. Unless they are
    ``numbered``, which reads the file twice, ``line_no`` is a number beyond any.
    """
    bounds = runs(spark, path, policy, blocks_per_task)
    asked = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))], "number long, first long, stop long").repartitionByRange(max(1, len(bounds) - 1), "number")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _lines_of(path, policy, *run)

    lines = asked.mapInArrow(read, "record_id long, next_id long, run long, place long, raw string")
    if not numbered:
        return lines.select("record_id", "next_id", F.lit(1 << 62).alias("line_no"), "raw")
    order = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    starts = lines.groupBy("run").agg(F.count(F.lit(1)).alias("__n")).select("run", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))
    return lines.join(F.broadcast(starts), "run").select("record_id", "next_id", (F.col("__before") + F.col("place") + 1).alias("line_no"), "raw")


def runs(spark: SparkSession, path: str, policy: str = "strict", blocks_per_task: int = BLOCKS_A_TASK) -> list[int]:
    """Compressed offsets that part an archive into runs of blocks, its data's end included: a number for each task."""
    fresh = os.path.exists(f"{path}.gzi") and policy == "strict" and os.path.getmtime(f"{path}.gzi") >= os.path.getmtime(path)
    if fresh or os.path.getsize(path) <= splits.SPLIT:  # a single split is walked at once
        starts, end = block_starts(path, policy)
        return [*starts[::blocks_per_task], end]
    found = stored(spark, splits.manifest(spark, path, policy), "blocks")
    heads = found.filter(F.col("block_no") % blocks_per_task == 0).select("coffset").orderBy("coffset").collect()
    return [*(r.coffset for r in heads), found.agg(F.max(F.col("coffset") + F.col("csize"))).first()[0] or 0]


def blocks(spark: SparkSession, path: str, policy: str = "strict") -> DataFrame:
    """The manifest: one row for each data block."""
    return splits.manifest(spark, path, policy)


def inflated(spark: SparkSession, path: str, policy: str = "strict") -> DataFrame:
    """(path, block_no, coffset, csize, uoffset, usize, data) of each archive that ``path`` matches, on any file system of Spark's.

    A file is one row on its way, so this suits files of up to a few hundred MB.
    """
    from spanframe.sources.bgzf import checked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "block_no", "coffset", "csize", "uoffset", "usize", "data"]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.binary()]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                uoffset, rows = 0, []
                for k, (offset, member) in enumerate(checked(members(io.BytesIO(content)), policy)):
                    data = inflate(member)
                    rows.append((name, k, offset, len(member), uoffset, len(data), data))
                    uoffset += len(data)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, {BLOCK_SCHEMA}, data binary")


def range_of(blocks_: DataFrame, offset: int, size: int | None = None) -> DataFrame:
    """The blocks that hold content bytes [offset, offset + size), with ``skip`` and ``take`` in each: pruning before inflating."""
    end = F.lit(offset + size) if size is not None else F.lit(1 << 62)
    met = blocks_.filter((F.col("uoffset") < end) & (F.col("uoffset") + F.col("usize") > offset))
    skip = F.greatest(F.lit(offset) - F.col("uoffset"), F.lit(0))
    return met.withColumn("skip", skip).withColumn("take", F.least(end - F.col("uoffset"), F.col("usize")) - F.col("skip"))


def write_bgzf(spark: SparkSession, data: bytes | str, path: str, level: int = 6, text: bool = True, force: bool = False, index: str | None = None) -> dict[str, int]:
    """Write the file at a path (or content at hand) as a block archive with a block index beside it.

    Files are cut, deflated and put together in tasks, split by split. Both files are staged and renamed together.
    """
    if isinstance(data, str):
        return splits.write_archive(spark, Joined.of(data), path, level, text, force, index=index)
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(os.path.abspath(path)), prefix=".content-") as f:
        f.write(data)
        f.flush()
        return splits.write_archive(spark, Joined.of(f.name), path, level, text, force, index=index)


def verify(path: str, policy: str = "strict") -> dict[str, int]:
    """Inflate and check every block."""
    n_in = n_out = n = 0
    from spanframe.sources.bgzf import checked

    with open(path, "rb") as f:
        for _, member in checked(members(f), policy):
            n_out += len(inflate(member))
            n_in += len(member)
            n += 1
    return {"bytes_in": n_in + len(EOF_BLOCK), "bytes_out": n_out, "blocks": n}


__all__ = ["BgzfLines", "bgzf_lines", "blocks", "inflated", "range_of", "usize", "verify", "write_bgzf"]
