"""Native files end to end: index a block archive, and query it through its index."""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Sequence
from itertools import islice, takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions import coords, records
from spanframe.functions.config import Config, FormatError, detect
from spanframe.functions.regions import RegionError, Request
from spanframe.operators import index as tables
from spanframe.operators.lookup import index_tables, lookup, merged
from spanframe.operators.overlap import query, requests_df
from spanframe.plans.scratch import stored
from spanframe.sources.archive import ROWS_A_BATCH, bgzf_lines, block_starts, lines_between
from spanframe.sources.bgzf import EOF_BLOCK, checked, inflate, members
from spanframe.sources.tabix_codec import Index, Reference, chunks_of, dump, load, merged_chunks

SAMPLE_BYTES = 1 << 20
#: Compressed bytes that a task reads of an indexed file.
TASK_BYTES = 1 << 22
#: Requests that are looked up in the index without a join.
ONE_BY_ONE = 5000


def sample(path: str) -> str:
    """The first MiB of content, cut after its last whole line."""
    out, size = [], 0
    with open(path, "rb") as f:
        for _, member in members(f):
            data = inflate(member)
            out.append(data)
            size += len(data)
            if size >= SAMPLE_BYTES:
                break
    data = b"".join(out)[:SAMPLE_BYTES]
    return (data[: data.rfind(b"\n") + 1] if size >= SAMPLE_BYTES and b"\n" in data else data).decode("latin-1")


def build(spark: SparkSession, path: str, config: Config | None = None, csi: bool = False, min_shift: int = coords.TBI_SHIFT, output: str | None = None, force: bool = False) -> dict:
    """Write the index of a sorted block archive. All per-record work is in Spark; what comes to the driver is bins and windows."""
    output = output or path + (".csi" if csi else ".tbi")
    if os.path.exists(output) and (not force or not os.path.isfile(output)):
        raise FileExistsError(output)
    config = config or detect(path, sample(path))
    declared = max(records.declared_lengths(header(path, config), config), default=None)
    depth = coords.csi_depth(min_shift, config.kind is not None, declared) if csi else coords.TBI_DEPTH
    if not csi:
        min_shift = coords.TBI_SHIFT
    # the archive is read and parsed once; lines are numbered only if the first ones are to be skipped
    lines = bgzf_lines(spark, path, numbered=config.skip > 0)
    parsed = stored(spark, records.records(lines, config).select("record_id", "next_id", "ref", "start", "end"), "parsed")
    tables.validate(parsed, min_shift, depth)
    order = {r["ref"]: Reference(r["ref"]) for r in tables.reference_order(parsed).orderBy("ref_ordinal").toLocalIterator()}
    for r in tables.bin_chunks(parsed, min_shift, depth).orderBy("ref", "bin", "chunk_start").toLocalIterator():
        order[r["ref"]].bins.setdefault(r["bin"], []).append((r["chunk_start"], r["chunk_end"]))
    for r in tables.linear_index(parsed, min_shift).orderBy("ref", "window").toLocalIterator():
        order[r["ref"]].linear.append(r["min_offset"])
    n = 0
    for r in tables.metadata(parsed).toLocalIterator():
        order[r["ref"]].first, order[r["ref"]].last, order[r["ref"]].count = r["first_id"], r["last_id"], r["n"]
        n += r["n"]
    staged = output + ".staged"
    with open(staged, "wb") as f:
        f.write(dump(Index("csi" if csi else "tbi", config, list(order.values()), min_shift, depth)))
    os.replace(staged, output)
    return {"records": n, "references": len(order), "index": output}


def find_index(path: str, index: str | None = None) -> Index:
    """The given index, or the TBI or else the CSI beside the file; one older than the file is an error."""
    found = index or next((path + x for x in (".tbi", ".csi") if os.path.exists(path + x)), None)
    if found is None or not os.path.exists(found):
        raise FileNotFoundError(f"no index for {path}")
    if os.path.getmtime(path) > os.path.getmtime(found):
        raise FormatError(f"{found} is older than {path}")
    with open(found, "rb") as f:
        return load(f.read())


def pieces(path: str, chunks: Sequence[tuple[int, int]], most: int = TASK_BYTES) -> list[tuple[int, int, int, bool]]:
    """(task, begin, end, aligned): chunks (sorted, apart), long ones cut at blocks and short ones packed to ``most`` bytes a task."""
    out, task, held, starts = [], 0, 0, None
    for begin, end in chunks:
        if end < begin:
            raise FormatError("an index chunk ends before it begins")
        cuts = [begin, end]
        if (end >> 16) - (begin >> 16) > most:
            starts = starts or block_starts(path)[0]
            inner = starts[bisect_right(starts, begin >> 16) : bisect_right(starts, end >> 16)]
            for at in inner:
                if at - (cuts[-2] >> 16) >= most and at << 16 < end:
                    cuts.insert(-1, at << 16)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            size = (b >> 16) - (a >> 16) + 65536
            if held and held + size > most + 65536:
                task, held = task + 1, 0
            out.append((task, a, b, k == 0))
            held += size
    return out


def chunk_lines(spark: SparkSession, path: str, chunks: Sequence[tuple[int, int]]) -> DataFrame:
    """(record_id, raw) of the lines that begin in the chunks (sorted, apart), read by seeking to them; chunks that don't fit the file raise."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            with open(path, "rb") as f:
                for begin, end, aligned in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    found = lines_between(f, begin, end, aligned)
                    while rows := list(islice(found, ROWS_A_BATCH)):
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[2].decode("latin-1") for x in rows], pa.string())], names=["record_id", "raw"])

    if not chunks:
        return spark.createDataFrame([], "record_id long, raw string")
    found = pieces(path, chunks)
    asked = spark.createDataFrame(found, "task long, begin long, stop long, aligned boolean").repartitionByRange(found[-1][0] + 1, "task")
    return asked.mapInArrow(run, "record_id long, raw string")


def candidates(spark: SparkSession, index: Index, requests: Sequence[Request]) -> list[tuple[int, int]]:
    """The merged chunks that hold what is asked for: few requests are looked up one by one, more by a join with the index.

    What comes back are stretches of the file that lie apart, no more than the index has chunks.
    """
    if len(requests) <= ONE_BY_ONE:
        by_name = {r.name: r for r in index.references}
        return merged_chunks(c for r in requests for c in chunks_of(index, by_name[r.ref], r.start, r.end))
    found = lookup(requests_df(spark, requests), *index_tables(spark, index), index.min_shift, index.depth).select("chunk_start", "chunk_end").distinct()
    return [(r.chunk_start, r.chunk_end) for r in merged(found, None).orderBy("chunk_start").collect()]


def query_file(
    spark: SparkSession,
    path: str,
    requests: Sequence[Request] | None = None,
    targets: Sequence[Request] | None = None,
    index: str | None = None,
    unique: bool = False,
    separate: bool = False,
) -> DataFrame:
    """The records of an indexed block archive that are asked for. Requests read their candidate chunks only; targets read the file."""
    found = find_index(path, index)
    names = {r.name for r in found.references}
    for asked in (requests or []), (targets or []):
        for r in asked:
            if r.ref not in names:
                raise RegionError(f"no reference named {r.ref}")
    if requests is not None and not requests and targets is None:
        raise RegionError("no region is asked for")
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        size = f.tell()
        f.seek(max(0, size - 2 * len(EOF_BLOCK)))
        tail = f.read()
    if not tail.endswith(EOF_BLOCK) or tail == EOF_BLOCK * 2:
        raise FormatError("the file doesn't end in one end marker")
    if requests is None:
        lines = bgzf_lines(spark, path, numbered=found.config.skip > 0)
    else:
        lines = chunk_lines(spark, path, candidates(spark, found, requests)).withColumn("line_no", F.lit(1 << 62))
    parsed = records.records(lines, found.config)
    # whatever is read has to be a reference of the index
    strange = F.raise_error(F.concat(F.lit("data reference "), F.col("ref"), F.lit(" is not in the index"))).cast("string")
    parsed = parsed.withColumn("ref", F.when(F.col("ref").isin(*sorted(names)), F.col("ref")).otherwise(strange))
    return query(spark, parsed, requests, targets, unique, separate, found.config.comment)


def header(path: str, config: Config) -> list[str]:
    """The comment lines before the first line that is none; what follows is not read."""
    with open(path, "rb") as f:
        lines = (raw.decode("latin-1").removesuffix("\r") for _, _, raw in lines_between(f, 0, None))
        return list(takewhile(lambda line: line.startswith(config.comment), lines))


def references(path: str, index: str | None = None) -> list[str]:
    return [r.name for r in find_index(path, index).references]


__all__ = ["build", "chunk_lines", "checked", "find_index", "header", "query_file", "references", "sample"]
