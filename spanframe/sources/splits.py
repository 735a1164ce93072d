"""Block archives in splits of a file: block discovery, range reads and writing, all of it in tasks.

Where a block begins depends on the one before it, in reading as in writing, so a split alone
can't know. Each split follows every way in that its first bytes leave open and says
where it leaves the split by each: a function from ways in to ways out. The functions are
composed in the order of splits, from the file's begin; what is true of each split follows
from its way in. Only this composition runs on the driver, over a row or a few a split as
they stream by.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.operators.asof import asof_join
from spanframe.plans.scratch import shared_dir, stored
from spanframe.sources.bgzf import EOF_BLOCK, MOST_INFLATED, PAYLOAD, BlockError, deflate, header_size, inflate
from spanframe.sources.store import Joined, listed, local, opened, size_of, written

#: Bytes of a split; no less than a member or a payload has at most.
SPLIT = 64 << 20
LEAST = 65536
MEMBERS = "split long, chain int, coffset long, csize long, usize long, marker boolean, entry boolean, exit long, error string"


def _splits(spark: SparkSession, size: int, split: int) -> DataFrame:
    """(split): one row and one task each."""
    if split < LEAST:
        raise ValueError(f"a split has {LEAST} bytes at least")
    n = -(-size // split)
    return spark.range(0, n, 1, max(1, n)).withColumnRenamed("id", "split")


def _member(f: Joined, at: int) -> tuple[int, int, bool]:
    """(size, content size, whether it is the end marker) of the member at ``at``, from its header and trailer."""
    f.seek(at)
    head = f.read(18)
    if len(head) >= 12:
        extra = struct.unpack_from("<H", head, 10)[0]
        if extra > 6:
            head += f.read(12 + extra - len(head))
    _, size = header_size(head)
    if at + size > f.size:
        raise BlockError("the file is cut off")
    f.seek(at + size - 4)
    usize = struct.unpack("<I", f.read(4))[0]
    marker = False
    if usize == 0 and size == len(EOF_BLOCK):
        f.seek(at)
        marker = f.read(size) == EOF_BLOCK
    return size, usize, marker


def chains(f: Joined, split: int, begin: int, end: int) -> Iterator[tuple]:
    """Rows of ``MEMBERS``: for every place at which a member may begin, the members from there on, up to the split's end.

    A way in that lies on a chain found before is that chain's; the row with ``exit`` says where a chain leaves the
    split, or why it breaks off.
    """
    reach = min(begin + LEAST, end)
    f.seek(begin)
    window = f.read(reach - begin + 3)
    ways, at = [], -1
    while begin and 0 <= (at := window.find(b"\x1f\x8b\x08\x04", at + 1)):
        ways.append(begin + at)
    known: dict[int, tuple[int, int, bool]] = {}
    number = 0
    for way in ways if begin else [0]:
        if way in known:
            continue
        at, error = way, None
        while at < end:
            if at not in known:
                try:
                    known[at] = _member(f, at)
                except BlockError as e:
                    error = f"{e} (at {at})"
                    break
            size, usize, marker = known[at]
            yield split, number, at, size, usize, marker, at < reach, None, None
            at += size
        if error and at == way and begin:
            continue  # no member begins here
        yield split, number, None, None, None, None, None, at, error
        number += 1


def members(spark: SparkSession, path: str | Joined, split: int = SPLIT) -> DataFrame:
    """(split, coffset, csize, usize, marker) of all members of an archive, found in its splits."""
    source = Joined.of(path) if isinstance(path, str) else path
    names = [x.split()[0] for x in MEMBERS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = []
                for row in chains(source, k, k * split, min((k + 1) * split, source.size)):
                    rows.append(row)
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    found = stored(spark, _splits(spark, source.size, split).mapInArrow(run, MEMBERS), "members")
    # the composition: a handful of rows a split
    true, at, now, owner, ends = [], 0, -1, {}, {}

    def settle() -> None:
        nonlocal at
        if now < 0 or at >= min((now + 1) * split, source.size):
            return
        if at not in owner:
            raise BlockError(f"not a blocked gzip member (at {at})")
        chain = owner[at]
        leave, error = ends[chain]
        if error:
            raise BlockError(error)
        true.append((now, chain, at))
        at = leave

    for r in found.filter("entry OR exit IS NOT NULL").select("split", "chain", "coffset", "exit", "error").orderBy("split").toLocalIterator():
        if r.split != now:
            settle()
            now, owner, ends = r.split, {}, {}
        if r.coffset is not None:
            owner.setdefault(r.coffset, r.chain)
        else:
            ends[r.chain] = (r.exit, r.error)
    settle()
    if at < source.size:
        raise BlockError(f"not a blocked gzip member (at {at})")
    ways = spark.createDataFrame(true, "split long, chain int, way long")
    return found.filter("coffset IS NOT NULL").join(F.broadcast(ways), ["split", "chain"]).filter("coffset >= way").select("split", "coffset", "csize", "usize", "marker")


def numbered(parts: DataFrame, by: str, order: str, sums: dict[str, str], number: str) -> DataFrame:
    """Rows with their number and prefix sums over all groups ``by`` in order: totals of groups are summed, then rows in each."""
    totals = parts.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    ahead = totals.select(by, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__n", *(f"__{k}" for k in sums))))
    inside = Window.partitionBy(by).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumns({number: F.row_number().over(inside) - 1, **{k: F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in sums.items()}})
    return own.join(ahead, by).withColumns({number: F.col(number) + F.col("__n"), **{k: F.col(k) + F.col(f"__{k}") for k in sums}}).drop("__n", *(f"__{k}" for k in sums))


def manifest(spark: SparkSession, path: str | Joined, policy: str = "strict", split: int = SPLIT) -> DataFrame:
    """(block_no, coffset, csize, uoffset, usize) of the data blocks, as ``bgzf.manifest`` gives them; what the policy forbids raises."""
    found = members(spark, path, split)
    seen = found.agg(
        F.count_if(F.col("usize") == 0).alias("empty"), F.count_if((F.col("usize") == 0) & ~F.col("marker")).alias("other"),
        F.max("usize").alias("most"), F.max_by("usize", "coffset").alias("last"),
    ).first()
    if (seen.most or 0) > MOST_INFLATED:
        raise BlockError("a member inflates to more than 64 KiB")
    if policy == "strict" and seen.other:
        raise BlockError("an empty block that is not the end marker")
    if seen.last is None or seen.last:
        raise BlockError("data follows the end marker" if seen.empty and policy == "strict" else "the end marker is missing")
    if policy == "strict" and seen.empty > 1:
        raise BlockError("data follows the end marker")
    blocks = numbered(found.filter("usize > 0"), "split", "coffset", {"uoffset": "usize"}, "block_no")
    return blocks.select(*(F.col(c).cast("long").alias(c) for c in ("block_no", "coffset", "csize", "uoffset", "usize")))


def read_ranges(spark: SparkSession, path: str, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, block_no, data) for ``asked`` (id, offset, size; a null size reads to the end): the content, in pieces of a block each.

    An as-of join finds the first and the last block of each range, an equal join those between; pieces are
    dealt by their place in the file, so a task inflates neighbouring blocks, each once for all ranges.
    """
    begin = asked.filter("size IS NULL OR size > 0").select("id", F.col("offset").alias("low"), F.coalesce(F.col("offset") + F.col("size"), F.lit(1 << 62)).alias("high"))
    starts = blocks.select(F.col("uoffset").alias("at"), "block_no")
    first = asof_join(begin.withColumn("at", F.col("low")), starts, "at").withColumnRenamed("block_no", "first").drop("at")
    last = asof_join(first.withColumn("at", F.col("high") - 1), starts, "at").withColumnRenamed("block_no", "last").drop("at")
    met = last.withColumn("block_no", F.explode(F.sequence("first", "last"))).join(blocks, "block_no")
    piece = met.select("id", "block_no", "coffset", "csize", F.greatest(F.col("low") - F.col("uoffset"), F.lit(0)).alias("skip"), (F.least(F.col("high") - F.col("uoffset"), F.col("usize"))).alias("stop")).filter("skip < stop")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = piece.repartitionByRange(n, "coffset", "id").sortWithinPartitions("coffset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data = -1, b""
        with opened(path) as f:
            for batch in batches:
                out, size, done = [], 0, 0
                rows = list(zip(*(c.to_pylist() for c in batch.columns[2:])))
                for k, (coffset, csize, skip, stop) in enumerate(rows):
                    if coffset != now:
                        f.seek(coffset)
                        now, data = coffset, inflate(f.read(csize))
                    out.append(data[skip:stop])
                    size += stop - skip
                    if size > 8 << 20 or k + 1 == len(rows):
                        yield pa.RecordBatch.from_arrays([batch.column(0)[done : k + 1], batch.column(1)[done : k + 1], pa.array(out, pa.binary())], names=["id", "block_no", "data"])
                        out, size, done = [], 0, k + 1

    return dealt.mapInArrow(run, f"id {dict(asked.dtypes)['id']}, block_no long, data binary")


def _line_ends(f: Joined, begin: int, end: int) -> np.ndarray:
    """The places behind line feeds in [begin, end), ascending."""
    found, at = [np.zeros(0, np.int64)], begin
    f.seek(begin)
    while at < end:
        part = f.read(min(16 << 20, end - at))
        found.append(np.flatnonzero(np.frombuffer(part, np.uint8) == 10).astype(np.int64) + at + 1)
        at += len(part)
    return np.concatenate(found)


def _next_cut(x: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Where the payloads that begin at ``x`` end: behind the last line feed within reach, or else at their full size."""
    full = x + PAYLOAD
    place = np.searchsorted(ends, full, side="right") - 1
    line = np.where(place >= 0, ends[np.maximum(place, 0)], 0) if len(ends) else np.zeros(len(x), np.int64)
    return np.where(full > size, size, np.where(line > x, line, full))


def cut_ways(f: Joined, split: int, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(split, low, high, exit): where payloads that begin first in the split, in [low, high], leave it.

    A payload begins behind a line feed, or behind a full payload without one.
    """
    back = max(0, begin - PAYLOAD)
    ends = _line_ends(f, back, min(end + PAYLOAD, f.size))
    ways = np.zeros(1, np.int64)
    if begin:
        spots = np.arange(begin, min(begin + PAYLOAD, end))
        place = np.searchsorted(ends, spots, side="right") - 1
        last = np.where(place >= 0, ends[np.maximum(place, 0)], back) if len(ends) else np.full(len(spots), back)
        known = place >= 0
        ways = spots[(known & (last == spots)) | (spots - last >= PAYLOAD)]
    if not len(ways):
        return
    exits, which = ways.copy(), np.arange(len(ways))
    while (inside := exits < end).any():
        exits[inside] = _next_cut(exits[inside], ends, f.size)
        exits, back_to = np.unique(exits, return_inverse=True)  # ways that have met go on as one
        which = back_to[which]
    out = exits[which]
    opens = np.flatnonzero(np.concatenate(([True], out[1:] != out[:-1])))
    for a, b in zip(opens.tolist(), [*opens[1:].tolist(), len(out)]):
        yield split, int(ways[a]), int(ways[b - 1]), int(out[a])


def plan_cuts(spark: SparkSession, source: Joined, text: bool = True, split: int = SPLIT) -> list[tuple[int, int, int]]:
    """(split, first cut, end of its last payload) for each split in which a payload begins."""
    if not text:
        firsts = [(k, -(-k * split // PAYLOAD) * PAYLOAD) for k in range(-(-source.size // split))]
        return [(k, a, min(-(-min((k + 1) * split, source.size) // PAYLOAD) * PAYLOAD, source.size)) for k, a in firsts if a < min((k + 1) * split, source.size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = list(cut_ways(source, k, k * split, min((k + 1) * split, source.size)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["split", "low", "high", "leave"])

    found = stored(spark, _splits(spark, source.size, split).mapInArrow(run, "split long, low long, high long, leave long"), "cuts")
    out, at, now = [], 0, -1
    for r in found.orderBy("split", "low").toLocalIterator():
        if r.split > now and r.low <= at <= r.high:
            out.append((r.split, at, r.leave))
            at, now = r.leave, r.split
    if at != source.size:
        raise BlockError("the source changed while it was read")
    return out


def write_parts(spark: SparkSession, source: Joined, folder: str, level: int = 6, text: bool = True, split: int = SPLIT) -> DataFrame:
    """Deflate a source in its splits: files ``part-N`` whose contents, in order and with the end marker behind them, are the archive.

    Beside each lies ``sizes-N``, the sizes of its blocks. (split, n, bytes_in, bytes_out), a row a file.
    """
    planned = plan_cuts(spark, source, text, split)
    asked = spark.createDataFrame(planned, "split long, first long, last long").repartitionByRange(max(1, len(planned)), "split")
    plain = local(folder)
    if plain is not None:
        os.makedirs(plain, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, at, stop in zip(*(c.to_pylist() for c in batch.columns)):
                sizes: list[tuple[int, int]] = []

                def packed(at=at, stop=stop, sizes=sizes) -> Iterator[bytes]:
                    while at < stop:
                        source.seek(at)
                        part = source.read(PAYLOAD)
                        if text and len(part) == PAYLOAD:
                            part = part[: part.rfind(b"\n") + 1] or part
                        member = deflate(part, level)
                        sizes.append((len(member), len(part)))
                        at += len(part)
                        yield member

                n_out = written(f"{folder}/part-{k:010d}", packed())
                written(f"{folder}/sizes-{k:010d}", [np.array(sizes, "<u4").tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (k, len(sizes), stop - at, n_out)], names=["split", "n", "bytes_in", "bytes_out"])

    return stored(spark, asked.mapInArrow(run, "split long, n long, bytes_in long, bytes_out long"), "packed")


def write_archive(spark: SparkSession, source: Joined, path: str, level: int = 6, text: bool = True, force: bool = False, split: int = SPLIT, index: str | None = None) -> dict[str, int]:
    """Write an archive and its block index (beside it, or at ``index``) at a path that driver and tasks share; tasks copy the parts to their places.

    What comes to the driver is a row a split. Both files are staged and renamed together.
    """
    if not 0 <= level <= 9:
        raise ValueError("compression levels are 0 to 9")
    if local(path) is None:
        raise ValueError("one file is assembled on a mounted file system; elsewhere write_parts leaves the parts")
    path = local(path)
    index = index or f"{path}.gzi"
    if os.path.abspath(index) == os.path.abspath(path):
        raise ValueError("the archive and its index have one name")
    for name in (path, index):
        if os.path.exists(name) and (not force or not os.path.isfile(name)):
            raise FileExistsError(name)
    if os.path.exists(path) and any(local(p) is not None and os.path.samefile(local(p), path) for p, _ in source.parts):
        raise ValueError("input and output are the same file")
    folder = f"{shared_dir(spark)}/scratch/parts-{uuid.uuid4().hex}"
    made = write_parts(spark, source, folder, level, text, split).orderBy("split").collect()
    places, n, n_in, n_out = [], 0, 0, 0
    for r in made:
        places.append((r.split, n, n_in, n_out))
        n, n_in, n_out = n + r.n, n_in + r.bytes_in, n_out + r.bytes_out
    staged = [f"{path}.staged", f"{index}.staged"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block, at_in, at_out in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(f"{folder}/sizes-{k:010d}") as f:
                    sizes = np.frombuffer(f.read(), "<u4").reshape(-1, 2).astype(np.uint64)
                begins = np.concatenate(([[0, 0]], np.cumsum(sizes, axis=0)[:-1])).astype("<u8") + np.array([at_out, at_in], "<u8")
                with open(staged[1], "r+b") as out:  # the first block of a file is not in its index
                    out.seek(8 + 16 * max(0, block - 1))
                    out.write(begins[block == 0 :].tobytes())
                with opened(f"{folder}/part-{k:010d}") as f, open(staged[0], "r+b") as out:
                    out.seek(at_out)
                    while part := f.read(4 << 20):
                        out.write(part)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64())], names=["split"])

    try:
        for name, size in zip(staged, (n_out + len(EOF_BLOCK), 8 + 16 * max(0, n - 1))):
            with open(name, "wb") as out:
                out.truncate(size)
        asked = spark.createDataFrame(places, "split long, block long, at_in long, at_out long").repartitionByRange(max(1, len(places)), "split")
        asked.mapInArrow(place, "split long").count()
        with open(staged[0], "r+b") as out:
            out.seek(n_out)
            out.write(EOF_BLOCK)
        with open(staged[1], "r+b") as out:
            out.write(struct.pack("<Q", max(0, n - 1)))
        for a, b in zip(staged, (path, index)):
            os.replace(a, b)
    finally:
        for name in staged:
            if os.path.exists(name):
                os.remove(name)
        folder_at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        folder_at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder_at, True)
    return {"bytes_in": n_in, "bytes_out": n_out + len(EOF_BLOCK), "blocks": n}


def inflate_file(spark: SparkSession, path: str, output: str, policy: str = "strict", split: int = SPLIT) -> dict[str, int]:
    """The content of an archive as a file at a path that driver and tasks share: tasks write their blocks to their places.

    The file takes its name when it is whole.
    """
    blocks = stored(spark, manifest(spark, path, policy, split), "blocks")
    size = blocks.agg(F.max(F.col("uoffset") + F.col("usize"))).first()[0] or 0
    n = max(1, -(-size_of(path) // split))
    staged = f"{local(output)}.staged"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with opened(path) as f, open(staged, "r+b") as out:
            for batch in batches:
                for coffset, csize, uoffset in zip(*(c.to_pylist() for c in batch.columns)):
                    f.seek(coffset)
                    out.seek(uoffset)
                    done += out.write(inflate(f.read(csize)))
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    try:
        with open(staged, "wb") as out:
            out.truncate(size)
        asked = blocks.select("coffset", "csize", "uoffset").repartitionByRange(n, "coffset").sortWithinPartitions("coffset")
        if (asked.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0) != size:
            raise BlockError("the archive changed while it was read")
        os.replace(staged, local(output))
    finally:
        if os.path.exists(staged):
            os.remove(staged)
    return {"bytes_out": size}


def write_lines(lines: DataFrame, order: list, path: str, line: str = "raw") -> Joined:
    """Lines as a folder of text files that hold them in ``order``, part after part; the folder takes its name when it is whole."""
    spark = lines.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select(line).write.text(staged, lineSep="\n")
    to = spark._jvm.org.apache.hadoop.fs.Path
    store = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(to(path)) or not store.rename(to(staged), to(path)):
        store.delete(to(staged), True)
        raise FileExistsError(path)
    return Joined(listed(path))


__all__ = ["chains", "cut_ways", "inflate_file", "manifest", "members", "numbered", "plan_cuts", "read_ranges", "size_of", "write_archive", "write_lines", "write_parts"]
