"""Reference sequences as tables of lines: index, ordered retrieval, digests, dictionaries.

Lines are (ref, ref_ordinal, line_in_ref, byte_offset, bases, width, terminated, seq).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.functions.config import FormatError
from spanframe.functions.coords import LONG_MAX
from spanframe.functions.regions import Slice
from spanframe.functions.sequences import aliases, graphic, is_sam_name, wrap
from spanframe.plans.scratch import stored
from spanframe.sources.bgzf import Gzi, read_range


def build_fai(lines: DataFrame) -> DataFrame:
    """(name, length, offset, line_bases, line_width) in file order; the first line of a sequence sets its layout."""
    first = lambda c: F.min_by(c, "line_in_ref")
    width = F.when(F.col("terminated"), F.col("width")).otherwise(F.col("width") + 1)
    found = lines.withColumn("__width", width).groupBy("ref_ordinal", "ref").agg(
        F.sum("bases").alias("length"), first("byte_offset").alias("offset"), first("bases").alias("line_bases"), first("__width").alias("line_width")
    )
    return found.select(F.col("ref").alias("name"), "length", "offset", "line_bases", "line_width", "ref_ordinal")


def stride_violations(lines: DataFrame) -> DataFrame:
    """The lines that break the layout of their sequence's first line: any but the last has to equal it, the last may be shorter."""
    first = lambda c: F.min_by(c, "line_in_ref")
    layout = lines.groupBy(F.col("ref").alias("__of")).agg(first("bases").alias("__bases"), first("width").alias("__width"), F.max("line_in_ref").alias("__end"))
    laid = lines.join(layout, F.col("ref") == F.col("__of"))
    wrong = F.when(F.col("line_in_ref") == F.col("__end"), F.col("bases") > F.col("__bases")).otherwise((F.col("bases") != F.col("__bases")) | (F.col("width") != F.col("__width")))
    return laid.filter(wrong | (F.col("bases") == 0)).select(*lines.columns)


def validate_fai(fai: DataFrame) -> None:
    """Raise on an index row that no file can have, and on names that come twice."""
    bad = fai.filter((F.col("length") <= 0) | (F.col("line_bases") <= 0) | (F.col("line_bases") > F.col("length")) | ~(F.col("line_width") - F.col("line_bases")).between(0, 2)).first()
    if bad:
        raise FormatError(f"invalid index row for {bad['name']}")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    # two factors of 19 digits fit in 38; a width that needs more is beyond any file by itself
    place = exact("offset") + F.expr("(length - 1) div line_bases").cast("decimal(19,0)") * F.col("line_width").cast("decimal(19,0)") + F.expr("(length - 1) % line_bases").cast("decimal(19,0)")
    far = fai.filter(place.isNull() | (place > F.lit(str(LONG_MAX)).cast("decimal(38,0)"))).first()
    if far:
        raise FormatError(f"the last base of {far['name']} lies beyond any file")
    twice = fai.groupBy("name").count().filter("count > 1").first()
    if twice:
        raise FormatError(f"{twice['name']} is indexed twice")


def parts(spark: SparkSession, lines: DataFrame, slices: DataFrame) -> DataFrame:
    """(ordinal, at, seq): the asked parts line by line; ``at`` counts bases from the part's begin.

    Lines know the bases before them from their place and the sequence's line length, so each part is a range of
    lines. Parts ask for blocks of ``LINES`` lines and meet them in an equal join on (ref, block): a long sequence is
    spread over its blocks, and only lines in a part's range are cut. Few parts are broadcast.
    """
    stride = lines.filter("line_in_ref = 0").select("ref", F.col("bases").alias("__stride"))
    asked = slices.filter("start < end").join(stride, "ref")
    line = lambda at: F.floor(at / F.col("__stride")).cast("long")
    asked = asked.select("ordinal", F.col("ref").alias("__ref"), F.col("start").alias("__from"), F.col("end").alias("__to"), "__stride", line(F.col("start")).alias("__first"), line(F.col("end") - 1).alias("__last"))
    asked = stored(spark, asked, "parts")
    low, high = F.floor(F.col("__first") / LINES), F.floor(F.col("__last") / LINES)
    few = (asked.agg(F.sum(high - low + 1)).first()[0] or 0) <= BROADCAST_PARTS
    asked = asked.withColumn("__block", F.explode(F.sequence(low, high)))
    placed = lines.withColumn("__own", F.floor(F.col("line_in_ref") / LINES))
    inside = (F.col("line_in_ref") >= F.col("__first")) & (F.col("line_in_ref") <= F.col("__last"))
    met = placed.join(F.broadcast(asked) if few else asked, (F.col("ref") == F.col("__ref")) & (F.col("__own") == F.col("__block")) & inside)
    met = met.withColumn("__at", F.col("line_in_ref") * F.col("__stride"))
    skip = F.greatest(F.col("__from") - F.col("__at"), F.lit(0))
    part = F.substring(F.col("seq"), (skip + 1).cast("int"), (F.least(F.col("__to") - F.col("__at"), F.col("bases")) - skip).cast("int"))
    return met.select("ordinal", (F.col("__at") + skip - F.col("__from")).alias("at"), part.alias("seq"))


def slices_df(spark: SparkSession, slices: Sequence[Slice] | DataFrame) -> DataFrame:
    if isinstance(slices, DataFrame):
        return slices
    return spark.createDataFrame([(k, s.header, s.ref, s.start, s.end) for k, s in enumerate(slices)], "ordinal long, header string, ref string, start long, end long")


def _whole(slices: DataFrame, found: DataFrame) -> DataFrame:
    """The slices with all their bases in a row each."""
    joined = found.groupBy("ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return slices.join(joined, "ordinal", "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def fetch(spark: SparkSession, lines: DataFrame, slices: Sequence[Slice] | DataFrame) -> DataFrame:
    """(ordinal, header, ref, start, end, seq): the asked parts (0-based half-open), each in a row. For long ones see ``fasta_rows``."""
    slices = slices_df(spark, slices)
    return _whole(slices, parts(spark, lines, slices))


#: Lines that are asked for together, and the asked blocks up to which they are broadcast: some numbers and a name each.
LINES, BROADCAST_PARTS = 4096, 50_000
PART = 1 << 20


def parts_indexed(spark: SparkSession, path: str, fai: DataFrame, slices: Sequence[Slice] | DataFrame, gzi: bytes | None = None, part: int = PART) -> DataFrame:
    """As ``parts``, but by seeking: the index gives each part's bytes, and only those are read.

    Long requests are cut into parts of ``part`` bases, each read by itself. A block-compressed file needs its
    block index. Line ends have to lie where the index says.
    """
    asked = slices_df(spark, slices)
    begins = F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("end") - 1), F.lit(part).cast("long"))
    cut = asked.filter(F.col("end") > F.col("start")).select("ordinal", "ref", "end", F.explode(begins).alias("a"))
    cut = cut.join(fai.select(F.col("name").alias("ref"), "length", "offset", "line_bases", "line_width"), "ref")
    cut = cut.select("ordinal", "a", F.least(F.col("a") + part, F.col("end")).alias("b"), "length", "offset", "line_bases", "line_width")
    index = Gzi.parse(gzi, "reference") if gzi is not None else None

    def bases(f, a: int, b: int, length: int, offset: int, width: int, stride: int) -> str:
        at = lambda p: offset + p // width * stride + p % width
        # up to the end of the last line, so that its end can be checked too
        first, last = at(a), min(at(b - 1) + 1 + (stride - width if b % width == 0 or b == length else 0), at(length - 1) + 1 + stride - width)
        raw = read_range(f, index, first, last - first) if index is not None else (f.seek(first), f.read(last - first))[1]
        out, place, p = [], 0, a
        while p < b:
            n = min(width - p % width, b - p)
            line, end = raw[place : place + n], raw[place + n : place + n + stride - width]
            whole = (p + n) % width == 0 or p + n == length
            if len(line) != n or any(not 33 <= c <= 126 for c in line) or (whole and p + n < length and end not in (b"", b"\n", b"\r\n")) or (whole and p + n < length and len(end) != stride - width):
                raise FormatError("the index doesn't fit the file")
            out.append(line)
            p, place = p + n, place + n + (stride - width)
        return b"".join(out).decode("latin-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                rows = list(zip(*(c.to_pylist() for c in batch.columns)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bases(f, *r[1:]) for r in rows], pa.string())], names=["ordinal", "a", "seq"])

    found = cut.repartition("ordinal", "a").mapInArrow(run, "ordinal long, a long, seq string")
    return found.join(asked.select("ordinal", "start"), "ordinal").select("ordinal", (F.col("a") - F.col("start")).alias("at"), "seq")


def fetch_indexed(spark: SparkSession, path: str, fai: DataFrame, slices: Sequence[Slice], gzi: bytes | None = None, part: int = PART) -> DataFrame:
    """As ``fetch``, but by seeking, as ``parts_indexed`` does."""
    asked = slices_df(spark, slices)
    return _whole(asked, parts_indexed(spark, path, fai, asked, gzi, part))


def to_fasta(found: DataFrame, fai: DataFrame, width: int | None = None) -> DataFrame:
    """(ordinal, text): header and wrapped bases; without ``width`` the sequence's own line length holds, 0 is one line."""
    if width is None:
        found = found.join(fai.select(F.col("name").alias("__name"), "line_bases"), F.col("ref") == F.col("__name"))
    body = wrap(F.col("seq"), F.col("line_bases") if width is None else width)
    return found.select("ordinal", F.concat(F.lit(">"), "header", F.when(F.col("seq") == "", "").otherwise(F.concat(F.lit("\n"), body))).alias("text"))


#: Bases of a row of ``fasta_rows``, if a line isn't longer.
ROW = 1 << 18


def fasta_rows(slices: DataFrame, found: DataFrame, fai: DataFrame, width: int | None = None, row: int = ROW) -> DataFrame:
    """(ordinal, block, text): the FASTA text of the slices whose parts are ``found``, by rows of whole lines, in this order.

    Where a base goes is known from its place in the slice: lines of ``width`` bases (without it, of the sequence's own
    line length) are dealt into blocks of about ``row`` bases, and each block is put together and wrapped by
    itself. A slice of any length is many rows, none of them longer than a block or a line. Block -1 is the header.
    """
    asked = slices.select("ordinal", "header", "ref")
    if width is None:
        asked = asked.join(fai.select(F.col("name").alias("ref"), F.col("line_bases").alias("__width")), "ref")
    else:
        asked = asked.withColumn("__width", F.lit(width if width else 1 << 62).cast("long"))
    size = F.greatest(F.lit(1), F.expr(f"{row} div __width")) * F.col("__width")
    heads = asked.select("ordinal", F.lit(-1).cast("long").alias("block"), F.concat(F.lit(">"), "header").alias("text"))
    placed = found.filter(F.length("seq") > 0).join(asked.select("ordinal", "__width", size.alias("__size")), "ordinal")
    end = F.col("at") + F.length("seq")
    placed = placed.withColumn("block", F.explode(F.sequence(F.expr("at div __size"), F.expr("(at + length(seq) - 1) div __size"))))
    low = F.greatest(F.col("at"), F.col("block") * F.col("__size"))
    # a block's end may lie beyond any number where there is one line
    high = F.when(F.col("block") < F.expr("9223372036854775807 div __size") - 1, F.least(end, (F.col("block") + 1) * F.col("__size"))).otherwise(end)
    cut = placed.select("ordinal", "block", "__width", low.alias("at"), F.substring("seq", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("seq"))
    joined = cut.groupBy("ordinal", "block", "__width").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    text = F.when(F.col("__width") >= F.length("seq"), F.col("seq")).otherwise(wrap(F.col("seq"), F.col("__width")))
    return heads.unionByName(joined.select("ordinal", "block", text.alias("text")))


def digests(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(ref, length, md5) over the printable bases of each sequence, in upper case.

    A sequence's lines are sorted and hashed as they stream by, so none is ever held whole.
    """
    clean = lines.select("ref", "line_in_ref", graphic(F.col("seq")).alias("seq"))
    sorted_ = clean.repartition("ref").sortWithinPartitions("ref", "line_in_ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, length = None, None, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([length], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["ref", "length", "md5"])

        for batch in batches:
            refs, seqs = batch.column(0), batch.column(2)
            at = 0
            for run in pc.run_end_encode(refs).run_ends.to_pylist():  # lines of one sequence are hashed at once
                ref = refs[at].as_py()
                if digest is None or ref != name:
                    if digest is not None:
                        yield row()
                    name, digest, length = ref, hashlib.md5(usedforsecurity=False), 0
                part = "".join(seqs[at:run].to_pylist()).encode("latin-1")
                digest.update(part)
                length += len(part)
                at = run
        if digest is not None:
            yield row()

    return sorted_.mapInArrow(run, "ref string, length long, md5 string")


def dictionary(spark: SparkSession, lines: DataFrame, alias: bool = False, uri: str | None = None, assembly: str | None = None, species: str | None = None) -> DataFrame:
    """(ref_ordinal, line): one ``@SQ`` line a sequence; tags without a value are left out."""
    for what in (uri, assembly, species):
        if what is not None and any(c in what for c in "\t\n\r\0"):
            raise FormatError("dictionary values can't hold tabs or line ends")
    order = lines.groupBy("ref").agg(F.min("ref_ordinal").alias("ref_ordinal"))
    rows = digests(spark, lines).join(order, "ref")
    bad = order.filter(~is_sam_name(F.col("ref"))).first()
    if bad:
        raise FormatError(f"{bad['ref']} can't be a reference name")
    tag = lambda name, value: F.concat(F.lit(f"{name}:"), value) if value is not None else F.lit(None)
    text = lambda value: None if value is None else F.lit(value)
    parts = [F.lit("@SQ"), tag("SN", F.col("ref")), tag("LN", F.col("length").cast("string")), tag("M5", F.col("md5")), tag("AN", aliases(F.col("ref")) if alias else None), tag("UR", text(uri)), tag("AS", text(assembly)), tag("SP", text(species))]
    return rows.select("ref_ordinal", F.concat_ws("\t", *(p.cast("string") for p in parts)).alias("line"))


def dictionary_text(spark: SparkSession, lines: DataFrame, header: bool = True, **options) -> str:
    """The whole dictionary; it has a row for each sequence, and is as small as their list."""
    rows = dictionary(spark, lines, **options).orderBy("ref_ordinal").toLocalIterator()
    return ("@HD\tVN:1.0\tSO:unsorted\n" if header else "") + "".join(r["line"] + "\n" for r in rows)
