"""FASTA files as tables of lines with byte offsets."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.functions.config import FormatError
from spanframe.functions.sequences import is_fasta_name, name_token
from spanframe.plans.ordering import ranked
from spanframe.plans.scratch import stored
from spanframe.sources.archive import bgzf_lines, blocks
from spanframe.sources.bgzf import inflate, members
from spanframe.sources.text import peek, text_lines


#: Bytes that a row of an index may have.
MOST_LINE = 1 << 20


def fasta_lines(spark: SparkSession, lines: DataFrame, ends_in_newline: bool = True) -> DataFrame:
    """(ref, ref_ordinal, line_in_ref, byte_offset, bases, width, terminated, seq) from (record_id, raw) in file order.

    Prefix sums over the whole file give each line its byte offset and the headers before it, which is the
    ordinal of its sequence.
    """
    is_head = F.col("raw").startswith(">")
    placed = lines.withColumns({"__bytes": (F.octet_length("raw") + 1).cast("long"), "__head": is_head.cast("long")})
    placed = stored(spark, ranked(spark, placed, [F.col("record_id")], "__rank", {"byte_offset": "__bytes", "__heads": "__head"}), "fasta")
    blank = F.length(F.regexp_replace("raw", r"[\t\r ]", "")) == 0
    seen = placed.agg(F.max("record_id").alias("n"), F.max("__heads").alias("h"), F.max(F.when(is_head, F.col("record_id"))).alias("last"), F.max(F.when((F.col("__heads") == 0) & ~is_head & ~blank, 1)).alias("stray")).first()
    if seen["last"] is None:
        raise FormatError("no sequence in this file")
    if seen["stray"]:
        raise FormatError("data comes before the first header")
    if seen["last"] == seen["n"] and not ends_in_newline:
        raise FormatError("a header without a line end")
    heads = placed.filter(is_head).select(F.col("__heads").alias("ref_ordinal"), F.col("record_id").alias("__at"), name_token(F.regexp_replace("raw", r"\r\z", "")).alias("ref"))
    bad = heads.filter(~is_fasta_name(F.col("ref"))).first()
    if bad:
        raise FormatError(f"invalid sequence name {bad['ref']!r}")
    twice = heads.groupBy("ref").count().filter("count > 1").first()
    if twice:
        raise FormatError(f"{twice['ref']} comes twice")
    body = placed.filter(~is_head & (F.col("__heads") > 0)).withColumn("ref_ordinal", F.col("__heads") - 1).join(heads, "ref_ordinal")
    seq = F.regexp_replace("raw", r"\r\z", "")
    ended = (F.col("record_id") < seen["n"]) | F.lit(ends_in_newline)
    return body.select(
        "ref", "ref_ordinal", (F.col("record_id") - F.col("__at") - 1).alias("line_in_ref"), "byte_offset", F.octet_length(seq).cast("long").alias("bases"),
        (F.octet_length("raw") + ended.cast("int")).cast("long").alias("width"), ended.alias("terminated"), seq.alias("seq"),
    )


def _last_byte(path: str) -> bytes:
    """The last byte of a gzip file's content; such a stream can only be read from its start."""
    last = b""
    with gzip.open(path, "rb") as f:
        while part := f.read(1 << 20):
            last = part[-1:]
    return last


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a FASTA file: plain, block-compressed (empty blocks allowed) or gzip, told by its first bytes."""
    head = peek(spark, path, 4)
    if head == b"\x1f\x8b\x08\x04":
        found = blocks(spark, path, "reference").orderBy(F.desc("block_no")).first()
        with open(path, "rb") as f:
            last = next(iter(members(f, found["coffset"])))[1] if found else None
        return fasta_lines(spark, bgzf_lines(spark, path, "reference"), last is not None and inflate(last).endswith(b"\n"))
    if head[:2] == b"\x1f\x8b":
        ended = _last_byte(path) == b"\n"
        if path.endswith(".gz"):
            return fasta_lines(spark, text_lines(spark, path), ended)
        text = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_gunzip, "raw string")
        lines = text.select(F.posexplode(F.split("raw", "\n", -1)).alias("record_id", "raw")).withColumn("record_id", F.col("record_id").cast("long"))
        return fasta_lines(spark, lines if not ended else lines.join(lines.agg(F.max("record_id").alias("end")), F.col("record_id") < F.col("end")).drop("end"), ended)
    return fasta_lines(spark, text_lines(spark, path), peek(spark, path, 1, from_end=True) == b"\n")


def _gunzip(batches):
    """Whole gzip files as text, for those whose name doesn't tell Spark's reader what they are."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([gzip.decompress(x.as_py()).decode("latin-1") for x in batch.column(0)], pa.string())], names=["raw"])


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """An index file of five columns."""
    from spanframe.functions.coords import uint

    lines = text_lines(spark, path)
    if lines.filter(F.octet_length("raw") >= MOST_LINE).first():
        raise FormatError("a row of an index is longer than 1 MiB")
    rows = lines.select("record_id", F.split(F.regexp_replace("raw", r"\r\z", ""), "\t").alias("x"))
    if rows.filter(F.size("x") != 5).first() or rows.isEmpty():
        raise FormatError("an index has rows of exactly five columns")
    names = ("length", "offset", "line_bases", "line_width")
    return rows.select(F.col("x")[0].alias("name"), *(uint(F.col("x")[k], n).alias(n) for k, n in enumerate(names, 1)), F.col("record_id").alias("ref_ordinal"))


def fai_text(fai: DataFrame) -> str:
    """The index as text; it has one row a sequence."""
    return "".join(f"{r['name']}\t{r['length']}\t{r['offset']}\t{r['line_bases']}\t{r['line_width']}\n" for r in fai.orderBy("ref_ordinal").toLocalIterator())
