"""From raw lines to intervals, as column expressions.

``parse_line`` is the same rule for one line on the driver (format detection); the
tests hold the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import coords
from spanframe.functions.config import Config, FormatError

CIGAR = r"(?i)\A([0-9]+[MIDNSHPX=])+\z"


def trim_end(raw: Column) -> Column:
    """Without one trailing carriage return (the line feed is gone already)."""
    return F.regexp_replace(raw, r"\r\z", "")


def is_meta(raw: Column, line_no: Column, config: Config) -> Column:
    """Comment lines anywhere, and the first ``skip`` lines."""
    return raw.startswith(config.comment) | (line_no <= config.skip)


def is_comment(raw: Column, config: Config) -> Column:
    return raw.startswith(config.comment)


def cigar_span(cigar: Column) -> Column:
    """Reference bases under a CIGAR; ``*`` and operations that consume none give 1."""
    sizes = F.regexp_extract_all(cigar, F.lit("([0-9]+)"), F.lit(1))
    codes = F.regexp_extract_all(F.upper(cigar), F.lit("([A-Z=])"), F.lit(1))
    spans = F.zip_with(sizes, codes, lambda n, op: F.when(op.isin("M", "D", "N", "=", "X"), n.cast("long")).otherwise(F.lit(0).cast("long")))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    good = cigar.rlike(CIGAR) & ~cigar.rlike("(?<![0-9])0+[A-Za-z=]") & ~cigar.rlike("[0-9]{18}")
    return F.when(cigar == "*", F.lit(1).cast("long")).when(good, F.greatest(total, F.lit(1).cast("long"))).otherwise(F.raise_error(F.concat(F.lit("invalid CIGAR: "), cigar)).cast("long"))


def vcf_end(begin: Column, ref: Column, info: Column) -> Column:
    """The later of POS + len(REF) - 1 and INFO END; ``END=.`` counts as given but says nothing."""
    ends = F.filter(F.split(info, ";", -1), lambda x: x.startswith("END="))
    by_ref = begin + F.octet_length(ref) - 1

    def later(given: Column) -> Column:
        value = F.when(F.size(given) == 0, None).when(F.get(given, F.lit(0)) == "END=.", None).otherwise(coords.uint(F.substring(F.get(given, F.lit(0)), 5, 1 << 30), "END"))
        most = F.element_at(F.transform(F.array(value), lambda v: F.when(v < begin, F.raise_error(F.lit("END lies before POS")).cast("long")).otherwise(F.greatest(by_ref, v))), 1)
        return F.when(F.size(given) > 1, F.raise_error(F.lit("INFO gives END twice")).cast("long")).otherwise(most)

    return (
        F.when((ref == "") | (ref == "."), F.raise_error(F.lit("missing REF allele")).cast("long"))
        .when(F.instr(info, "END=") == 0, by_ref)  # most lines: INFO is not taken apart
        .otherwise(F.element_at(F.transform(F.array(ends), later), 1))
    )


#: Header lines that declare a reference's length, by kind of file.
DECLARED = {"vcf": r"\A##contig=<(?:.*,)?length=([0-9]+)[,>]", "sam": r"\A@SQ\t(?:.*\t)?LN:([0-9]+)(?![^\t])"}


def declared_length(raw: Column, config: Config) -> Column:
    """The reference length in a VCF contig or SAM sequence header line, else null."""
    if config.kind not in DECLARED:
        return F.lit(None).cast("long")
    found = F.regexp_extract(raw, DECLARED[config.kind], 1)
    return F.when(found != "", found.cast("long"))


def declared_lengths(header: Iterable[str], config: Config) -> list[int]:
    """The lengths that header lines declare."""
    found = (re.search(DECLARED[config.kind], line) for line in header) if config.kind in DECLARED else ()
    return [int(m[1]) for m in found if m]


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row.

    A generator stands between: conditions of filters and joins above it are not rewritten in terms of what is
    below, where they would parse each line again and might do so before header lines are gone.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def records(lines: DataFrame, config: Config) -> DataFrame:
    """(record_id, line_no, raw, ref, start, end) of the data lines of (record_id, line_no, raw); malformed lines raise.

    ``start`` and ``end`` are 1-based inclusive. A column ``next_id`` stays.
    """
    carried = ["next_id"] if "next_id" in lines.columns else []
    raw = trim_end(F.col("raw"))
    data = lines.select("record_id", *carried, "line_no", raw.alias("raw")).filter(~is_meta(F.col("raw"), F.col("line_no"), config))
    df = _step(data, __cells=F.split("raw", "\t", config.max_column + 1))
    cell = lambda k: F.get(F.col("__cells"), F.lit(k - 1))
    name = cell(config.sequence)
    bad_name = (name == "") | name.contains("\0")
    if config.kind == "sam":
        bad_name = bad_name | (name == "*")
    short = F.raise_error(F.concat(F.lit(f"line needs {config.max_column} columns and has "), F.size("__cells").cast("string"))).cast("string")
    ref = F.when(F.size("__cells") < config.max_column, short).when(bad_name, F.raise_error(F.lit("no usable reference name")).cast("string")).otherwise(name)
    begin = coords.uint(cell(config.begin))
    if config.kind == "vcf":
        df = _step(df, ref=ref, __begin=begin, __allele=cell(4), __info=cell(8))
        end = vcf_end(F.col("__begin"), F.col("__allele"), F.col("__info"))
    elif config.kind == "sam":
        df = _step(df, ref=ref, __begin=begin, __span=cigar_span(cell(6)))
        end = F.col("__begin") + F.col("__span") - 1
    else:
        df = _step(df, ref=ref, __begin=begin, __end=coords.uint(cell(config.end)) if config.end else F.lit(None).cast("long"))
        end = F.col("__end") if config.end else None
    if end is not None:
        df = _step(df, __last=end)
        end = F.col("__last")
    start, end = (coords.half_open if config.zero_based else coords.one_based)(F.col("__begin"), end)
    return _step(df, start=start, end=end).select("record_id", *carried, "line_no", "raw", "ref", "start", "end")


def _uint(text: str, what: str) -> int:
    if not re.fullmatch("[0-9]+", text, re.ASCII) or int(text) > coords.LONG_MAX:
        raise FormatError(f"invalid {what}: {text}")
    return int(text)


def parse_line(raw: str, config: Config) -> tuple[str, int, int]:
    """(ref, start, end) of one data line."""
    cells = raw.split("\t")
    if len(cells) < config.max_column:
        raise FormatError(f"line needs {config.max_column} columns and has {len(cells)}")
    cell = lambda k: cells[k - 1]
    ref, begin = cell(config.sequence), _uint(cell(config.begin), "coordinate")
    if not ref or "\0" in ref or (config.kind == "sam" and ref == "*"):
        raise FormatError("no usable reference name")
    if config.zero_based:
        end = _uint(cell(config.end), "coordinate") if config.end else begin + 1
        if end <= begin:
            raise FormatError("empty interval")
        return ref, begin + 1, end
    if begin < 1:
        raise FormatError("coordinate 0 in a one-based file")
    if config.kind == "sam":
        cigar, span = cell(6), 1
        if cigar != "*":
            parts = re.findall("([0-9]+)([A-Za-z=])", cigar)
            if not re.fullmatch("(?i)([0-9]+[MIDNSHPX=])+", cigar) or any(int(n) == 0 for n, _ in parts):
                raise FormatError(f"invalid CIGAR: {cigar}")
            span = max(1, sum(int(n) for n, op in parts if op.upper() in "MDN=X"))
        return ref, begin, begin + span - 1
    if config.kind == "vcf":
        allele, ends = cell(4), [x[4:] for x in cell(8).split(";") if x.startswith("END=")]
        if allele in ("", ".") or len(ends) > 1:
            raise FormatError("missing REF allele or END given twice")
        end = begin + len(allele.encode()) - 1
        if ends and ends[0] != ".":
            value = _uint(ends[0], "END")
            if value < begin:
                raise FormatError("END lies before POS")
            end = max(end, value)
        return ref, begin, end
    end = _uint(cell(config.end), "coordinate") if config.end else begin
    if end < begin:
        raise FormatError("interval ends before it begins")
    return ref, begin, end
