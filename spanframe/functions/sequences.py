"""Column expressions on sequences: cleaning, wrapping, names and aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a SAM reference name may not have.
SAM_FORBIDDEN = r"[\\,\"`'()\[\]{}<>]"


def graphic(seq: Column) -> Column:
    """Only printable ASCII without blanks, in upper case."""
    return F.upper(F.regexp_replace(seq, "[^!-~]", ""))


def wrap(seq: Column, width: int | Column) -> Column:
    """Lines of ``width`` characters, in one pass; 0 leaves one line."""
    if isinstance(width, int) and width == 0:
        return seq
    line = F.lit(f"(.{{{width}}})(?!\\z)") if isinstance(width, int) else F.concat(F.lit("(.{"), width.cast("string"), F.lit("})(?!\\z)"))
    return F.regexp_replace(seq, line, F.lit("$1\n"))


def name_token(header: Column) -> Column:
    """The first word after the ``>``."""
    return F.regexp_extract(header, r"\A>[\t\n\x0b\f\r ]*([^\t\n\x0b\f\r ]*)", 1)


def is_fasta_name(name: Column) -> Column:
    return name.rlike(r"\A[!-~]+\z")


def is_sam_name(name: Column) -> Column:
    return is_fasta_name(name) & ~name.rlike(r"\A[*=]") & ~name.rlike(SAM_FORBIDDEN)


def aliases(name: Column) -> Column:
    """The name with or without ``chr``, and both other names of the mitochondrion, comma-joined."""
    bare = F.regexp_replace(name, r"\Achr", "")
    other = F.when(name.startswith("chr"), bare).otherwise(F.concat(F.lit("chr"), name))
    return F.concat(other, F.when(name == "M", F.lit(",chrMT,MT")).when(name == "MT", F.lit(",chrM,M")).otherwise(F.lit("")))


def byte_offset(offset: Column, line_bases: Column, line_width: Column, place: Column) -> Column:
    """Where base ``place`` (0-based) of a sequence lies in its file."""
    whole = (place - place % line_bases) / line_bases
    return offset + whole.cast("long") * line_width + place % line_bases
