"""Layouts of positional text: presets, checked custom layouts, detection, and the form kept in an index header."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import DataFrame


class FormatError(ValueError):
    """A layout or its options don't hold together, or a text doesn't follow its layout."""


@dataclass(frozen=True)
class Config:
    """Columns count from 1; ``end`` 0 means that there is none. ``kind`` is sam or vcf where ends are derived."""

    sequence: int
    begin: int
    end: int = 0
    zero_based: bool = False
    comment: str = "#"
    skip: int = 0
    kind: str | None = None

    @property
    def max_column(self) -> int:
        return {"vcf": 8, "sam": 6}.get(self.kind, max(self.sequence, self.begin, self.end))


PRESETS = {
    "bed": Config(1, 2, 3, zero_based=True),
    "gff": Config(1, 4, 5),
    "sam": Config(3, 4, comment="@", kind="sam"),
    "vcf": Config(1, 2, kind="vcf"),
}


def custom(sequence: int = 1, begin: int = 4, end: int | None = 5, zero_based: bool = False, comment: str = "#", skip: int = 0) -> Config:
    """A checked layout; the defaults are those of the command line."""
    end = end or 0
    if sequence < 1 or begin < 1 or end < 0:
        raise FormatError("columns count from 1")
    if sequence in (begin, end):
        raise FormatError("the sequence column can't hold a coordinate")
    if len(comment.encode("latin-1", "replace")) != 1 or comment in "\0\t\n\r":
        raise FormatError("the comment marker is one byte, not NUL, tab or a line end")
    if skip < 0:
        raise FormatError("lines to skip can't be negative")
    return Config(sequence, begin, 0 if end == begin else end, zero_based, comment, skip)


def resolve(preset: str | None = None, **options) -> Config | None:
    """A preset, or a custom layout of the given options, or None if there are neither; both together are an error."""
    given = {k: v for k, v in options.items() if v is not None and v is not False}
    if preset and given:
        raise FormatError("a preset takes no custom options")
    if preset:
        if preset not in PRESETS:
            raise FormatError(f"unknown preset {preset}")
        return PRESETS[preset]
    return custom(**given) if given else None


EXTENSIONS = {"bed": "bed", "gff": "gff", "gff3": "gff", "gtf": "gff", "sam": "sam", "vcf": "vcf"}
HINTS = (("vcf", re.compile(r"##fileformat=VCF|#CHROM\tPOS\t")), ("gff", re.compile(r"##gff-version")), ("sam", re.compile(r"@(HD|SQ|RG|PG|CO)\t")))


def _by_name(name: str) -> str | None:
    parts = name.lower().rsplit("/", 1)[-1].split(".")
    if len(parts) > 1 and parts[-1] in ("gz", "bgz", "bgzf"):
        parts.pop()
    return EXTENSIONS.get(parts[-1]) if len(parts) > 1 else None


def detect(name: str, sample: str) -> Config:
    """The preset that the file's name, its header lines and its first data row agree on."""
    lines = [x.removesuffix("\r") for x in sample.split("\n")]
    said = {kind for kind, pattern in HINTS for line in lines if line[:1] in ("#", "@") and pattern.match(line)}
    rows = {mark: next((x for x in lines if x and not x.startswith(mark)), None) for mark in MARKS}
    return PRESETS[decide(name, said, rows)]


#: The comment markers of the presets.
MARKS = ("#", "@")


def decide(name: str, said: set[str], rows: dict[str, str | None]) -> str:
    """The preset's name, from what header lines say and the first data row for each comment marker."""
    from spanframe.functions.records import parse_line

    named = _by_name(name)
    said = said | ({named} if named else set())
    if len(said) > 1:
        raise FormatError(f"name and header disagree on the format: {', '.join(sorted(said))}")

    def parses(kind: str) -> bool:
        config = PRESETS[kind]
        row = rows[config.comment]
        if row is None:
            return bool(said)
        try:
            parse_line(row, config)
        except FormatError:
            return False
        return True

    kinds = [k for k in (said or PRESETS) if parses(k)]
    if len(kinds) != 1:
        raise FormatError("the format can't be told; name a preset" if not said else f"the first row is not {said.pop()}")
    return kinds[0]


def detect_files(lines: DataFrame) -> DataFrame:
    """(path, format, error) for each path of (path, line_no, raw): what ``detect`` says of each file, conflicts as results.

    One aggregate a path keeps three flags and two lines, which are judged in batches; files of any number.
    """
    from pyspark.sql import functions as F

    raw = F.regexp_replace("raw", r"\r\z", "")
    cut = lines.select("path", "line_no", raw.alias("raw"))
    hint = lambda pattern: F.coalesce(F.bool_or(F.col("raw").rlike("\\A[#@]") & F.col("raw").rlike(f"\\A(?:{pattern.pattern})")), F.lit(False))
    first = lambda mark: F.min(F.when((F.col("raw") != "") & ~F.col("raw").startswith(mark), F.struct("line_no", "raw")))["raw"]
    told = cut.groupBy("path").agg(*(hint(p).alias(kind) for kind, p in HINTS), *(first(mark).alias(f"row{k}") for k, mark in enumerate(MARKS)))

    def judge(frames):
        for frame in frames:
            found, errors = [], []
            for row in frame.itertuples(index=False):
                try:
                    found.append(decide(row.path, {kind for kind, _ in HINTS if getattr(row, kind)}, {mark: getattr(row, f"row{k}") for k, mark in enumerate(MARKS)}))
                    errors.append(None)
                except FormatError as e:
                    found.append(None)
                    errors.append(str(e))
            yield frame[["path"]].assign(format=found, error=errors)

    return told.mapInPandas(judge, "path string, format string, error string")


def to_header(config: Config) -> dict[str, int]:
    """The numbers that a TBI or CSI header keeps; of the presets only SAM and VCF keep their identity."""
    if config.skip >= 1 << 31:
        raise FormatError("too many lines to skip for an index header")
    code = {"sam": 1, "vcf": 2}.get(config.kind, 0) | (0x10000 if config.zero_based else 0)
    end = 0 if config.kind else config.end or config.begin
    return {"format": code, "sequence": config.sequence, "begin": config.begin, "end": end, "comment": ord(config.comment), "skip": config.skip}


def from_header(header: dict[str, int]) -> Config:
    """The layout in an index header."""
    code = header["format"] & 0xFFFF
    if code in (1, 2):
        kind = {1: "sam", 2: "vcf"}[code]
        canon = PRESETS[kind]
        if (header["sequence"], header["begin"], chr(header["comment"])) != (canon.sequence, canon.begin, canon.comment):
            raise FormatError(f"the index header's columns are not those of {kind}")
        return replace(canon, skip=header["skip"])
    if code:
        raise FormatError(f"unknown format {code} in an index header")
    return custom(header["sequence"], header["begin"], header["end"] or None, bool(header["format"] & 0x10000), chr(header["comment"]), header["skip"])
