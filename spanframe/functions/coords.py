"""Coordinates: strict parsing, one normalized model, bins and virtual positions.

Inside the engine an interval is 1-based and inclusive. All functions build column
expressions; those that can fail raise inside the value they return, so the check
runs wherever the value is used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 9223372036854775807
TBI_SHIFT, TBI_DEPTH = 14, 5


def _raise(message: Column | str) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def is_uint(text: Column) -> Column:
    """Digits only: no sign, blank or exponent; leading zeros are fine."""
    return text.rlike(r"\A[0-9]+\z")


def uint(text: Column, what: str = "coordinate") -> Column:
    """The value as a long. Values over 2^63-1 (up to 2^64-1 are legal in files) are an error here."""
    plain = F.regexp_replace(text, r"\A0+(?=[0-9])", "")
    fits = (F.length(plain) < 19) | ((F.length(plain) == 19) & (plain <= F.lit(str(LONG_MAX))))
    return F.when(is_uint(text) & fits, plain.cast("long")).otherwise(_raise(F.concat(F.lit(f"invalid {what}: "), F.coalesce(text, F.lit("missing")))).cast("long"))


def one_based(begin: Column, end: Column | None) -> tuple[Column, Column]:
    """(start, end) from 1-based inclusive numbers; a missing end is the begin."""
    end = begin if end is None else end
    start = F.when(begin >= 1, begin).otherwise(_raise("coordinate 0 in a one-based file").cast("long"))
    return start, F.when(end >= start, end).otherwise(_raise("interval ends before it begins").cast("long"))


def half_open(begin: Column, end: Column | None) -> tuple[Column, Column]:
    """(start, end) from 0-based half-open numbers; a missing end makes one base."""
    end = begin + 1 if end is None else end
    return begin + 1, F.when(end > begin, end).otherwise(_raise("empty interval").cast("long"))


def overlaps(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """Whether [start, end] meets [from_, to]; a null ``to`` is open."""
    return (end >= from_) & (to.isNull() | (start <= to))


def level_offset(level: int) -> int:
    """The first bin of a level of the 8-ary tree; the root is level 0."""
    return ((1 << 3 * level) - 1) // 7


def reg2bin(start: Column, end: Column, min_shift: int = TBI_SHIFT, depth: int = TBI_DEPTH) -> Column:
    """The smallest bin that holds [start, end] (1-based inclusive); the root beyond the capacity."""
    found = F.lit(0).cast("long")
    for level in range(1, depth + 1):
        shift = min_shift + 3 * (depth - level)
        low = F.shiftright(start - 1, shift)
        found = F.when(low == F.shiftright(end - 1, shift), low + level_offset(level)).otherwise(found)
    return F.when(end > capacity(min_shift, depth), F.lit(0).cast("long")).otherwise(found)


def bins_of(start: Column, end: Column, min_shift: int = TBI_SHIFT, depth: int = TBI_DEPTH) -> Column:
    """Every bin, on all levels, that can hold an interval meeting [start, end]; the root holds all that passes the capacity."""
    last = F.least(end, F.lit(capacity(min_shift, depth)))
    parts = [F.array(F.lit(0).cast("long"))]
    for level in range(1, depth + 1):
        shift = min_shift + 3 * (depth - level)
        parts.append(F.sequence(F.shiftright(start - 1, shift) + level_offset(level), F.shiftright(last - 1, shift) + level_offset(level)))
    return F.when(start <= last, F.concat(*parts)).otherwise(parts[0])


def bin_level(bin_: Column, depth: int = TBI_DEPTH) -> Column:
    out = F.lit(0)
    for level in range(1, depth + 1):
        out = F.when(bin_ >= level_offset(level), F.lit(level)).otherwise(out)
    return out


def bin_bottom(bin_: Column, depth: int = TBI_DEPTH) -> Column:
    """The first lowest-level window under a bin."""
    out = F.lit(0).cast("long")
    for level in range(1, depth + 1):
        out = F.when(bin_ >= level_offset(level), F.shiftleft(bin_ - level_offset(level), 3 * (depth - level))).otherwise(out)
    return out


def capacity(min_shift: int = TBI_SHIFT, depth: int = TBI_DEPTH) -> int:
    """The last position that the tree covers."""
    return 1 << (min_shift + 3 * depth)


def csi_depth(min_shift: int, formatted: bool = False, declared: int | None = None) -> int:
    """Levels of a CSI tree for a window size, given the longest declared reference (SAM and VCF) if there is one."""
    if not 1 <= min_shift <= 31:
        raise ValueError("the minimum shift is from 1 to 31")
    if formatted and declared is not None:
        depth = min(9, -(-(31 - min_shift) // 3))
    elif min_shift < 10:
        depth = 9
    else:
        depth = 9 - (min_shift - 10) // 3 if min_shift < 25 else 4
    need = declared + 256 if declared is not None else 1
    while capacity(min_shift, depth) < need:
        depth += 1
    if depth > 9 or min_shift + 3 * depth >= 64:
        raise ValueError("no tree of up to 9 levels covers the declared length")
    return depth


def virtual_position(coffset: Column, uoffset: Column) -> Column:
    """Compressed offset of a block (48 bits) and offset in the inflated block (16 bits) as one ordered long."""
    good = (coffset < (1 << 47)) & (uoffset < (1 << 16)) & (coffset >= 0) & (uoffset >= 0)
    return F.when(good, F.shiftleft(coffset, 16).bitwiseOR(uoffset)).otherwise(_raise("virtual position out of range").cast("long"))


def compressed_part(position: Column) -> Column:
    return F.shiftrightunsigned(position, 16)


def inner_part(position: Column) -> Column:
    return position.bitwiseAND(F.lit(0xFFFF).cast("long"))
