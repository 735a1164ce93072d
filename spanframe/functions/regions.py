"""Both request grammars, read on the driver: requests are few, and mistakes have to show before any output.

Interval queries and sequence queries read ``name:20`` differently: there it is the
single base 20, here it is 20 to the end.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from spanframe.functions.coords import LONG_MAX

log = logging.getLogger("spanframe")


class RegionError(ValueError):
    """A request can't be read or names nothing."""


@dataclass(frozen=True)
class Request:
    """1-based inclusive; an ``end`` of None is open."""

    label: str
    ref: str
    start: int
    end: int | None


GROUPED = re.compile(r"[0-9]{1,3}(,[0-9]{3})+|[0-9]+", re.ASCII)


def _place(text: str, region: str) -> int:
    if not GROUPED.fullmatch(text):
        raise RegionError(f"invalid position in {region}")
    value = int(text.replace(",", ""))
    if not 1 <= value <= LONG_MAX:
        raise RegionError(f"position out of range in {region}")
    return value


def _name(ref: str, region: str) -> str:
    if not ref or any(c in ref for c in "\0\t\n\r"):
        raise RegionError(f"invalid reference name in {region}")
    return ref


def parse_region(region: str) -> Request:
    """``ref``, ``ref:p``, ``ref:a-b``, ``ref:a-``, ``ref:-b`` or ``ref:-``; the last colon parts name and range."""
    name, colon, span = region.rpartition(":")
    if not colon:
        return Request(region, _name(region, region), 1, None)
    _name(name, region)
    if not span:
        raise RegionError(f"nothing after the colon in {region}")
    low, dash, high = span.partition("-")
    start = _place(low, region) if low else 1
    end = (_place(high, region) if high else None) if dash else start
    if end is not None and end < start:
        raise RegionError(f"{region} ends before it begins")
    return Request(region, name, start, end)


def read_region_lines(lines: Iterable[str], bed: bool) -> list[Request]:
    """Requests of a region or target file: three columns or more, 0-based if ``bed``; blank and ``#`` lines are passed over."""
    out = []
    for number, line in enumerate(lines, 1):
        line = line.rstrip("\n").removesuffix("\r")
        if not line or line.startswith("#"):
            continue
        cells = line.split("\t")
        if len(cells) < 3 or not all(re.fullmatch("[0-9]+", x, re.ASCII) for x in cells[1:3]):
            raise RegionError(f"line {number} is not name, start and end")
        start, end = int(cells[1]) + bed, int(cells[2])
        if start < 1 or end < start or end > LONG_MAX:
            raise RegionError(f"line {number} has no valid interval")
        ref = _name(cells[0], f"line {number}")
        out.append(Request(f"{ref}:{start}-{end}", ref, start, end))
    return out


def read_region_file(path: str) -> list[Request]:
    """As above; a name that ends in .bed (in any case, not .bed.gz) is 0-based."""
    with open(path, encoding="latin-1", newline="\n") as lines:
        return read_region_lines(lines, path.lower().endswith(".bed"))


@dataclass(frozen=True)
class Slice:
    """0-based half-open part of a sequence, with the request as it was written."""

    header: str
    ref: str
    start: int
    end: int


def _free(text: str, request: str) -> int:
    digits = text.replace(",", "")
    if not re.fullmatch("[0-9]+", digits, re.ASCII) or int(digits) >= 1 << 64:
        raise RegionError(f"invalid position in {request}")
    return int(digits)


def resolve_sequence(request: str, lengths: Mapping[str, int]) -> Slice:
    """Look a sequence request up among names and their lengths.

    The whole string may be a name, or a name with a range; if it can be both, braces around the name
    have to say which. Ranges are clipped to the sequence; one past its end is empty.
    """
    whole = None
    if request.startswith("{"):
        name, brace, rest = request[1:].partition("}")
        if not brace or (rest and not rest.startswith(":")):
            raise RegionError(f"unbalanced braces in {request}")
        span = rest[1:] if rest else None
    else:
        whole = request if request in lengths else None
        name, colon, span = request.rpartition(":")
        if not colon:
            name, span = request, None
        elif whole is not None and name in lengths and re.fullmatch("[0-9,]+(-[0-9,]*)?", span, re.ASCII):
            raise RegionError(f"{request} can be read in two ways; put the name in braces")
        elif whole is not None:
            name, span = whole, None
    if name not in lengths:
        raise RegionError(f"no sequence for {request}")
    start, end, beyond = 0, lengths[name], False
    if span is not None:
        low, dash, high = span.partition("-")
        first = _free(low, request) if low else 1
        if not low and not dash:
            raise RegionError(f"nothing after the colon in {request}")
        if first == 0:
            raise RegionError(f"position 0 in {request}")
        if high:
            last = _free(high, request)
            if first > last:
                raise RegionError(f"{request} ends before it begins")
            end = min(end, last)
            beyond = last > lengths[name]
        start = min(first - 1, lengths[name])
        if beyond or first - 1 > lengths[name]:
            log.warning("%s reaches past the end of its sequence and is cut there", request)
    return Slice(request, name, start, max(start, end))
