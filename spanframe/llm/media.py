"""Media columns: documents as interleaved sequences of text and media.

An HTML page is parsed into an ordered array of text and media-reference structs; the
caption of a figure goes with every reference in it, wherever in the figure it stands.
Payloads are stored once a task and digest as 8-bit greyscale PNG, 64 samples a row, and
read back where they lie: what is joined to references by digest are the payloads'
measures, so stored bytes are never shuffled. Positions in a sequence stay those of the
page.

The query takes the page of a document to be its paragraphs, one a line, and a figure
behind them that refers to the document's payload; the figure's place in the sequence and
its caption are returned with what the digest resolves to. ``page_sequences`` gives the
sequences of the table ``pages``.

Defined cases: a null or empty page gives an empty sequence; unknown elements are read as
inline ones and nothing raises; an end tag closes all that was opened inside its element,
also what isn't shown (a title is closed by the next block as well); nothing in an
element that isn't shown is an item; a caption outside a figure is text; a
reference with no stored payload keeps nulls; equal payloads share a digest and
all values; an empty table gives no rows; pages and payloads of any length are read
whole, one at a time; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.columns import small_batches
from spanframe.plans.scratch import stored

ITEM = "struct<pos:int,kind:string,text:string,src:string,digest:string,alt:string,caption:string>"
ROW = 64
BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "br", "tr", "table", "figure", "blockquote", "pre", "nav", "header", "footer", "body"}
UNSEEN = {"script", "style", "noscript", "template", "title"}
MEDIA = {"img", "video", "audio", "source"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DIGEST = "sha256:"


TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: A quoted value that ends, or anything else inside a tag.
INSIDE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')|[^>=]+|=""")
ATTRIBUTE = re.compile(r"""([^\s/=>][^\s/=>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements whose content has no tags.
RAW = {"script", "style"}


def tokens(html: str) -> Iterator[tuple]:
    """("text", text), ("start", tag, attributes, whether it closes itself) and ("end", tag), in one pass.

    A tag ends at the first ``>`` outside quoted values; where quotes leave none, at the first ``>`` at all, for the
    rest of the page. A sign that begins nothing that ends is text: what no end was found for once is not
    looked for again, so the time follows the page's length. Comments and declarations are passed over, an open
    comment to the page's end.
    """
    at = text = 0
    last, quoted, raw_open = html.rfind(">"), True, set()
    while 0 <= (at := html.find("<", at)) < last:
        tag = TAG.match(html, at)
        if tag:
            end = tag.end()
            if quoted:
                while (part := INSIDE.match(html, end)) is not None:
                    end = part.end()
                quoted = end < len(html)
            if not quoted:
                end = html.find(">", tag.end())
            begin, stop, at = at, end, end + 1
        elif html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            begin, at = at, len(html) if end < 0 else end + 3
        elif html.startswith(("<!", "<?", "</"), at):
            begin, at = at, html.find(">", at) + 1
        else:
            at += 1
            continue
        if begin > text:
            yield "text", unescape(html[text:begin])
        text = at
        if not tag:
            continue
        name = tag[2].lower()
        if tag[1]:
            yield "end", name
            continue
        body = html[tag.end() : stop]
        yield "start", name, {a[1].lower(): unescape(a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or "") for a in ATTRIBUTE.finditer(body)}, body.endswith("/")
        if name in RAW and name not in raw_open:
            close = re.compile(f"</{name}", re.IGNORECASE).search(html, at)
            if close is None:
                raw_open.add(name)
            else:
                at = text = close.start()  # what an element that isn't shown holds is no text
    if text < len(html):
        yield "text", unescape(html[text:])


class _Page:
    def __init__(self) -> None:
        self.items: list[dict] = []
        self.run: list[str] = []
        self.open: list[str] = []
        self.times: Counter[str] = Counter()  # of the tags in ``open``
        self.figures: list[dict] = []  # of the open ones: the first item, and the caption
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text})

    def shown(self) -> bool:
        return not any(self.times[tag] for tag in UNSEEN)

    def handle_starttag(self, tag, attrs) -> None:
        if self.open and self.open[-1] == "title" and tag in BLOCKS:
            self.close_top()
        got = attrs
        if tag in MEDIA and got.get("src") and self.shown():
            self.flush()
            src = got["src"]
            self.items.append({"kind": "media", "src": src, "digest": src.removeprefix(DIGEST) if src.startswith(DIGEST) else None, "alt": got.get("alt")})
        elif tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        self.open.append(tag)
        self.times[tag] += 1
        if tag == "figure":
            self.figures.append({"from": len(self.items), "caption": None})
        elif tag == "figcaption" and self.figures and self.shown():
            self.flush()
            self.caption = []

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1] == tag:
            self.close_top()

    def handle_endtag(self, tag) -> None:
        if self.times[tag]:
            while self.open[-1] != tag:
                self.close_top()
            self.close_top()
        elif tag in BLOCKS:
            self.flush()

    def close_top(self) -> None:
        tag = self.open.pop()
        self.times[tag] -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figures[-1]["caption"] is None:
                self.figures[-1]["caption"] = text
        elif tag in BLOCKS:
            self.flush()
        if tag == "figure":
            figure = self.figures.pop()
            for item in self.items[figure["from"] :]:
                if item["kind"] == "media" and figure["caption"] is not None:
                    item.setdefault("caption", figure["caption"])  # that of an inner figure stays

    def handle_data(self, data) -> None:
        if self.shown():
            (self.run if self.caption is None else self.caption).append(data)

    def feed(self, html: str) -> None:
        handlers = {"text": self.handle_data, "start": self.handle_start, "end": self.handle_endtag}
        for kind, *rest in tokens(html):
            handlers[kind](*rest)

    def handle_start(self, tag, attrs, closes: bool) -> None:
        (self.handle_startendtag if closes else self.handle_starttag)(tag, attrs)

    def done(self) -> list[dict]:
        while self.open:
            self.close_top()
        self.flush()
        return self.items


def sequence(html: str | None) -> list[dict]:
    """The page's items in order; ``pos`` counts them from 0."""
    page = _Page()
    page.feed(html or "")
    return [{"pos": k, **{x: item.get(x) for x in ("kind", "text", "src", "digest", "alt", "caption")}} for k, item in enumerate(page.done())]


def interleave(html: Column) -> Column:
    """The column of ``sequence`` for a column of pages."""

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(sequence)

    return F.pandas_udf(run, f"array<{ITEM}>")(html)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale, ``ROW`` samples a row, no row filter."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + part(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of ``to_png``'s form, rows by ``ROW``; raises on damage."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, height = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            height = struct.unpack(">IIBBBBB", body)[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not used here")
    return lines[:, 1:]


def feature(rows: np.ndarray) -> str:
    """Sum, non-zero samples and a 64-bit mean hash over 8 bands of 8 column groups, in integers."""
    sums = rows.reshape(len(rows), 8, ROW // 8).sum(axis=2, dtype=np.int64)
    band = np.arange(len(rows)) * 8 // len(rows)
    cells, sizes = np.zeros((8, 8), np.int64), np.zeros(8, np.int64)
    np.add.at(cells, band, sums)
    np.add.at(sizes, band, ROW // 8)
    total, n = int(sums.sum()), rows.size
    bits = (cells * n > total * sizes[:, None]).reshape(-1)
    return f"{np.packbits(bits).tobytes().hex()}:{total}:{int(np.count_nonzero(rows))}"


def store(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, media): the stored payloads; a digest comes once from each task that met it."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()  # 32 bytes a text
        for batch in batches:
            digests, media = [], []
            for x in batch.column(0):
                payload = payload_of(x.as_py())
                digest = hashlib.sha256(payload)
                if digest.digest() not in met:
                    met.add(digest.digest())
                    digests.append(digest.hexdigest())
                    media.append(to_png(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return stored(spark, docs.select(text).mapInArrow(run, "digest string, media binary"), "media")


MEASURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measure(media: DataFrame) -> DataFrame:
    """``MEASURES`` of each stored payload, from its bytes as read back; one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, stored_bytes in zip(batch.column(0), batch.column(1)):
                form = stored_bytes.as_py()
                rows = from_png(form)
                payload = rows.tobytes()
                out.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature(rows)))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in MEASURES.split(", ")])

    return media.mapInArrow(run, MEASURES).dropDuplicates(["digest"])


def resolve(items: DataFrame, measures: DataFrame, key: str) -> DataFrame:
    """(key, pos, caption, alt, digest, measures...) for each media reference of ``items`` (key, item)."""
    refs = items.filter(F.col("item.kind") == "media").select(key, "item.pos", "item.caption", "item.alt", "item.digest")
    return refs.join(measures, "digest", "left")


def digest_of(text: Column) -> Column:
    raw = F.coalesce(text, F.lit("")).cast("binary")
    pad = F.when(F.octet_length(raw) == 0, F.lit(ROW)).otherwise(F.pmod(-F.octet_length(raw), F.lit(ROW)))
    return F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad))), 256)


def page_of(key: Column, text: Column) -> Column:
    """A document as a page: a paragraph a line, then a figure with its payload."""
    escaped = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    lines = F.transform(F.split(escaped, "\n", -1), lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>")))
    figure = F.concat(F.lit('<figure><img src="'), F.lit(DIGEST), digest_of(text), F.lit('"><figcaption>Document '), F.coalesce(key.cast("string"), F.lit("")), F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), F.coalesce(F.array_join(lines, ""), F.lit("")), figure, F.lit("</article>"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    small_batches(spark)
    measures = stored(spark, measure(store(spark, docs)), "measures")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    pages = docs.select(F.struct("doc_id", size.alias("n_bytes")).alias("of"), interleave(page_of(F.col("doc_id"), F.col("text"))).alias("items"))
    refs = pages.select("of", F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    return resolve(refs, measures, "of").select("of.doc_id", "of.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, kind, text, src, caption) of every item of every page."""
    small_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(interleave(F.col("html"))).alias("item"))
    return pages.select("page_id", "item.pos", "item.kind", "item.text", "item.src", "item.caption")
