"""Ranked lexical search by Block-Max WAND over segments of an inverted index.

``build`` writes an index of every word of every text, for which nothing is shuffled: a task gathers
texts up to a bounded number of words and writes them as a segment, for each term
blocks of ``BLOCK`` postings (gaps and frequencies as bytes of 7 bits) with the last document and
the largest impact of each block. ``search`` sends the postings of asked terms to one
task a segment; a task walks through the segments it gets with one heap a query, so
what it found before raises the threshold of what follows. Cursors stand on lower bounds:
a shallow move goes over blocks by their last documents, and a block is decompressed only
where the block maxima at the pivot reach the threshold. What the tasks found is ranked
once more by item: ``k`` rows a task and item at most.

Scores are integers: a term weighs floor(1000 ln((2N+2)/(2df+1))), a document gives
it (10^9 tf) div (1000 tf + 12 m) of its length m = 75 + (25 n N) div L. Queries are
broadcast in blocks of ``ASKED`` terms, as many as it takes: no query is cut.

Defined cases: a null or empty text has no term and is not in the index; rows that
share an item id are one item, those without an id another; rows that repeat are documents
each for itself and tie; ties go by ascending id, null last; terms are whole words of any
length; texts of any length are read whole; empty tables give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm.columns import small_batches
from spanframe.llm.decontam import LETTERS, LOWER, UPPER, words
from spanframe.plans.scratch import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 128
STRETCH = 512
#: A segment is closed at so many words or documents.
SEGMENT_WORDS, SEGMENT_DOCS = 1 << 21, 1 << 15
#: Terms of queries that are broadcast at once.
ASKED = 1 << 18
K = 20


@dataclass(frozen=True)
class Index:
    """The written segments, how many documents have a term and how many terms they have; the type of their key."""

    segments: DataFrame
    docs: int
    terms: int
    key: T.DataType


def varint(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of 7 bits, low ones first, a high bit where more follow; and where each value begins."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        has = size > k
        out[at[:-1][has] + k] = (values[has] >> 7 * k & 127) | np.where(size[has] > k + 1, 128, 0)
    return out, at


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    return 75 + (25 * docs * n) // terms


class Segment:
    """Texts gathered for one segment."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.tokens: list[np.ndarray] = []
        self.keys: list = []
        self.words = 0

    def add(self, key, tokens: list[bytes]) -> None:
        self.tokens.append(np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int64, len(tokens)))
        self.keys.append(key)
        self.words += len(tokens)

    def rows(self, name: str, docs: int, terms: int, kind: pa.DataType) -> pa.RecordBatch:
        """A row for the documents, then one a term in order. Documents are numbered by length, so that the largest impacts of blocks differ."""
        own = list(self.vocabulary)
        order = sorted(range(len(own)), key=own.__getitem__)
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        sizes = np.array(list(map(len, self.tokens)), np.int64)
        by_size = np.argsort(sizes, kind="stable")
        sizes, keys = sizes[by_size], [self.keys[k] for k in by_size]
        pairs, tf = np.unique(rank[np.concatenate([self.tokens[k] for k in by_size])] * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
        term, doc = pairs // len(sizes), pairs % len(sizes)
        first = np.searchsorted(term, np.arange(len(own) + 1))
        opens = (np.arange(len(term)) - first[term]) % BLOCK == 0
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(term))
        gap = np.where(opens, doc, doc - np.concatenate(([0], doc[:-1])))
        data, at = varint(np.stack([gap, tf], axis=1).ravel())
        most = np.maximum.reduceat(impact(tf, length(sizes, docs, terms)[doc]), begin)
        spots = np.append(at[2 * begin], len(data)).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(spots.tobytes()), pa.py_buffer(data.tobytes())])
        each = pa.StructArray.from_arrays([pa.array(doc[end - 1].astype(np.int32)), pa.array(most), packed], ["last", "most", "data"])
        per_term = np.concatenate(([0, 0], np.searchsorted(begin, first[1:]))).astype(np.int32)  # none for the documents
        n = len(own) + 1
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, *[len(values)] * n], pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * n), pa.array([None, *(own[k].decode() for k in order)], pa.string()), pa.array(np.concatenate(([len(sizes)], np.diff(first))).astype(np.int32)), pa.ListArray.from_arrays(pa.array(per_term), each), one(keys, kind), one(sizes, pa.int32())],
            ["segment", "term", "df", "blocks", "ids", "sizes"],
        )


def build(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of ``docs``, written to the shared folder."""
    small_batches(spark)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM)).cast("long")
    total = rows.select(n.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count_if(F.col("n") > 0).alias("docs")).first()
    docs_n, terms_n = total.docs, total.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, segment, kind = TaskContext.get().partitionId(), count(), Segment(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                tokens = (value.as_py() or b"").translate(LETTERS).split()
                if not tokens:
                    continue
                segment.add(key, tokens)
                if segment.words >= SEGMENT_WORDS or len(segment.keys) >= SEGMENT_DOCS:
                    yield segment.rows(f"{part}-{next(made)}", docs_n, terms_n, kind)
                    segment = Segment()
        if segment.keys:
            yield segment.rows(f"{part}-{next(made)}", docs_n, terms_n, kind)

    kind = rows.schema["key"].dataType
    fields = T._parse_datatype_string("segment string, term string, df int, blocks array<struct<last:int,most:bigint,data:binary>>, sizes array<int>").fields
    schema = T.StructType([*fields[:4], T.StructField("ids", T.ArrayType(kind)), fields[4]])
    return Index(stored(spark, rows.mapInArrow(run, schema), "index"), docs_n, terms_n, kind)


class Postings:
    """A term's blocks in one segment; decompressed when asked for, and kept while the segment is searched."""

    __slots__ = ("last", "most", "data", "top", "lengths", "opened")

    def __init__(self, blocks: list[dict], lengths: np.ndarray) -> None:
        self.last, self.most, self.data = [b["last"] for b in blocks], [b["most"] for b in blocks], [b["data"] for b in blocks]
        self.top, self.lengths, self.opened = max(self.most), lengths, {}

    def open(self, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(documents, impacts, documents as a list) of a block."""
        if k not in self.opened:
            pairs = unvarint(self.data[k])
            docs = np.cumsum(pairs[::2])
            self.opened[k] = docs, impact(pairs[1::2], self.lengths[docs]), docs.tolist()
        return self.opened[k]


class Heap:
    """The ``k`` best of one query so far, and the score from which on more are wanted."""

    def __init__(self, k: int) -> None:
        self.k, self.best, self.least = k, [], 1

    def push(self, score: int, key) -> None:
        insort(self.best, (-score, key is None, key), key=lambda x: x[:2] if x[1] else x)
        if len(self.best) > self.k:
            self.best.pop()
        if len(self.best) == self.k:
            self.least = -self.best[-1][0]


#: Places in a cursor: lower bound of the document, block, largest score, blocks' last documents and largest scores, weight, postings.
DOC, AT, TOP, LAST, MOST, WEIGHT, LIST = range(7)
by_doc = itemgetter(DOC)


def cursor(postings: Postings, weight: int) -> list:
    return [0, 0, weight * postings.top, postings.last, [weight * x for x in postings.most], weight, postings]


def walk(cursors: list[list], heap: Heap, keys: list) -> None:
    """Block-Max WAND over one segment.

    Where the blocks at the pivot reach the threshold, a stretch of documents from the pivot on is scored at
    once: up to the first end of a block, as the same blocks hold so far, and ``STRETCH`` documents at least.
    """
    while cursors:
        least = heap.least
        cursors.sort(key=by_doc)
        reach, pivot = 0, 0
        for c in cursors:
            reach += c[TOP]
            if reach >= least:
                break
            pivot += 1
        else:
            return
        doc = cursors[pivot][DOC]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][DOC] == doc:
            pivot += 1
        ahead, bound, edge, over = cursors[: pivot + 1], 0, 1 << 62, False
        for c in ahead:
            at, last = c[AT], c[LAST]
            end = last[at]
            if end < doc:  # the shallow move
                at = bisect_left(last, doc, at + 1)
                if at == len(last):
                    c[DOC], over = -1, True
                    continue
                c[AT], end = at, last[at]
            bound += c[MOST][at]
            if end < edge:
                edge = end
        if over:
            cursors = [c for c in cursors if c[DOC] >= 0]
            ahead = [c for c in ahead if c[DOC] >= 0]
        if bound < least:
            to = min(edge + 1, cursors[len(ahead)][DOC]) if len(cursors) > len(ahead) else edge + 1
            for c in ahead:
                if c[DOC] < to:
                    c[DOC] = to
            continue
        edge = max(edge, doc + STRETCH)
        scores = np.zeros(edge - doc + 1, np.int64)
        for c in cursors:
            if c[DOC] > edge:
                break
            _gather(c, doc, edge, scores)
        cursors = [c for c in cursors if c[DOC] >= 0]
        found = np.flatnonzero(scores >= least)
        for k in found[np.argsort(-scores[found], kind="stable")].tolist():
            if scores[k] < heap.least:
                break
            heap.push(int(scores[k]), keys[doc + k])


def _gather(c: list, doc: int, edge: int, scores: np.ndarray) -> None:
    """Add what a list has from ``doc`` to ``edge`` and move its cursor past it; -1 at its end."""
    last, at = c[LAST], c[AT]
    if last[at] < doc:
        at = bisect_left(last, doc, at + 1)
    while at < len(last):
        docs, impacts, each = c[LIST].open(at)
        low = bisect_left(each, doc)
        high = bisect_left(each, edge + 1, low)
        if high > low:
            scores[docs[low:high] - doc] += c[WEIGHT] * impacts[low:high]
        if high < len(each):
            c[AT], c[DOC] = at, each[high]
            return
        at += 1
        if at < len(last) and last[at - 1] == edge:
            c[AT], c[DOC] = at, edge + 1
            return
    c[DOC] = -1


def _found(queries: list[list[tuple[str, int]]], rows: Iterator[tuple], docs: int, terms: int, k: int) -> Iterator[tuple[int, int, object]]:
    """(query, score, key) of what the segments in ``rows``, one after the other, have for each query."""
    heaps = [Heap(k) for _ in queries]

    def close(keys: list, held: dict[str, Postings]) -> None:
        for query, heap in zip(queries, heaps):
            cursors = [cursor(held[term], weight) for term, weight in query if term in held]
            if cursors:
                walk(cursors, heap, keys)

    now, keys, lengths, held = None, [], np.zeros(0, np.int64), {}
    for segment, term, blocks, ids, sizes in rows:
        if segment != now:
            close(keys, held)
            now, held = segment, {}
        if term is None:  # it comes first
            keys, lengths = ids, length(np.array(sizes, np.int64), docs, terms)
        else:
            held[term] = Postings(blocks, lengths)
    close(keys, held)
    for number, heap in enumerate(heaps):
        for score, _, key in heap.best:
            yield number, -score, key


def search(spark: SparkSession, index: Index, items: DataFrame, k: int = K, item: str = "item_id", text: str = "text", key: str = "doc_id", asked: int = ASKED) -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents of each item."""
    small_batches(spark)
    named = items.select(F.col(f"`{item}`").alias("item"), F.explode(words(F.col(f"`{text}`"))).alias("term"))
    wanted = stored(spark, named.groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")), "asked")
    blocks = -(-wanted.count() // asked)
    kind, n = items.schema[item], int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("key", index.key)])
    parts = []
    for block in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        terms = own.select("term").distinct()
        known = index.segments.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weight = {r.term: math.floor(1000 * math.log((2 * index.docs + 2) / (2 * r.df + 1))) for r in known.collect()}
        asked_by: dict = {}
        for r in own.collect():
            if weight.get(r.term):
                asked_by.setdefault(r.item, []).append((r.term, r.times * weight[r.term]))
        queries = spark.sparkContext.broadcast(list(asked_by.values()))
        names = spark.createDataFrame(list(enumerate(asked_by)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", kind.dataType)]))

        def run(batches: Iterator[pa.RecordBatch], queries=queries, docs=index.docs, terms=index.terms) -> Iterator[pa.RecordBatch]:
            types: list = []

            def rows() -> Iterator[tuple]:
                for batch in batches:
                    types.append(batch.schema.field(3).type.value_type)
                    for row in range(batch.num_rows):
                        yield tuple(c[row].as_py() for c in batch.columns)

            found = list(_found(queries.value, rows(), docs, terms, k))  # k a query at most
            if types:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], types[0])], names=["query", "score", "key"])

        columns = index.segments.select("segment", "term", "blocks", "ids", "sizes")
        sent = columns.join(F.broadcast(terms), "term", "left_semi").unionByName(columns.filter("term IS NULL")).select("segment", "term", "blocks", "ids", "sizes")
        dealt = sent.repartition(n, "segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())
        # written, as searching is what takes time
        parts.append(stored(spark, dealt.mapInArrow(run, schema), "found").join(F.broadcast(names), "query"))
    out = T.StructType([T.StructField(item, kind.dataType), T.StructField("rank", T.IntegerType()), T.StructField(key, index.key), T.StructField("score", T.LongType())])
    if not parts:
        return spark.createDataFrame([], out)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(spark, build(spark, docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT r, doc_id, term, count(*) AS tf, any_value(m) AS m FROM (SELECT r, doc_id, unnest(w) AS term, 75 + (25 * len(w) * n) // l AS m FROM d, s) WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
scored AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, r, doc_id),
best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= {K}"""
