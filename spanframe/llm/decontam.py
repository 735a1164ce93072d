"""Benchmark decontamination: n-grams of test items are looked for in every training text.

The n-grams of ``n`` words of the items (of an item with fewer words, all of them) are
a hash set that is broadcast once its size is known to be within ``most`` n-grams and
``most_bytes`` bytes. Tasks read whole texts as UTF-8, give each word that the set uses its
number, hash the windows without unknown words and verify each hash that is in the set word
by word. Nothing is shuffled. A set beyond that size is joined instead: windows that a
bitmap of fixed size can't rule out meet the n-grams by their text, and the hits
go back to their texts. Both ways give the same rows.

Words are runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased.
A word inside any occurrence of an n-gram is hit. Hit words go as spans, from the first
letter of a run of hit words to the last, or their documents go.

Defined cases: a null or empty text has no words and is left as it is; an item without a
word is no n-gram; items that share an id count once, those without an id hit words and
count as no item; an empty table of items hits nothing; rows that repeat are all returned;
texts of any length are read whole; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm.columns import small_batches
from spanframe.plans.bitmap import split, unused
from spanframe.plans.scratch import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N = 10
#: What is broadcast at most: about 200 MB in a Python worker.
MOST, MOST_BYTES = 1 << 20, 64 << 20
#: Letters of words in lower case, all else a blank; UTF-8 has bytes from 128 on in no other character.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
RUN = re.compile(rb"[^ ]+")
LEAK = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int,words:int>>,clean:string>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(tokens: Column, size: Column) -> Column:
    """Array of (at, gram): the runs of ``size`` of the tokens, of which there are as many at least."""
    return F.transform(F.sequence(F.lit(0), F.size(tokens) - size), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(tokens, i + 1, size), " ").alias("gram")))


def grams(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """(item, n, gram) of all items, once each."""
    named = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("tokens")).filter(F.size("tokens") > 0)
    sized = named.withColumn("n", F.least(F.lit(n), F.size("tokens")))
    return sized.select("item", "n", F.explode(F.transform(windows(F.col("tokens"), F.col("n")), lambda w: w["gram"])).alias("gram")).distinct()


class Grams:
    """The hash set: for each length the sorted hashes, the words behind each and its items."""

    def __init__(self, rows: Sequence[tuple[str | None, int, str]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, *_ in rows if item is not None})
        number = {item: k for k, item in enumerate(self.items)}
        held: dict[int, dict[str, set[int]]] = {}
        for item, n, gram in rows:
            held.setdefault(n, {}).setdefault(gram, set()).update([number[item]] if item is not None else [])
        self.sizes = []
        for n, each in sorted(held.items()):
            ids = np.array([[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in gram.encode().split(b" ")] for gram in each], np.uint64)
            seed = 0x9E3779B97F4A7C15
            while True:  # until no two n-grams share a hash
                powers = np.array([pow(seed, j, 1 << 64) for j in range(n)], np.uint64)
                hashes = ids @ powers
                order = np.argsort(hashes)
                if not np.any(hashes[order][1:] == hashes[order][:-1]):
                    break
                seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1
            owners = list(each.values())
            self.sizes.append((n, powers, hashes[order], ids[order], [sorted(owners[k]) for k in order]))

    def hits(self, tokens: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words are hit, and the items with an occurring n-gram."""
        ids = np.fromiter(map(self.vocabulary.get, tokens, repeat(0)), np.uint64, len(tokens))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        edges, items = np.zeros(len(tokens) + 1, np.int64), set()
        for n, powers, hashes, own, owners in self.sizes:
            at = np.flatnonzero(unknown[n:] == unknown[:-n]) if len(tokens) >= n else ()
            for part in (at[k : k + 65536] for k in range(0, len(at), 65536)):
                seen = ids[part[:, None] + np.arange(n)]
                h = seen @ powers
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                maybe = hashes[place] == h
                part, place, seen = part[maybe], place[maybe], seen[maybe]
                same = (own[place] == seen).all(axis=1)
                np.add.at(edges, part[same], 1)
                np.add.at(edges, part[same] + n, -1)
                for k in np.unique(place[same]).tolist():
                    items.update(owners[k])
        return np.cumsum(edges[:-1]) > 0, [self.items[k] for k in sorted(items)]


def outline(data: bytes, plain: bytes, hit: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, words) of each run of hit words, in code points."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    spots = [m.span() for m in RUN.finditer(plain)]
    out, byte, point = [], 0, 0
    for first, after in zip(edges[::2].tolist(), edges[1::2].tolist()):
        begin, end = spots[first][0], spots[after - 1][1]
        start = point + len(data[byte:begin].decode())
        byte, point = end, start + len(data[begin:end].decode())
        out.append((start, point, after - first))
    return out


def _told(text: bytes | None, find, cleaned: bool) -> dict:
    data = text or b""
    plain = data.translate(LETTERS)
    tokens = plain.split()
    hit, items = find(tokens)
    spans = outline(data, plain, hit) if hit.any() else []
    clean = None
    if cleaned and text is not None:
        clean, at, points = "", 0, data.decode()
        for start, end, _ in spans:
            clean, at = clean + points[at:start], end
        clean += points[at:]
    return {"n_words": len(tokens), "n_hit": int(hit.sum()), "items": items, "spans": [{"start": a, "end": b, "words": k} for a, b, k in spans], "clean": clean}


def _leak(df: DataFrame, text: str, name: str, find, cleaned: bool, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with the struct ``name``; ``find`` gives (hit words, items) of words and a row's other columns."""
    kept = [c for c in df.columns if c not in drop]
    kind = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, T._parse_datatype_string(LEAK))])
    leak = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))), ("clean", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c) for c in drop]
            found = [_told(x.as_py(), lambda tokens, k=k: find(tokens, *(c[k].as_py() for c in own)), cleaned) for k, x in enumerate(batch.column(text).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, leak)], names=[*kept, name])

    return df.mapInArrow(run, kind)


def _joined(spark: SparkSession, docs: DataFrame, wanted: DataFrame, key: str, text: str, name: str, cleaned: bool) -> DataFrame:
    """As the broadcast way, for a set of any size."""
    sizes = [r.n for r in wanted.select("n").distinct().collect()]  # at most N
    t, at = unused(docs, "__text", "__hit")
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), words(F.col(text)).alias("tokens"))
    none = F.array().cast("array<struct<at:int,gram:string>>")
    every = F.concat(*(F.when(F.size("tokens") >= n, windows(F.col("tokens"), F.lit(n))).otherwise(none) for n in sizes))
    seen = rows.select("k", "t", F.explode(every).alias("w")).select("k", "t", "w.at", "w.gram")
    maybe, _ = split(spark, seen, F.col("gram"), wanted.select("gram"), F.col("gram"))
    owned = wanted.groupBy("gram").agg(F.first("n").alias("n"), F.collect_set("item").alias("owners"))
    both = stored(spark, maybe.join(owned, "gram").select("k", "t", "at", "n", "owners"), "hits")
    words_hit = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))))
    found = stored(spark, both.groupBy("k", "t").agg(words_hit.alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items")), "leaks").select("k", "t", F.struct("hit", "items").alias(at))
    touched, others = split(spark, docs.withColumn(t, F.xxhash64(text)), F.struct(F.col(key).alias("k"), F.col(t).alias("t")), found, F.struct("k", "t"))
    met = touched.alias("d").join(found.alias("f"), F.col(f"d.{key}").eqNullSafe(F.col("f.k")) & (F.col(f"d.{t}") == F.col("f.t")), "left").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col(f"f.{at}"))
    every = met.unionByName(others.drop(t).withColumn(at, F.lit(None).cast(dict(found.dtypes)[at])))

    def find(tokens: list[bytes], held: dict | None) -> tuple[np.ndarray, list[str]]:
        hit = np.zeros(len(tokens), bool)
        if held:
            hit[held["hit"]] = True
        return hit, held["items"] if held else []

    return _leak(every, text, name, find, cleaned, [at])


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, most: int = MOST, most_bytes: int = MOST_BYTES, cleaned: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a struct of what was hit in each text, and the struct's name: ``leak`` unless a column has it."""
    small_batches(spark)
    wanted = stored(spark, grams(benchmark, item, item_text, n), "grams")
    size = wanted.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
    (name,) = unused(docs, "leak")
    if size.rows and (size.rows > most or size.bytes > most_bytes):
        return _joined(spark, docs, wanted, key, text, name, cleaned), name
    held = spark.sparkContext.broadcast(Grams([tuple(r) for r in wanted.collect()]))
    return _leak(docs, text, name, lambda tokens: held.value.hits(tokens), cleaned), name


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, whole: bool = False, text: str = "text", **options) -> DataFrame:
    """``docs`` without the hit spans or, with ``whole``, without the documents that have any; ``n_chars`` (if there) is counted anew."""
    marked, name = scan(spark, docs, benchmark, text=text, cleaned=not whole, **options)
    if whole:
        return marked.filter(F.col(name)["n_hit"] == 0).drop(name)
    clean = F.col(name)["clean"]
    return marked.select(*(clean.alias(c) if c == text else F.when(F.col(name)["n_hit"] == 0, F.col(c)).otherwise(F.length(clean)).cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes))


def op13_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked, name = scan(spark, docs.select("doc_id", "text"), items)
    told, count = F.array_join(F.array_sort(f"{name}.items"), ","), F.size(f"{name}.items").cast("long")
    spans = F.array_join(F.transform(f"{name}.spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return marked.select("doc_id", F.col(f"{name}.n_words").alias("n_words"), F.col(f"{name}.n_hit").alias("n_hit"), count.alias("n_items"), F.sha2(told, 256).alias("items_sha256"), (F.col(f"{name}.n_hit") > 0).alias("contaminated"), spans.alias("spans"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least({N}, len(w)) AS n, unnest(range(1, len(w) - least({N}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
spot AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n),
met AS (SELECT s.r, s.i, g.n, g.item_id FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM spot) s JOIN g USING (n, gram)),
owners AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM met GROUP BY r),
hit AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM met),
-- where each word begins: what lies before it is separators and earlier words
places AS (
  SELECT r, k, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY r ORDER BY k) AS BIGINT) AS e, length(word) AS size
  FROM (SELECT r, unnest(regexp_extract_all(t, '(?s)([\x00-\x2F\x3A-\x60\x7B-\x7F]*)({WORD})', 1)) AS gap, unnest(regexp_extract_all(t, '(?s)([\x00-\x2F\x3A-\x60\x7B-\x7F]*)({WORD})', 2)) AS word, unnest(range(1, len(w) + 1)) AS k FROM d WHERE r IN (SELECT r FROM owners))),
runs AS (
  SELECT r, min(e - size) AS s, max(e) AS e FROM (SELECT r, e, size, k - row_number() OVER (PARTITION BY r ORDER BY k) AS run FROM hit JOIN places USING (r, k)) GROUP BY r, run),
told AS (SELECT r, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM runs GROUP BY r),
counts AS (SELECT r, count(*) AS n_hit FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN owners USING (r) LEFT JOIN counts USING (r) LEFT JOIN told USING (r)"""
