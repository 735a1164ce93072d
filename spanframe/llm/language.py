"""Language identification by cross-parsing entropy.

A text is parsed into the longest phrases that occur in a language's sample text:
the fewer phrases, the closer the language. A suffix automaton of each sample
gives longest matches in one step a character. Texts are parsed side by side: each
step moves all of them, in all languages, by one character. Moves over the commonest
letters are looked up in a dense table of at most ``DENSE_BYTES``, all others in the
sorted list of the automata's edges, so no letter and no language is left out and
memory grows with the samples only.

Long texts are parsed in stretches of ``BLOCK`` characters side by side, each from the root,
and then corrected: what a stretch begins with is what the one before ends with, and from there
the parse is followed beside that from the root until both are in one state, from which
on they agree. Where they never meet, the next stretch is corrected again. The
counts are those of a parse without stretches.

The samples are bounded: ``DOCS`` documents of at most ``DOC_CHARS`` characters a
language, of which ``SAMPLE`` characters after folding are used, or an equal share of
``ALL_SAMPLES`` if there are more languages than that allows; more labels than
``MOST_LANGUAGES`` are an error, as they can't be languages. Every text is parsed whole.

Defined cases: null, empty and letterless texts are ``und`` with score 0, as is any
text if no language was learned; ties go to the language first in code-point
order; an empty table gives no rows; repeated rows are all returned; rows without a key
are no part of the sample and, as they have no place in the split, not held out; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.columns import small_batches

DOCS, DOC_CHARS, SAMPLE, ALL_SAMPLES, MOST_LANGUAGES = 60, 4000, 24_000, 2_400_000, 5000
BLOCK, HELD_CHARS = 4096, 3_000_000
DENSE_BYTES = 1 << 25
UNKNOWN = "und"


class Folder:
    """Texts as codes: 0 for runs of anything but letters, then the letters of the samples, the commonest first, last any other letter."""

    def __init__(self, samples: list[str]) -> None:
        times = Counter(c for s in samples for c in s.lower() if c.isalpha())
        letters = sorted(times, key=lambda c: (-times[c], c))
        self.size = len(letters) + 2
        self.table = np.fromiter((self.size - 1 if chr(c).isalpha() else 0 for c in range(0x110000)), np.int32, 0x110000)
        for k, c in enumerate(letters, 1):
            self.table[ord(c)] = k

    def __call__(self, text: str) -> np.ndarray:
        codes = self.table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not len(codes):
            return codes
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[0] = True
        return codes[keep]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``; state 0 is the root."""
    edges, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p, last = last, new
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = edges[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        copy = len(edges)
        edges.append(dict(edges[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = link[new] = copy
        while p >= 0 and edges[p].get(c) == q:
            edges[p][c] = copy
            p = link[p]
    return edges


class CrossParser:
    """Phrases of texts against the samples of languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.names = [name for name, _ in samples]
        self.fold = Folder([text for _, text in samples])
        size, n = self.fold.size, len(samples)
        share = min(SAMPLE, ALL_SAMPLES // max(1, n))
        self.weight, roots, keys, targets, at = [], [], [], [], 0
        # by language and letter: the root's edges, and whether there is none
        self.begin = np.zeros((n, size), np.int32)
        self.strange = np.ones((n, size), bool)
        for k, (_, text) in enumerate(samples):
            codes = self.fold(text)[:share].tolist()
            edges = automaton(codes)
            roots.append(at)
            self.begin[k] = at
            for c, t in edges[0].items():
                self.begin[k, c], self.strange[k, c] = at + t, False
            keys += [np.fromiter(((at + s) << 21 | c for s, out in enumerate(edges) for c in out), np.int64)]
            targets += [np.fromiter((at + t for out in edges for t in out.values()), np.int32)]
            self.weight.append(np.log2(max(2, len(codes))))
            at += len(edges)
        keys, targets = np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate(targets or [np.zeros(0, np.int32)])
        self.width = min(size, max(1, DENSE_BYTES // 4 // max(1, at)))
        code = keys & (1 << 21) - 1
        common = code < self.width
        self.dense = np.full(at * self.width, -1, np.int32)
        self.dense[(keys[common] >> 21) * self.width + code[common]] = targets[common]
        rare = np.flatnonzero(~common)
        rare = rare[np.argsort(keys[rare])]
        self.rare_keys, self.rare_targets = keys[rare], targets[rare]
        self.roots = np.array(roots, np.int32)[:, None]

    def _step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, text): the states after one character each, and the phrases that it closes."""
        if self.width == self.fold.size:
            to = self.dense.take(state * self.width + codes)
        else:
            to = self.dense.take(state * self.width + np.where(codes < self.width, codes, 0))
            rare = np.flatnonzero(codes >= self.width)
            if len(rare):
                key = state[:, rare].astype(np.int64) << 21 | codes[rare]
                if len(self.rare_keys):
                    place = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
                    to[:, rare] = np.where(self.rare_keys[place] == key, self.rare_targets[place], -1)
                else:
                    to[:, rare] = -1
        stuck = to < 0
        # an open phrase ends; a letter that the sample lacks is a phrase by itself
        closed = (stuck & (state != self.roots)).astype(np.int32)
        language, text = np.nonzero(stuck)
        code = codes[text]
        to[language, text] = self.begin[language, code]
        closed[language, text] += self.strange[language, code]
        return to, closed

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language): the number of phrases."""
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        begin = np.concatenate([np.arange(b) * BLOCK for b in blocks]) if len(owner) else np.zeros(0, np.int64)
        width = np.minimum(BLOCK, sizes[owner] - begin)
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)[owner] + begin
        ends, closed = self._from_root(flat, start, width)
        ends, more = self._corrected(flat, start, width, begin, ends)
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        counts = closed + more + ((ends != self.roots) & last)  # the text's end closes what is open
        out = np.zeros((len(texts), len(self.names)), np.int64)
        np.add.at(out, owner, counts.T)
        return out

    def _from_root(self, flat: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, stretch): the states at the ends of stretches parsed from the root, and the phrases closed in them."""
        order = np.argsort(-width, kind="stable")
        at, size = start[order], width[order]
        state = np.repeat(self.roots, len(order), axis=1)
        closed = np.zeros(state.shape, np.int32)
        active = len(order)
        for step in range(int(size[0]) if len(size) else 0):
            while size[active - 1] <= step:
                active -= 1
            state[:, :active], more = self._step(state[:, :active], flat[at[:active] + step])
            closed[:, :active] += more
        back = np.argsort(order, kind="stable")
        return state[:, back], closed[:, back]

    def _corrected(self, flat: np.ndarray, start: np.ndarray, width: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The true states at the ends of stretches, and what their counts lack (or have too much)."""
        from_root, ends = ends, ends.copy()
        lacks = np.zeros(ends.shape, np.int32)
        todo = np.flatnonzero(begin > 0)
        while len(todo):
            true, root = ends[:, todo - 1], np.repeat(self.roots, len(todo), axis=1)
            found, lack, lane, step = from_root[:, todo].copy(), np.zeros(true.shape, np.int32), np.arange(len(todo)), 0
            while len(lane):
                apart, over = (true != root).any(axis=0), width[todo[lane]] <= step
                found[:, lane[over & apart]] = true[:, over & apart]
                on = apart & ~over
                lane, true, root = lane[on], true[:, on], root[:, on]
                if not len(lane):
                    break
                codes = flat[start[todo[lane]] + step]
                true, ours = self._step(true, codes)
                root, theirs = self._step(root, codes)
                lack[:, lane] += ours - theirs
                step += 1
            moved = (found != ends[:, todo]).any(axis=0)
            ends[:, todo], lacks[:, todo] = found, lack
            todo = todo[moved] + 1
            todo = todo[todo < len(begin)]
            todo = todo[begin[todo] > 0]
        return ends, lacks

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        codes = [self.fold(t) if t else np.zeros(0, np.int32) for t in texts]
        cost = self.phrases(codes) * np.array(self.weight)
        best = cost.argmin(axis=1)
        out = []
        for k, (c, b) in enumerate(zip(codes, best)):
            if not c.any():
                out.append((UNKNOWN, 0.0))
                continue
            others = np.delete(cost[k], b)
            second = float(others.min()) if len(others) else float("inf")
            out.append((self.names[b], 1.0 if second == float("inf") else second / (second + float(cost[k, b]))))
        return out


@lru_cache(maxsize=4)
def parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    """Built once in each Python worker: the samples are small, the table is not."""
    return CrossParser(samples)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, sample) pairs from the labelled rows of ``docs``, drawn by a hash of the key."""
    docs = docs.select(F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("key IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()  # one row a language
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different labels of languages")
    if not counts:
        return ()
    spread = 1 << 30
    share = min(SAMPLE, ALL_SAMPLES // len(counts))
    most = max(4, DOCS * share // SAMPLE)  # what is drawn follows what is used
    drawn = docs.sparkSession.createDataFrame([(r["lang"], min(spread, most * spread // r["count"])) for r in counts], "lang string, below long")
    place = F.pmod(F.xxhash64("key"), F.lit(spread))
    rows = docs.withColumn("place", place).join(F.broadcast(drawn), "lang").filter("place < below").select("lang", "place", F.substring("text", 1, min(DOC_CHARS, 2 * share)).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place, r.text)):
        kept = samples.setdefault(r.lang, [])
        if sum(map(len, kept)) < 2 * share:
            kept.append(r.text)
    return tuple((name, "\n".join(kept)[: 2 * share]) for name, kept in sorted(samples.items()))


def identify(spark: SparkSession, docs: DataFrame, samples: tuple[tuple[str, str], ...], key: str = "doc_id", text: str = "text", *carried: str) -> DataFrame:
    """(key, carried..., lang_pred, score) for every row of ``docs``."""
    small_batches(spark)
    rows = docs.select(key, *carried, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = parser(samples) if samples else None

        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            found = model.predict(table.column(table.num_columns - 1).to_pylist()) if model else [(UNKNOWN, 0.0)] * table.num_rows
            columns = [*table.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            return pa.Table.from_arrays(columns, names=[*table.column_names[:-1], "lang_pred", "score"]).combine_chunks().to_batches()[0]

        held, chars = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                chars += batch.column(batch.num_columns - 1).nbytes
                if chars > HELD_CHARS:
                    yield done(held)
                    held, chars = [], 0
        if held:
            yield done(held)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *carried)), "lang_pred string", "score double"]))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    samples = learn(docs.filter(~held))
    return identify(spark, docs.select("doc_id", held.alias("held_out"), "text"), samples, "doc_id", "text", "held_out")
