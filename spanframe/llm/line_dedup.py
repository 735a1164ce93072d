"""Line dedup over content-defined chunks of lines.

The lines of a text are hashed; a hash rolling over two line hashes closes a
chunk where it falls into one class of ``divisor``, so an insertion moves no
boundary but its neighbours. A line of ``long_words`` words or more is a chunk by
itself: a passage of that size may be one line. Chunks of several lines or a long one
that occur more than once in the whole table (first by hash, then by SHA-256) stay where
(key, text hash, line) is smallest and go elsewhere, whatever their size; chunks without
a word stay, as they part paragraphs.

Chunk boundaries leave residue: a repeated passage of few lines may end up in chunks
of one line or merged with its neighbours. With ``passages`` the shortest run of
lines of ``long_words`` words or more from each line on, and that up to each line,
are counted as well, blank lines aside. Both depend on no other lines, and each line
of a repeated passage of that many words is in one of them that lies in the passage,
so such passages go whole. Blank lines go with the line before them.

Only DataFrame functions run here. What is counted is shuffled as hashes; texts
move only for the comparison and for the final join, and of those only the
ones that a bitmap of bounded size can't rule out: the others pass by.

Defined cases: a null text stays null; an empty text has one empty line and stays;
a text that loses every line becomes empty; rows equal in key and text are treated
alike; texts of any length and number of lines are cut whole; an empty table gives no
rows; other columns pass through, whatever their names, ``n_chars`` (if there) is
counted anew where lines went.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.columns import let
from spanframe.plans.bitmap import split
from spanframe.plans.scratch import mark, release, stored

DIVISOR = 2
LONG_WORDS = 50
BLANKS = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks(text: Column, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> Column:
    """Array of (start, n, h): first line, number of lines and hash of the chunks that count: of several lines or of a long one, with a word."""

    def ends(rows: Column) -> Column:
        last = F.size(rows) - 1

        def closes(i: Column) -> Column:
            here, after = F.get(rows, i), F.get(rows, i + 1)
            rolled = F.xxhash64(F.get(rows, i - 1)["h"], here["h"])
            return (i == last) | here["long"] | F.coalesce(after["long"], F.lit(False)) | (F.pmod(rolled, F.lit(divisor)) == 0)

        return F.filter(F.sequence(F.lit(0), last), closes)

    def spans(lines: Column) -> Column:
        rows = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), ((F.length(x) >= 2 * long_words - 1) & (F.regexp_count(x, F.lit(WORD)) >= long_words)).alias("long")))
        return let(
            rows,
            lambda rows: let(
                ends(rows),
                lambda stops: F.transform(
                    stops,
                    lambda stop, k: let(
                        F.coalesce(F.get(stops, k - 1) + 1, F.lit(0)),
                        lambda start: let(
                            F.array_join(F.slice(lines, start + 1, stop - start + 1), "\n"),
                            lambda body: F.struct(start.alias("start"), (stop - start + 1).alias("n"), F.xxhash64(body).alias("h"), (((stop > start) & (F.btrim(body, F.lit(BLANKS)) != "")) | F.get(rows, stop)["long"]).alias("counts")),
                        ),
                    ),
                ),
            ),
        )

    kept = F.filter(let(_lines(text), spans), lambda c: c["counts"])
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["h"].alias("h")))


def runs(text: Column, long_words: int = LONG_WORDS) -> Column:
    """Array of (start, n, h) like that of ``chunks``: the shortest runs of ``long_words`` words or more from a line and up to a line.

    Blank lines are counted in ``n`` after the line they follow (after none, before the first) and don't count in ``h``.
    """
    none = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words"))

    def reach(words: Column) -> Column:
        """From each place on, how many lines make a run; 0 where the rest is too short."""

        def more(run: Column, n: Column) -> Column:
            return F.when(run["words"] >= long_words, run).otherwise(F.struct((run["lines"] + 1).alias("lines"), (run["words"] + n).alias("words")))

        # a line has a word at least
        count = lambda words, i: F.aggregate(F.slice(words, i + 1, long_words), none, more, lambda run: F.when(run["words"] >= long_words, run["lines"]).otherwise(0))
        return let(words, lambda words: F.transform(words, lambda _, i: count(words, i)))

    def found(rows: Column, size: Column) -> Column:
        words, last = F.transform(rows, lambda x: x["words"]), F.size(rows) - 1
        back = F.transform(reach(F.reverse(words)), lambda n, i: F.struct((last - i - n + 1).alias("at"), n.alias("lines")))

        def both(ahead: Column) -> Column:
            """All runs once: ahead there is one from each place, so one back is there already if that has its size."""
            fresh = F.filter(back, lambda x: (x["lines"] > 0) & (F.get(ahead, x["at"]) != x["lines"]))
            return F.concat(F.filter(F.transform(ahead, lambda n, i: F.struct(i.alias("at"), n.alias("lines"))), lambda x: x["lines"] > 0), fresh)

        def run(x: Column, hashes: Column) -> Column:
            start = F.when(x["at"] == 0, F.lit(0)).otherwise(F.get(rows, x["at"])["i"])
            end = F.coalesce(F.get(rows, x["at"] + x["lines"])["i"], size)
            return F.struct(start.alias("start"), (end - start).alias("n"), F.xxhash64(F.slice(hashes, x["at"] + 1, x["lines"])).alias("h"))

        return let(F.transform(rows, lambda x: x["h"]), lambda hashes: F.transform(let(reach(words), both), lambda x: run(x, hashes)))

    def rows(lines: Column) -> Column:
        every = F.transform(lines, lambda x, i: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("words"), i.alias("i")))
        return F.filter(every, lambda x: x["words"] > 0)

    # what lambdas use for each line is evaluated once before: the time follows the number of lines
    return let(_lines(text), lambda lines: let(F.size(lines), lambda size: let(rows(lines), lambda x: found(x, size))))


def _without(lines: Column, gone: Column) -> Column:
    """The lines less those whose numbers are in ``gone`` (ascending): what lies between two of them is a slice."""

    def kept(edges: Column) -> Column:
        between = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.slice(lines, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1))
        return F.flatten(between)

    return let(F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines))), kept)


def repeats(spark: SparkSession, rows: DataFrame, passages: bool = False, **options) -> DataFrame:
    """(k, t, gone): the lines that go, by key and text hash, from ``rows`` of (k, t, text)."""
    # chunks are compared as they are, runs without their blank lines
    named = lambda c, run: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), x["h"].alias("h"), F.lit(run).alias("run")))
    refs = named(chunks(F.col("text"), **options), False)
    if passages:
        long_words = options.get("long_words", LONG_WORDS)
        # a long line is a run as well
        refs = F.concat(F.filter(refs, lambda x: x["n"] > 1), named(runs(F.col("text"), long_words), True))
    begun = mark()
    refs = rows.select("k", "t", F.explode(refs).alias("c")).select("k", "t", "c.*")
    refs = stored(spark, refs, "chunks")
    # written, so that both sides of the join are dealt anew and a hash that a third of all rows share can be split
    often = stored(spark, refs.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("h"), "often")
    doubtful = stored(spark, refs.join(often, "h").groupBy("k", "t").agg(F.collect_set(F.struct("start", "n", "h", "run")).alias("refs")), "doubtful")
    rows, _ = split(spark, rows, F.struct("k", "t"), doubtful, F.struct("k", "t"))
    rows, doubtful = rows.alias("r"), doubtful.alias("u")

    def compared(lines: Column, c: Column) -> Column:
        own = F.slice(lines, c["start"] + 1, c["n"])
        own = F.when(c["run"], F.filter(own, lambda x: F.regexp_count(x, F.lit(WORD)) > 0)).otherwise(own)
        return F.struct(c["h"].alias("h"), c["start"].alias("start"), c["n"].alias("n"), F.unhex(F.sha2(F.array_join(own, "\n").cast("binary"), 256)).alias("body"))

    bodies = (
        rows.join(doubtful, F.col("r.k").eqNullSafe(F.col("u.k")) & (F.col("r.t") == F.col("u.t")))
        .select("r.k", "r.t", F.explode(let(_lines(F.col("text")), lambda lines: F.transform("refs", lambda c: compared(lines, c)))).alias("c"))
        .select("k", "t", "c.*")
    )
    bodies = stored(spark, bodies, "bodies")
    # texts with one SHA-256 are the same text
    first = bodies.groupBy("h", "body").agg(F.min(F.struct("k", "t", "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    first = stored(spark, first, "first")
    later = bodies.join(first, ["h", "body"]).filter(~F.struct("k", "t", "start").eqNullSafe(F.col("first")))
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))))
    gone = stored(spark, later.groupBy("k", "t").agg(lines.alias("gone")), "gone")
    release(spark, begun, gone)
    return gone


def dedup_lines(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", told: bool = False, **options) -> DataFrame:
    """``docs`` without the repeated chunks (and, with ``passages``, repeated runs of lines); ``told`` appends ``n_lines`` and ``removed`` (line numbers, comma-joined)."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    gone = repeats(spark, rows, **options)
    touched, others = split(spark, docs, F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("t")), gone, F.struct("k", "t"))
    nobody = gone.limit(0).alias("g")
    gone = gone.alias("g")
    named = touched.alias("d")
    joined = named.join(gone, F.col(f"d.{key}").eqNullSafe(F.col("g.k")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("g.t")), "left")
    body = F.col(f"d.{text}")
    clean = F.when(F.col("g.gone").isNull(), body).otherwise(F.array_join(let(_lines(body), lambda lines: _without(lines, F.col("g.gone"))), "\n"))
    out = [clean.alias(c) if c == text else F.when(F.col("g.gone").isNull(), F.col(f"d.{c}")).otherwise(F.length(clean)).cast(t).alias(c) if c == "n_chars" else F.col(f"d.`{c}`") for c, t in docs.dtypes]
    if told:
        out += [F.coalesce(F.size(_lines(body)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_join("g.gone", ","), F.lit("")).alias("removed")]
    # rows that lose nothing meet an empty table, which the optimizer replaces by nulls
    return joined.select(*out).unionByName(others.alias("d").join(F.broadcast(nobody), F.lit(False), "left").select(*out))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(spark, docs.select("doc_id", "text"), told=True, passages=True)
