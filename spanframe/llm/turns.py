"""Repair of conversations by weighted finite-state composition.

The turns of a conversation are an acceptor; an edit transducer keeps, reroles or deletes a
turn and inserts empty ones; an acceptor knows the roles that may follow one another,
``(s?(ua)+)?`` by their initials. The three are composed lazily: arcs are made for the states
that are reached, turn by turn, which is a topological order. Paths weigh (cost, labels),
compared in this order, so the cheapest repair is unique: of equal costs that with the
ASCII-least labels.

One path survives for each grammar state. Between two turns all of them have
consumed the same number, so two paths differ first in what they did at one turn, and their
order follows from the order before it. Paths that no continuation can bring back are
dropped, and what the others share is settled and passed on at once: few turns are held
however long the conversation is.

Rows are dealt by conversation and sorted within partitions; conversations stream
through the tasks, which keep for one of them the settled labels, a running SHA-256 and the digests
of its turns (for duplicates). The hash of a whole repaired conversation demands that one task
reads it in order; its turns are never held together, in no row and in no list.

Defined cases: nulls in role or text count as one space; an empty role has no initial and can't be kept; a turn's place may be null and comes
first; turns that tie are ordered by role and text; rows whose conversation is null are one
conversation; rows that repeat are turns like any other; texts of any length are read whole;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanframe.llm.columns import small_batches

BLANK = " \t\n\v\f\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]")
#: Costs of the edits; a truncated turn that stays adds the last.
RETOLD, LOST, ADDED, OPEN = 1, 2, 5, 5

#: The grammar: what may follow each state, by initial. START and DONE may end.
START, LED, ASKED, DONE = range(4)
NEXT: dict[int, dict[str, int]] = {START: {"s": LED, "u": ASKED}, LED: {"u": ASKED}, ASKED: {"a": DONE}, DONE: {"u": ASKED}}
FINAL = (START, DONE)
NAMES = {"u": "user", "a": "assistant"}
FOLLOWS = {"su", "ua", "au"}


def behind(state: int) -> dict[int, int]:
    """The least cost of insertions from ``state`` to each state (0 to itself)."""
    cost, todo = {state: 0}, [state]
    while todo:
        at = todo.pop(0)
        for initial, to in NEXT[at].items():
            if initial in NAMES and to not in cost:
                cost[to] = cost[at] + ADDED
                todo.append(to)
    return cost


#: What it costs at most to follow from the first state whatever can follow from the second:
#: a start has one leading turn more than DONE can take, which is then deleted.
INSERTS = {q: behind(q) for q in NEXT}
CATCH_UP = {(p, q): 0 if p == q or p == START and q in (LED, DONE) else LOST if (p, q) == (DONE, START) else 0 if (p, q) == (DONE, LED) else INSERTS[p].get(q, INSERTS[p][DONE] + LOST) for p in NEXT for q in NEXT}
CATCH_UP |= {(START, DONE): 0, (ASKED, START): INSERTS[ASKED][DONE] + LOST, (ASKED, LED): INSERTS[ASKED][DONE], (LED, START): INSERTS[LED][DONE] + LOST, (LED, DONE): INSERTS[LED][DONE]}


class Path:
    """A survivor: its weight and its last steps, each (labels, output) at one turn and the step before."""

    __slots__ = ("cost", "rank", "step")

    def __init__(self, cost: int, rank: int, step: tuple | None) -> None:
        self.cost, self.rank, self.step = cost, rank, step


class Repair:
    """The lazy composition over one conversation, fed turn by turn; ``settled`` are the steps all survivors share."""

    def __init__(self) -> None:
        self.paths = {START: Path(0, 0, None)}
        self.settled: list[tuple[str, list[tuple[str, str, str]]]] = []

    def _inserted(self) -> Iterator[tuple[int, int, int, str]]:
        """(state, cost, from, labels): where survivors get by insertions, each by its fewest: others cost more and lead to the same."""
        for q, path in self.paths.items():
            for to, cost in INSERTS[q].items():
                yield to, path.cost + cost, q, "I" * (cost // ADDED)

    def feed(self, role: str, text: str, doomed: bool, truncated: bool) -> None:
        """One turn; ``doomed`` ones have to go."""
        best: dict[int, tuple] = {}
        for state, cost, origin, inserts in self._inserted():
            arcs = [("D", state, LOST)]
            if not doomed:
                initial, extra = role[:1], OPEN * truncated
                arcs += [("K", to, extra) for i, to in NEXT[state].items() if i == initial]
                arcs += [("R", to, RETOLD + extra) for i, to in NEXT[state].items() if i in NAMES and i != initial]
            for label, to, more in arcs:
                weight = (cost + more, self.paths[origin].rank, inserts + label, origin)
                if to not in best or weight < best[to]:
                    best[to] = weight
        floor = {q: min(w[0] + CATCH_UP[p, q] for p, w in best.items()) for q in best}
        alive = {q: w for q, w in best.items() if w[0] <= floor[q]}
        # the order of labels, whatever the cost
        order = {q: k for k, q in enumerate(sorted(alive, key=lambda q: alive[q][1:3]))}
        self.paths = {q: Path(w[0], order[q], ((w[2], role, text, w[3], q), self.paths[w[3]].step)) for q, w in alive.items()}
        if len({id(p.step[1]) for p in self.paths.values()}) == 1:
            self._settle(next(iter(self.paths.values())).step[1])
            for p in self.paths.values():
                p.step = (p.step[0], None)

    def _settle(self, step: tuple | None) -> None:
        steps = []
        while step:
            steps.append(step[0])
            step = step[1]
        for labels, role, text, origin, to in reversed(steps):
            self.settled.append((labels, list(self._output(labels, role, text, origin))))

    @staticmethod
    def _output(labels: str, role: str, text: str, state: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what a turn becomes; a deleted one keeps what it was."""
        for label in labels:
            if label == "D":
                yield "D", role, text
                continue
            initial = role[:1] if label == "K" else next(i for i in NEXT[state] if i in NAMES)
            yield (label, role, text) if label == "K" else (label, NAMES[initial], "" if label == "I" else text)
            state = NEXT[state][initial]

    def end(self) -> int:
        """Settle what is left; the cost."""
        ends = [(cost, self.paths[q].rank, inserts, q) for state, cost, q, inserts in self._inserted() if state in FINAL]
        cost, _, inserts, q = min(ends)
        self._settle(self.paths[q].step)
        if inserts:
            self.settled.append((inserts, list(self._output(inserts, "", "", q))))
        return cost


class Reader:
    """Faults, repair and digest of one conversation whose turns come in order."""

    def __init__(self) -> None:
        self.repair, self.seen, self.last = Repair(), set(), None
        self.first_turn = self.last_turn = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def feed(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The turns that are settled by now."""
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.distinct += 1
        if self.last is not None:
            self.illegal += self.last + role[:1] not in FOLLOWS
        self.last = role[:1]
        body = text.rstrip(BLANK)
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        blank, duplicate = not body, digest in self.seen
        self.seen.add(digest)
        truncated = not (blank or duplicate) and body[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + (duplicate and not blank), self.truncated + truncated
        self.repair.feed(role, text, blank or duplicate, truncated)
        yield from self._flush()

    def _flush(self) -> Iterator[tuple[str, str, str]]:
        for labels, out in self.repair.settled:
            self.audit.append(labels)
            for edit, role, text in out:
                if edit != "D":
                    self.hash.update((("" if self.empty else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    self.empty = False
                yield edit, role, text
        self.repair.settled.clear()

    def end(self) -> Iterator[tuple[str, str, str]]:
        self.cost = self.repair.end()
        yield from self._flush()

    def summary(self) -> dict:
        gaps = self.last_turn - self.first_turn + 1 - self.distinct if self.distinct else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


SUMMARY = pa.schema([*((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
TURNS = pa.schema([("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
#: Rows of a batch that a task gives back.
BATCH = 1024


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held) if held else [[] for _ in schema], schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield made()
            held = []
    yield made()


def _streamed(turns: DataFrame, whole: bool) -> DataFrame:
    """``turns`` (conv, turn, role, text, there) by conversation: a summary each or, without ``whole``, the repaired turns."""
    small_batches(turns.sparkSession)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.repartition(n, "conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    kind = turns.schema["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: list = []

        def rows() -> Iterator[tuple]:
            now, reader, place = None, None, 0

            def told(found: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
                nonlocal place
                for edit, role, text in found:
                    if not whole:
                        yield now[0], place, edit, role, text
                    place += 1

            def closed() -> Iterator[tuple]:
                yield from told(reader.end())
                if whole:
                    yield now[0], *reader.summary().values()

            for batch in batches:
                if not key:
                    key.append(batch.schema.field(0).type)
                for conv, turn, role, text, there in zip(*(c.to_pylist() for c in batch.columns)):
                    if now is None or conv != now[0]:
                        if reader:
                            yield from closed()
                        now, reader, place = (conv,), Reader(), 0
                    if there:
                        yield from told(reader.feed(turn, role, text))
            if reader:
                yield from closed()

        first = next(found := rows(), None)  # reads a batch, which tells the key's type
        if first is not None:
            schema = pa.schema([("conv", key[0]), *(SUMMARY if whole else TURNS)])
            yield from _batches((row for part in ((first,), found) for row in part), schema)

    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string" if whole else "place long, edit string, role string, text string"
    return dealt.mapInArrow(run, T.StructType([T.StructField("conv", kind.dataType), *T._parse_datatype_string(fields)]))


def _plain(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), F.lit(True).alias("there"))


def audit(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: its faults, the cost and labels of its repair and the repaired conversation's SHA-256."""
    return _streamed(_plain(turns, conv, turn, role, text), True).withColumnRenamed("conv", conv)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): the repaired turns in order, K kept, R reroled, I inserted, and those that were deleted, D."""
    return _streamed(_plain(turns, conv, turn, role, text), False).withColumnRenamed("conv", conv)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``_streamed`` from the conversations' rows, damaged by the CRC of (conversation, turn); a dropped one stays to name its conversation."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20).alias("kind")
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", filled("role").alias("role"), filled("text").alias("text"), kind)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") > 0).alias("there"), "kind")
    return made.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return _streamed(damaged(rows), True).withColumnRenamed("conv", "conv_id")


def _sql() -> str:
    """The repair as a recursion over places: a struct of cost, labels and output for each grammar state."""
    far = 1_000_000_000
    then = lambda x, cost, label, out: f"{{'c': {x}.c + {cost}, 's': {x}.s || '{label}', 'o': {x}.o || {out}}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    put = lambda x, name: then(x, ADDED, "I", f"chr(10) || '{name}:'")
    gone = lambda x: then(x, LOST, "D", "''")
    kept = lambda x, i: then(x, f"CASE WHEN initial = '{i}' AND NOT doomed THEN {OPEN} * open ELSE {far} END", "K", "chr(10) || role || ':' || text")
    told = lambda x, i: then(x, f"CASE WHEN initial <> '{i}' AND NOT doomed THEN {RETOLD} + {OPEN} * open ELSE {far} END", "R", f"chr(10) || '{NAMES[i]}:' || text")
    either = lambda x, i: f"{kept(x, i)}, {told(x, i)}"
    nowhere = f"{{'c': CAST({far} AS BIGINT), 's': '', 'o': ''}}"
    filled = "coalesce(CAST({0} AS VARCHAR), ' ')".format
    blanks = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n)),
rows AS (SELECT conv_id, turn, {filled("role")} AS role, {filled("text")} AS text, {filled("conv_id")} || ':' || {filled("turn")} AS name FROM conversations),
kinds AS (
  SELECT rows.*, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM rows, crc),
after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM kinds WHERE kind <> 0)),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM after),
seen AS (SELECT *, NOT regexp_matches(text, '[^{blanks}]') AS blank, row_number() OVER (PARTITION BY v, role, text ORDER BY i) > 1 AS again, regexp_matches(text, '[^.!?{blanks}][{blanks}]*\z') AS cut, lag(initial) OVER (PARTITION BY v ORDER BY i) || initial AS pair FROM placed),
faults AS (SELECT v, i, initial, role, text, blank OR again AS doomed, CAST(NOT blank AND NOT again AND cut AS BIGINT) AS open FROM seen),
told AS (
  SELECT v, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM seen GROUP BY v),
paths AS (
  SELECT v, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 's': '', 'o': ''}} AS s0, {nowhere} AS s1, {nowhere} AS s2, {nowhere} AS s3 FROM told
  UNION ALL
  SELECT v, i, {gone("s0")}, {least(gone("s1"), kept("s0", "s"))}, {least(gone("e2"), either("s0", "u"), either("s1", "u"), either("e3", "u"))}, {least(gone("e3"), either("e2", "a"))}
  FROM (
    SELECT *, {least("s3", put("e2", "assistant"))} AS e3
    FROM (SELECT f.*, s0, s1, s3, {least("s2", put("s0", "user"), put("s1", "user"), put("s3", "user"))} AS e2 FROM paths JOIN faults f ON f.v = paths.v AND f.i = paths.i + 1))),
ends AS (
  SELECT v, {least("s0", "s3", put("e2", "assistant"))} AS x
  FROM (SELECT v, s0, s3, {least("s2", put("s0", "user"), put("s1", "user"), put("s3", "user"))} AS e2 FROM paths JOIN told USING (v) WHERE i = n))
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(x.c, 0) AS cost, coalesce(x.s, '') AS audit, sha256(coalesce(substr(x.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ends USING (v)"""


OP11_SQL = _sql()
