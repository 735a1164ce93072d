"""The engine's operators on the driver's tables, each with SQL that says the same.

``events`` and ``orders`` serve as intervals, ``documents`` as sequences and lines:

* ``ev(record_id, ref, start, end)``: seconds since 2024 by event type, as long as the value
* ``ord(record_id, ref, start, end)``: days since 1990 by priority, up to a month long
* ``line(doc_id, line_no, seq)``: the lines of a document
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.functions import coords, records, sequences
from spanframe.functions.config import PRESETS, detect_files
from spanframe.functions.regions import Request, parse_region
from spanframe.functions.request_tables import parse_regions, resolve_regions
from spanframe.operators import asof, index, islands, lookup, overlap, sequence
from spanframe.plans.ordering import ranked
from spanframe.plans.scratch import mark, release, shared_dir, stored
from spanframe.sources import splits

DAY = 86400
#: 1-based inclusive requests on ``ev``: label, then reference and range; overlapping and repeated ones are meant.
REGIONS = ("view:1-300,000", "click:86401-172800", "error:500000-", "view:200,000-400,000", "purchase:-250000", "view:1-300,000", "signup:1000000", "signup")
POINTS = tuple(f"{ref}:{at:,}" for at in range(50_000, 2_500_000, 50_000) for ref in ("view", "click"))
DISJOINT = ("view:100000-200000", "click:1-50000", "error:2000000-2100000", "view:150000-260000")
TARGETS = ("view:250000-260000", "click:1000-90000", "click:80000-120000", "error:1-10000")

EV_SQL = "ev AS (SELECT event_id AS record_id, event_type AS ref, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 + 1 AS s, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 + 1 + CAST(floor(value) AS BIGINT) AS e FROM events)"
ORD_SQL = "od AS (SELECT o_orderkey AS record_id, o_orderpriority AS ref, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 1 AS s, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 1 + o_orderkey % 30 AS e FROM orders)"
LINE_SQL = r"line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS seq, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"
#: Bin numbers by the format's own formula, 14-bit windows and five levels below the root.
BIN_SQL = "CASE " + " ".join(f"WHEN (s - 1) >> {14 + 3 * (5 - level)} = (e - 1) >> {14 + 3 * (5 - level)} THEN {coords.level_offset(level)} + ((s - 1) >> {14 + 3 * (5 - level)})" for level in range(5, 0, -1)) + " ELSE 0 END"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.unix_timestamp("ts") - 1704067200 + 1).alias("start")
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.col("event_type").alias("ref"), start, F.floor("value").alias("n"))
    return rows.select("record_id", "ref", "start", (F.col("start") + F.col("n")).alias("end"))


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")) + 1).cast("long")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("ref"), start.alias("start"))
    return rows.withColumn("end", F.col("start") + F.col("record_id") % 30)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "seq"))


def fasta(spark: SparkSession, sf_dir: str, width: int = 60) -> DataFrame:
    """Documents as sequences, cut into lines of ``width`` bases with a header line ahead of each."""
    seq = sequences.graphic(F.col("text"))
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id"), seq.alias("all")).filter(F.length("all") > 0)
    cut = F.posexplode(F.regexp_extract_all("all", F.lit(f".{{1,{width}}}"), F.lit(0)))
    rows = rows.select("doc_id", cut.alias("line_in_ref", "seq"))
    bases = F.length("seq").cast("long")
    # a file for each document: the header is ">" and the id
    at = F.length(F.col("doc_id").cast("string")) + 2 + F.col("line_in_ref") * (width + 1)
    return rows.select(F.col("doc_id").cast("string").alias("ref"), F.col("doc_id").alias("ref_ordinal"), F.col("line_in_ref").cast("long"), at.cast("long").alias("byte_offset"), bases.alias("bases"), (bases + 1).alias("width"), F.lit(True).alias("terminated"), "seq")


FA_SQL = "fa AS (SELECT doc_id, upper(regexp_replace(text, '[^!-~]', '', 'g')) AS q FROM documents)"


def _asked(regions: tuple[str, ...]) -> list[Request]:
    return [parse_region(r) for r in regions]


def _values(regions: tuple[str, ...]) -> str:
    rows = ", ".join(f"({k}, '{r.label}', '{r.ref}', {r.start}, {'NULL' if r.end is None else r.end})" for k, r in enumerate(_asked(regions)))
    return f"req(ordinal, label, ref, a, b) AS (SELECT CAST(x.o AS BIGINT), x.l, x.r, CAST(x.a AS BIGINT), CAST(x.b AS BIGINT) FROM (VALUES {rows}) AS x(o, l, r, a, b))"


MEETS = "v.ref = req.ref AND v.e >= req.a AND (req.b IS NULL OR v.s <= req.b)"
PAIRS = "SELECT ordinal, record_id, v.ref, s AS \"start\", e AS \"end\" FROM ev v JOIN req ON " + MEETS


@query(f"WITH {EV_SQL}, {_values(REGIONS)} {PAIRS}")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = overlap.requests_df(spark, _asked(REGIONS))
    return overlap.overlap_join(ev(spark, sf_dir), asked, "broadcast").select("ordinal", "record_id", "ref", "start", "end").orderBy("ordinal", "record_id")


@query(f"WITH {EV_SQL}, {_values(REGIONS)} {PAIRS}")
def region_overlap_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = overlap.requests_df(spark, _asked(REGIONS))
    return overlap.overlap_join(ev(spark, sf_dir), asked, "binned").select("ordinal", "record_id", "ref", "start", "end")


@query(f"WITH {EV_SQL} "
       "SELECT a.record_id AS event_id, b.record_id AS other_id FROM ev a JOIN ev b ON a.ref = b.ref AND a.e >= b.s AND a.s <= b.e AND a.record_id < b.record_id")  # fmt: skip
def interval_pairs_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of events of a type that meet."""
    return overlap.pairs(ev(spark, sf_dir)).select(F.col("record_id").alias("event_id"), "other_id")


@query(f"WITH {EV_SQL}, {_values(POINTS)} {PAIRS}")
def region_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(POINTS)
    return overlap.query(spark, ev(spark, sf_dir), asked).select("ordinal", "record_id", "ref", "start", "end")


@query(f"WITH {EV_SQL}, {_values(('error:2400000-', 'view:-5000', 'click:-'))} {PAIRS}")
def region_open_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(("error:2400000-", "view:-5000", "click:-"))
    return overlap.query(spark, ev(spark, sf_dir), asked).select("ordinal", "record_id", "ref", "start", "end")


@query(f"WITH {EV_SQL}, {_values(REGIONS)} SELECT record_id, min(ordinal) AS ordinal FROM ev v JOIN req ON {MEETS} GROUP BY record_id")
def region_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.query(spark, ev(spark, sf_dir), _asked(REGIONS), unique=True).select("record_id", "ordinal")


@query(f"WITH {EV_SQL}, {_values((*REGIONS, 'view:9000000-9000001'))} SELECT ordinal, '#' || label AS mark, CAST(count(record_id) AS BIGINT) AS n FROM req LEFT JOIN ev v ON {MEETS} GROUP BY ALL")
def region_separate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).withColumn("raw", F.col("record_id").cast("string"))
    found = overlap.query(spark, rows, _asked((*REGIONS, "view:9000000-9000001")), separate=True)
    mark = F.max(F.when(F.col("record_id") == -1, F.col("raw"))).alias("mark")
    return found.groupBy("ordinal").agg(mark, F.count(F.when(F.col("record_id") >= 0, 1)).alias("n"))


@query(f"WITH {EV_SQL}, {_values(TARGETS)} SELECT record_id, ref, s AS \"start\", e AS \"end\" FROM ev v WHERE EXISTS (SELECT 1 FROM req WHERE {MEETS})")
def target_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.query(spark, ev(spark, sf_dir), targets=_asked(TARGETS))


@query(f"WITH {EV_SQL}, {_values(TARGETS)} SELECT record_id, ref, s AS \"start\", e AS \"end\" FROM ev v WHERE EXISTS (SELECT 1 FROM req WHERE {MEETS})")
def target_semi_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.target_filter(ev(spark, sf_dir), overlap.requests_df(spark, _asked(TARGETS)), "binned").select("record_id", "ref", "start", "end")


@query(f"WITH {EV_SQL}, {_values(REGIONS)}, {_values(TARGETS).replace('req(', 'tgt(', 1)} SELECT ordinal, record_id FROM ev v JOIN req ON {MEETS} WHERE EXISTS (SELECT 1 FROM tgt WHERE {MEETS.replace('req.', 'tgt.')})")
def region_and_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.query(spark, ev(spark, sf_dir), _asked(REGIONS), _asked(TARGETS)).select("ordinal", "record_id")


@query(f"WITH {EV_SQL}, {_values((*DISJOINT, 'nowhere:1-10', 'missing'))} SELECT ordinal, label, ref FROM req WHERE NOT EXISTS (SELECT 1 FROM ev v WHERE v.ref = req.ref)")
def unknown_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = overlap.requests_df(spark, _asked((*DISJOINT, "nowhere:1-10", "missing")))
    return overlap.unknown_references(asked, ev(spark, sf_dir)).select("ordinal", "label", "ref")


ISLANDS = "m AS (SELECT ref, s, e, max(e) OVER (PARTITION BY ref ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM od), i AS (SELECT ref, s, e, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), u AS (SELECT ref, min(s) AS s, max(e) AS e FROM i GROUP BY ref, k)"
EV_ISLANDS = ISLANDS.replace("FROM od", "FROM ev")
PARTS_ASKED = ((1, "view", 1, 40_000), (2, "click", 100_000, 150_000), (3, "error", 2_590_000, 2_650_000), (4, "nothing", 5, 9), (5, "view", 30_000, 60_000))
PARTS_SQL = "q(id, ref, s, e) AS (VALUES " + ", ".join(f"({i}, '{r}', {x}, {y})" for i, r, x, y in PARTS_ASKED) + ")"


@query(f'WITH {ORD_SQL}, {ISLANDS} SELECT ref, s AS "start", e AS "end" FROM u')
def interval_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.coalesce(od(spark, sf_dir))


@query(f'WITH {EV_SQL}, {EV_ISLANDS} SELECT ref, e + 1 AS "start", n - 1 AS "end" FROM (SELECT ref, e, lead(s) OVER (PARTITION BY ref ORDER BY s) AS n FROM u) WHERE n IS NOT NULL')
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.gaps(ev(spark, sf_dir))


@query(f"""WITH {EV_SQL}, {EV_ISLANDS}, {PARTS_SQL},
d AS (SELECT q.id, q.ref, unnest(range(q.s, q.e + 1)) AS day FROM q), free AS (SELECT id, ref, day FROM d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.ref = d.ref AND day BETWEEN u.s AND u.e)),
g AS (SELECT *, day - row_number() OVER (PARTITION BY id ORDER BY day) AS k FROM free)
SELECT CAST(id AS BIGINT) AS id, ref, CAST(min(day) AS BIGINT) AS "start", CAST(max(day) AS BIGINT) AS "end" FROM g GROUP BY id, ref, k""")
def interval_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(PARTS_ASKED, "id long, ref string, start long, end long")
    return islands.subtract(asked, ev(spark, sf_dir))


@query(f"""WITH {EV_SQL}, {PARTS_SQL} SELECT ev.ref, greatest(ev.s, q.s) AS "start", least(ev.e, q.e) AS "end" FROM ev JOIN q ON ev.ref = q.ref AND ev.s <= q.e AND ev.e >= q.s""")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(PARTS_ASKED, "id long, ref string, start long, end long").drop("id")
    return islands.intersect(ev(spark, sf_dir), asked)


@query(f"WITH {EV_SQL} SELECT record_id, CAST({BIN_SQL} AS BIGINT) AS bin FROM ev")
def bin_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).select("record_id", coords.reg2bin(F.col("start"), F.col("end")).alias("bin"))


LEVEL_SQL = "CASE " + " ".join(f"WHEN bin >= {coords.level_offset(k)} THEN {k}" for k in range(5, 0, -1)) + " ELSE 0 END"
BOTTOM_SQL = "CASE " + " ".join(f"WHEN bin >= {coords.level_offset(k)} THEN (bin - {coords.level_offset(k)}) << {3 * (5 - k)}" for k in range(5, 0, -1)) + " ELSE 0 END"


@query(f"WITH {EV_SQL}, b AS (SELECT ref, CAST({BIN_SQL} AS BIGINT) AS bin FROM ev) SELECT ref, bin, CAST({LEVEL_SQL} AS INTEGER) AS level, CAST({BOTTOM_SQL} AS BIGINT) AS first_window, count(*) AS n FROM b GROUP BY ALL")
def bin_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = ev(spark, sf_dir).withColumn("bin", coords.reg2bin(F.col("start"), F.col("end")))
    return binned.groupBy("ref", "bin").agg(F.count(F.lit(1)).alias("n")).select("ref", "bin", coords.bin_level(F.col("bin")).alias("level"), coords.bin_bottom(F.col("bin")).alias("first_window"), "n")


#: Events in file order: by type and start, ids being places in that order.
SORTED_SQL = f"{EV_SQL}, so AS (SELECT ref, s, e, row_number() OVER (ORDER BY ref, s, record_id) - 1 AS record_id, row_number() OVER (ORDER BY ref, s, record_id) AS next_id FROM ev)"


def _sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanframe.plans.ordering import ranked

    rows = ranked(spark, ev(spark, sf_dir), [F.col("ref"), F.col("start"), F.col("record_id")], "place")
    return rows.select(F.col("place").alias("record_id"), (F.col("place") + 1).alias("next_id"), "ref", "start", "end")


@query(f"""WITH {SORTED_SQL}, b AS (SELECT ref, record_id, next_id, CAST({BIN_SQL} AS BIGINT) AS bin FROM so),
r AS (SELECT *, CASE WHEN lag(next_id) OVER (PARTITION BY ref, bin ORDER BY record_id) = record_id THEN 0 ELSE 1 END AS fresh FROM b),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY ref, bin ORDER BY record_id ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT ref, bin, min(record_id) AS chunk_start, max(next_id) AS chunk_end FROM g GROUP BY ref, bin, k""")
def bin_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bin_chunks(_sorted(spark, sf_dir))


#: A request for every event: from its start on, most of them short, some for most of the reference, some open.
ASKED_SQL = f"asked AS (SELECT record_id AS ordinal, ref, s, CASE record_id % 16 WHEN 0 THEN NULL WHEN 1 THEN s + 2000000 ELSE s + record_id % 60000 END AS e FROM ev)"
WIDE_SQL = "(14 + 3 * (5 - level))"


@query(f"""WITH {SORTED_SQL}, {ASKED_SQL}, b AS (SELECT ref, record_id, next_id, e, CAST({BIN_SQL} AS BIGINT) AS bin FROM so),
r AS (SELECT *, CASE WHEN lag(next_id) OVER (PARTITION BY ref, bin ORDER BY record_id) = record_id THEN 0 ELSE 1 END AS fresh FROM b),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY ref, bin ORDER BY record_id ROWS UNBOUNDED PRECEDING) AS k FROM r),
c AS (SELECT ref, bin, {LEVEL_SQL} AS level, min(record_id) AS cs, max(next_id) AS ce FROM g GROUP BY ref, bin, k),
low AS (SELECT ordinal, min(record_id) AS least FROM asked JOIN (SELECT ref, record_id, (e - 1) >> 14 AS w, max((e - 1) >> 14) OVER (PARTITION BY ref) AS top FROM so) v ON v.ref = asked.ref AND v.w >= least((asked.s - 1) >> 14, top) GROUP BY ordinal),
met AS (
  SELECT a.ordinal, cs, ce FROM asked a JOIN low USING (ordinal) JOIN c ON c.ref = a.ref AND ce > least
    AND bin - ((1 << (3 * level)) - 1) // 7 BETWEEN (a.s - 1) >> {WIDE_SQL} AND (least(coalesce(a.e, 536870912), 536870912) - 1) >> {WIDE_SQL}),
m AS (SELECT *, CASE WHEN cs <= max(ce) OVER (PARTITION BY ordinal ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM met),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY ordinal ORDER BY cs, ce ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT ordinal, min(cs) AS chunk_start, max(ce) AS chunk_end FROM k GROUP BY ordinal, island""")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that hold what a request for every event can meet."""
    begun = mark()
    rows = stored(spark, _sorted(spark, sf_dir), "sorted")
    release(spark, begun, rows)
    i = F.col("record_id")
    end = F.when(i % 16 == 0, F.lit(None).cast("long")).when(i % 16 == 1, F.col("start") + 2_000_000).otherwise(F.col("start") + i % 60_000)
    asked = ev(spark, sf_dir).select(i.alias("ordinal"), "ref", "start", end.alias("end"))
    return lookup.lookup_merged(asked, index.bin_chunks(rows), index.linear_index(rows))


@query(f"""WITH {EV_SQL}, q AS (SELECT o_orderkey AS ordinal, ['view', 'click', 'purchase'][1 + o_orderkey % 3] AS ref, 1 + o_orderkey * 37 % 300000 AS a, 501 + o_orderkey * 37 % 300000 AS b FROM orders)
SELECT ordinal, record_id, v.ref, s AS "start", e AS "end" FROM ev v JOIN q ON v.ref = q.ref AND v.e >= q.a AND v.s <= q.b""")
def layout_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every order against the laid out events: they fall into the first days, so most slabs aren't scanned."""
    path, i = f"{shared_dir(spark)}/scratch/layout-{uuid.uuid4().hex}", F.col("o_orderkey")
    index.write_layout(ev(spark, sf_dir), path)
    ref = F.element_at(F.array(*map(F.lit, ("view", "click", "purchase"))), (1 + i % 3).cast("int"))
    start = 1 + i * 37 % 300_000
    asked = _table(spark, sf_dir, "orders").select(i.alias("ordinal"), ref.alias("ref"), start.alias("start"), (start + 500).alias("end"))
    return index.read_layout(spark, path, asked).select("ordinal", "record_id", "ref", "start", "end")


@query(f"""WITH {SORTED_SQL}, w AS (SELECT ref, max((e - 1) >> 14) AS top FROM so GROUP BY ref), all_w AS (SELECT ref, unnest(range(top + 1)) AS win FROM w)
SELECT all_w.ref, CAST(win AS BIGINT) AS "window", min(record_id) AS min_offset FROM all_w JOIN so ON so.ref = all_w.ref AND (e - 1) >> 14 >= win GROUP BY ALL""")
def linear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.linear_index(_sorted(spark, sf_dir))


@query(f"WITH {SORTED_SQL} SELECT ref, min(record_id) AS first_id, max(next_id) AS last_id, count(*) AS n FROM so GROUP BY ref")
def ref_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.metadata(_sorted(spark, sf_dir))


@query(f"WITH {EV_SQL} SELECT ref, row_number() OVER (ORDER BY min(record_id)) - 1 AS ref_ordinal FROM ev GROUP BY ref")
def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.reference_order(ev(spark, sf_dir))


@query(f"WITH {ORD_SQL}, l AS (SELECT *, lag(s) OVER (PARTITION BY ref ORDER BY record_id) AS p FROM od) SELECT record_id, ref, s AS \"start\" FROM l WHERE s < p")
def sort_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sort_violations(od(spark, sf_dir)).select("record_id", "ref", "start")


@query(f'WITH {EV_SQL}, x AS (SELECT ref, min(record_id) AS f, max(record_id) AS l FROM ev GROUP BY ref) SELECT ref, f AS "first", l AS "last" FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.f < x.f AND y.l > x.f)')
def reference_reentry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.reference_reentries(ev(spark, sf_dir))


@query(f'WITH {EV_SQL} SELECT record_id, s AS "start", greatest(s, e) AS "end" FROM ev')
def coord_half_open_to_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).withColumn("raw_begin", F.col("start") - 1).withColumn("raw_end", F.col("end"))
    start, end = coords.half_open(F.col("raw_begin"), F.col("raw_end"))
    return rows.select("record_id", start.alias("start"), end.alias("end"))


TEXTS_SQL = "t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '00' || event_id WHEN 2 THEN '-' || event_id WHEN 3 THEN event_id || ' ' WHEN 4 THEN event_id || 'e1' ELSE '' END AS x FROM events)"


@query(f"WITH {TEXTS_SQL} SELECT event_id, regexp_full_match(x, '[0-9]+') AS valid, CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) ELSE -1 END AS value FROM t")
def strict_uint_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("event_id") % 6, F.col("event_id").cast("string")
    x = F.when(k == 0, text).when(k == 1, F.concat(F.lit("00"), text)).when(k == 2, F.concat(F.lit("-"), text)).when(k == 3, F.concat(text, F.lit(" "))).when(k == 4, F.concat(text, F.lit("e1"))).otherwise("")
    rows = _table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    return rows.select("event_id", coords.is_uint(F.col("x")).alias("valid"), F.when(coords.is_uint(F.col("x")), coords.uint(F.col("x"))).otherwise(-1).alias("value"))


@query("SELECT event_id, CAST(event_id % 50 + 1 + (CASE WHEN event_id % 3 = 0 THEN event_id % 7 + 1 ELSE 0 END) + event_id % 11 + 1 AS BIGINT) AS span FROM events")
def cigar_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    middle = F.concat((i % 7 + 1).cast("string"), F.when(i % 3 == 0, F.lit("D")).when(i % 3 == 1, F.lit("I")).otherwise(F.lit("s")))
    cigar = F.concat((i % 50 + 1).cast("string"), F.lit("M"), middle, (i % 11 + 1).cast("string"), F.lit("="))
    return _table(spark, sf_dir, "events").select("event_id", records.cigar_span(cigar).alias("span"))


@query("SELECT event_id, CAST(greatest(event_id + event_id % 9, CASE WHEN event_id % 4 = 0 THEN event_id + 1 + event_id % 30 ELSE 0 END) AS BIGINT) AS \"end\" FROM events")
def vcf_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    info = F.when(i % 4 == 0, F.concat(F.lit("DP=3;END="), (i + 1 + i % 30).cast("string"))).when(i % 4 == 1, F.lit("CIEND=-9,9")).when(i % 4 == 2, F.lit("END=.")).otherwise(F.lit("."))
    return _table(spark, sf_dir, "events").select("event_id", records.vcf_end(i, F.repeat(F.lit("A"), (i % 9 + 1).cast("int")), info).alias("end"))


#: Documents as files: names and header lines by id, then a row a line of text: line number, its length, and more columns for some.
FILES_SQL = r"""files AS (SELECT doc_id || CASE doc_id % 7 WHEN 0 THEN '.bed' WHEN 1 THEN '.vcf.gz' WHEN 2 THEN '.gff3' WHEN 3 THEN '.txt' WHEN 4 THEN '' WHEN 5 THEN '.SAM' ELSE '.bed.gz' END AS path,
  CASE doc_id % 5 WHEN 0 THEN '##fileformat=VCFv4.3' WHEN 1 THEN '##gff-version 3' WHEN 2 THEN '# a comment' WHEN 3 THEN '@SQ' || chr(9) || 'SN:c' ELSE 'c' || chr(9) || '7' || chr(9) || '9' || chr(13) END AS head,
  CASE doc_id % 3 WHEN 0 THEN 'c' || chr(9) || doc_id || chr(9) || length(text) WHEN 1 THEN 'c' || chr(9) || (doc_id + 1) || chr(9) || '.' || chr(9) || 'A' || chr(9) || '.' || chr(9) || '.' || chr(9) || '.' || chr(9) || 'DP=1' ELSE 'c' || chr(9) || 's' || chr(9) || 'f' || chr(9) || (doc_id + 1) || chr(9) || (doc_id + length(text)) END AS body, text FROM documents WHERE text IS NOT NULL)"""


@query(rf"""WITH {FILES_SQL},
lines AS (SELECT path, 0 AS line_no, regexp_replace(head, '\r$', '') AS raw FROM files UNION ALL SELECT path, 1, body FROM files UNION ALL SELECT path, 2 + unnest(range(len(string_split(text, chr(10))))), regexp_replace(unnest(string_split(text, chr(10))), '\r$', '') FROM files),
said AS (SELECT path, bool_or(regexp_matches(raw, '^(##fileformat=VCF|#CHROM\tPOS\t)')) AS vcf, bool_or(regexp_matches(raw, '^##gff-version')) AS gff, bool_or(regexp_matches(raw, '^@(HD|SQ|RG|PG|CO)\t')) AS sam,
  arg_min(raw, line_no) FILTER (raw <> '' AND NOT starts_with(raw, '#')) AS hash_row, arg_min(raw, line_no) FILTER (raw <> '' AND NOT starts_with(raw, '@')) AS at_row FROM lines GROUP BY path),
named AS (SELECT *, regexp_extract(regexp_replace(lower(path), '\.(gz|bgz|bgzf)$', ''), '\.(bed|gff3|gff|gtf|sam|vcf)$', 1) AS ext FROM said),
kinds AS (SELECT *, list_distinct(list_filter([CASE WHEN vcf OR ext = 'vcf' THEN 'vcf' END, CASE WHEN gff OR starts_with(ext, 'g') THEN 'gff' END, CASE WHEN sam OR ext = 'sam' THEN 'sam' END, CASE WHEN ext = 'bed' THEN 'bed' END], lambda x: x IS NOT NULL)) AS told,
  string_split(hash_row, chr(9)) AS h, string_split(at_row, chr(9)) AS s FROM named),
fits AS (SELECT *,
  len(h) >= 3 AND h[1] <> '' AND regexp_full_match(h[2], '[0-9]+') AND regexp_full_match(h[3], '[0-9]+') AND TRY_CAST(h[3] AS BIGINT) > TRY_CAST(h[2] AS BIGINT) AS is_bed,
  len(h) >= 5 AND h[1] <> '' AND regexp_full_match(h[4], '[0-9]+') AND regexp_full_match(h[5], '[0-9]+') AND TRY_CAST(h[4] AS BIGINT) >= 1 AND TRY_CAST(h[5] AS BIGINT) >= TRY_CAST(h[4] AS BIGINT) AS is_gff,
  len(h) >= 8 AND h[1] <> '' AND regexp_full_match(h[2], '[0-9]+') AND TRY_CAST(h[2] AS BIGINT) >= 1 AND h[4] NOT IN ('', '.') AND NOT contains(h[8], 'END=') AS is_vcf,
  len(s) >= 6 AND s[3] NOT IN ('', '*') AND regexp_full_match(s[4], '[0-9]+') AND TRY_CAST(s[4] AS BIGINT) >= 1 AND s[6] = '*' AS is_sam FROM kinds),
good AS (SELECT path, told, list_filter([CASE WHEN is_bed THEN 'bed' END, CASE WHEN is_gff THEN 'gff' END, CASE WHEN is_sam THEN 'sam' END, CASE WHEN is_vcf THEN 'vcf' END], lambda x: x IS NOT NULL) AS fitting FROM fits)
SELECT path, CASE WHEN len(told) > 1 THEN NULL WHEN len(told) = 1 THEN CASE WHEN list_contains(fitting, told[1]) THEN told[1] END WHEN len(fitting) = 1 THEN fitting[1] END AS format,
  CASE WHEN len(told) > 1 THEN 'conflict' WHEN len(told) = 1 THEN CASE WHEN list_contains(fitting, told[1]) THEN 'none' ELSE 'row' END WHEN len(fitting) = 1 THEN 'none' ELSE 'unknown' END AS trouble FROM good""")
def format_detect_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file: name, header line, first rows; what the three agree on, or how they don't."""
    i, n = F.col("doc_id"), F.length("text")
    rows = _table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    pick = lambda by, *values: F.element_at(F.array(*values), (i % by + 1).cast("int"))
    tabs = lambda *cells: F.concat_ws("\t", *(F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells))
    path = F.concat(i.cast("string"), pick(7, *map(F.lit, (".bed", ".vcf.gz", ".gff3", ".txt", "", ".SAM", ".bed.gz"))))
    head = pick(5, *map(F.lit, ("##fileformat=VCFv4.3", "##gff-version 3", "# a comment", "@SQ\tSN:c", "c\t7\t9\r")))
    body = pick(3, tabs("c", i, n), tabs("c", i + 1, ".", "A", ".", ".", ".", "DP=1"), tabs("c", "s", "f", i + 1, i + n))
    all_ = rows.select(path.alias("path"), F.posexplode(F.concat(F.array(head, body), F.split("text", "\n", -1))).alias("line_no", "raw"))
    found = detect_files(all_)
    trouble = F.when(F.col("error").isNull(), "none").when(F.col("error").startswith("name and header"), "conflict").when(F.col("error").startswith("the first row"), "row").otherwise("unknown")
    return found.select("path", "format", trouble.alias("trouble"))


#: A request of each form, and of each mistake, by event; ``{t}``, ``{i}`` and ``{j}`` are its type, its id and a number above.
FORMS = ("{t}", "{t}:{i}", "{t}:{i}-{j}", "{t}:{i}-", "{t}:-{j}", "{t}:-", "HLA:{t}:{i}-{j}", "{t}:1,{p}-2,{p}", "{t}:", "{t}:0-{j}", "{t}:{j}-{i}", "{t}:1,{i}x", ":{i}", "{t}:{i}-{j}-3", "{t}:99999999999999999999", "{t}:1,00")


def _form(form: str, sql: bool):
    """A form as SQL text or as a column."""
    parts = re.split(r"(\{[tijp]\})", form)
    if sql:
        told = {"{t}": "event_type", "{i}": "(1 + event_id)", "{j}": "(2 + event_id * 2)", "{p}": "lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0')"}
        return " || ".join(told.get(p) or f"'{p}'" for p in parts if p)
    i = F.col("event_id")
    told = {"{t}": F.col("event_type"), "{i}": (1 + i).cast("string"), "{j}": (2 + i * 2).cast("string"), "{p}": F.lpad((i % 1000).cast("string"), 3, "0")}
    return F.concat(*(told.get(p, F.lit(p)) for p in parts if p))


def _forms_sql(forms: tuple[str, ...]) -> str:
    return f"CASE event_id % {len(forms)} " + " ".join(f"WHEN {k} THEN {_form(f, True)}" for k, f in enumerate(forms)) + " END"


def _forms(forms: tuple[str, ...]):
    return F.element_at(F.array(*(_form(f, False) for f in forms)), (F.col("event_id") % len(forms) + 1).cast("int"))


PLACE = r"^([0-9]{1,3}(,[0-9]{3})+|[0-9]+)$"


@query(rf"""WITH r AS (SELECT event_id, {_forms_sql(FORMS)} AS region FROM events),
c AS (SELECT *, contains(region, ':') AS colon, CASE WHEN contains(region, ':') THEN regexp_extract(region, '^(.*):([^:]*)$', 1) ELSE region END AS name, regexp_extract(region, '^(.*):([^:]*)$', 2) AS span FROM r),
p AS (SELECT *, contains(span, '-') AS dash, CASE WHEN contains(span, '-') THEN substr(span, 1, instr(span, '-') - 1) ELSE span END AS low, CASE WHEN contains(span, '-') THEN substr(span, instr(span, '-') + 1) ELSE '' END AS high FROM c),
n AS (SELECT *, TRY_CAST(replace(low, ',', '') AS HUGEINT) AS a, TRY_CAST(replace(high, ',', '') AS HUGEINT) AS b FROM p),
e AS (SELECT *, CASE WHEN name = '' THEN 'invalid reference name' WHEN colon AND span = '' THEN 'nothing after the colon' WHEN low <> '' AND NOT regexp_matches(low, '{PLACE}') THEN 'invalid position' WHEN low <> '' AND NOT a BETWEEN 1 AND 9223372036854775807 THEN 'position out of range'
  WHEN high <> '' AND NOT regexp_matches(high, '{PLACE}') THEN 'invalid position' WHEN high <> '' AND NOT b BETWEEN 1 AND 9223372036854775807 THEN 'position out of range' WHEN b < coalesce(a, 1) THEN 'ends before it begins' END AS error FROM n)
SELECT event_id, region, CASE WHEN error IS NULL THEN name END AS ref, CASE WHEN error IS NULL THEN CAST(coalesce(a, 1) AS BIGINT) END AS "start", CASE WHEN error IS NULL THEN CAST(CASE WHEN dash THEN b ELSE a END AS BIGINT) END AS "end", error FROM e""")
def region_text_parse_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request text for every event, read by the interval grammar; mistakes are rows."""
    rows = _table(spark, sf_dir, "events").select("event_id", _forms(FORMS).alias("region"))
    return parse_regions(rows)


SEQUENCE_FORMS = ("{t}", "{t}:{i}", "{t}:{i}-{j}", "{t}:1,0-2,0", "{{t}:2-7}", "{{t}}:2-7", "{{t}:2-7}:3-", "{t}:2-7", "{t}:-{j}", "{t}:", "{t}:0-3", "{t}:{j}-{i}", "{{t}", "{t}:x", "no:{t}", "{{t}}9", "{t}:99999999999999999999-")
NAMES_SQL = "lengths AS (SELECT event_type AS name, count(*) AS length FROM events GROUP BY event_type UNION ALL SELECT event_type || ':2-7', count(*) // 2 FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type)"


@query(rf"""WITH {NAMES_SQL}, r AS (SELECT event_id, {_forms_sql(SEQUENCE_FORMS)} AS request FROM events),
c AS (SELECT *, starts_with(request, '{{') AS braced, instr(request, '}}') AS shut, contains(request, ':') AS colon FROM r),
p AS (SELECT *, braced AND (shut = 0 OR NOT regexp_matches(substr(request, shut + 1), '^(:|$)')) AS broken,
  CASE WHEN braced THEN CASE WHEN shut > 0 THEN substr(request, 2, shut - 2) END WHEN colon THEN regexp_extract(request, '^(.*):([^:]*)$', 1) ELSE request END AS name,
  CASE WHEN braced THEN CASE WHEN shut > 0 AND shut < length(request) THEN substr(request, shut + 2) END WHEN colon THEN regexp_extract(request, '^(.*):([^:]*)$', 2) END AS span FROM c),
l AS (SELECT p.*, n.length AS own, w.length AS every FROM p LEFT JOIN lengths n ON n.name = p.name LEFT JOIN lengths w ON w.name = p.request AND NOT braced AND colon),
s AS (SELECT event_id, request, broken, every IS NOT NULL AND own IS NOT NULL AND regexp_matches(span, '^[0-9,]+(-[0-9,]*)?$') AS two, CASE WHEN every IS NULL THEN name ELSE request END AS ref, CASE WHEN every IS NULL THEN span END AS span, coalesce(every, own) AS n FROM l),
d AS (SELECT *, contains(span, '-') AS dash, CASE WHEN contains(span, '-') THEN substr(span, 1, instr(span, '-') - 1) ELSE span END AS low, CASE WHEN contains(span, '-') THEN substr(span, instr(span, '-') + 1) ELSE '' END AS high FROM s),
v AS (SELECT *, TRY_CAST(replace(low, ',', '') AS HUGEINT) AS a, TRY_CAST(replace(high, ',', '') AS HUGEINT) AS b FROM d),
e AS (SELECT *, CASE WHEN broken THEN 'unbalanced braces' WHEN two THEN 'two readings' WHEN n IS NULL THEN 'no sequence' WHEN low <> '' AND (NOT regexp_matches(replace(low, ',', ''), '^[0-9]+$') OR a > 18446744073709551615) THEN 'invalid position' WHEN low = '' AND NOT dash THEN 'nothing after the colon' WHEN a = 0 THEN 'position 0'
  WHEN high <> '' AND (NOT regexp_matches(replace(high, ',', ''), '^[0-9]+$') OR b > 18446744073709551615) THEN 'invalid position' WHEN coalesce(a, 1) > b THEN 'ends before it begins' END AS error, least(coalesce(a, 1) - 1, n) AS x, least(coalesce(b, n), n) AS y FROM v)
SELECT event_id, request, CASE WHEN error IS NULL THEN ref END AS ref, CASE WHEN error IS NULL THEN CAST(x AS BIGINT) END AS "start", CASE WHEN error IS NULL THEN CAST(greatest(x, y) AS BIGINT) END AS "end", error FROM e""")
def region_text_parse_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence request for every event, resolved against names of which some look like ranges of others."""
    events = _table(spark, sf_dir, "events")
    counts = events.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("length"))
    ranges = counts.filter(F.col("name").isin("click", "view")).select(F.concat("name", F.lit(":2-7")).alias("name"), F.expr("length div 2").alias("length"))
    return resolve_regions(events.select("event_id", _forms(SEQUENCE_FORMS).alias("request")), counts.unionByName(ranges))


@query(f"WITH {FA_SQL} SELECT CAST(doc_id AS VARCHAR) AS ref, CAST(length(q) AS BIGINT) AS length, md5(q) AS md5 FROM fa WHERE length(q) > 0")
def seq_length_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.digests(spark, fasta(spark, sf_dir))


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'MT' WHEN 2 THEN 'chr' || doc_id WHEN 3 THEN CAST(doc_id AS VARCHAR) ELSE 'chrM' END AS name FROM documents)
SELECT doc_id, name, CASE WHEN name LIKE 'chr%' THEN substr(name, 4) ELSE 'chr' || name END || CASE name WHEN 'M' THEN ',chrMT,MT' WHEN 'MT' THEN ',chrM,M' ELSE '' END AS aliases FROM n""")
def seq_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 5 == 0, "M").when(i % 5 == 1, "MT").when(i % 5 == 2, F.concat(F.lit("chr"), i.cast("string"))).when(i % 5 == 3, i.cast("string")).otherwise("chrM")
    return _table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).withColumn("aliases", sequences.aliases(F.col("name")))


PARTS = (("3", 10, 250), ("7", 0, 61), ("3", 100, 100000), ("12", 59, 60), ("0", 200000, 200010))


@query(f"WITH {FA_SQL}, p(o, d, a, b) AS (VALUES " + ", ".join(f"({k}, {d}, {a}, {b})" for k, (d, a, b) in enumerate(PARTS)) + ") SELECT CAST(o AS BIGINT) AS ordinal, CAST(d AS VARCHAR) AS ref, substr(q, a + 1, b - a) AS seq FROM p JOIN fa ON fa.doc_id = d")
def seq_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(k, f"{d}:{a}", d, a, b) for k, (d, a, b) in enumerate(PARTS)], "ordinal long, header string, ref string, start long, end long")
    return sequence.fetch(spark, fasta(spark, sf_dir), asked).select("ordinal", "ref", "seq")


@query(f"WITH {FA_SQL} SELECT doc_id, least(19, length(q)) AS \"start\", CAST(least(80, length(q)) AS BIGINT) AS \"end\", substr(q, 20, 61) AS seq FROM fa WHERE length(q) > 0".replace("least(19, length(q))", "CAST(least(19, length(q)) AS BIGINT)"))
def seq_fetch_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request 20-80 of every sequence, clipped to it."""
    rows = stored(spark, fasta(spark, sf_dir), "fasta")  # read three times
    total = rows.groupBy("ref").agg(F.sum("bases").alias("n"), F.min("ref_ordinal").alias("ordinal"))
    asked = total.select("ordinal", F.lit("").alias("header"), "ref", F.least(F.lit(19), "n").cast("long").alias("start"), F.least(F.lit(80), "n").cast("long").alias("end"))
    return sequence.fetch(spark, rows, asked).select(F.col("ordinal").alias("doc_id"), "start", "end", "seq")


@query(f"WITH {FA_SQL} SELECT doc_id, regexp_replace(regexp_replace(q, '(.{{60}})', '\\1' || chr(10), 'g'), '\\n$', '') AS wrapped FROM fa")
def seq_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", sequences.wrap(sequences.graphic(F.col("text")), 60).alias("wrapped"))


REGION_SQL = f"{FA_SQL}, part AS (SELECT doc_id, least(10, length(q)) AS a, length(q) AS b, substr(q, 11) AS p FROM fa WHERE length(q) > 0)"


@query(f"WITH {REGION_SQL}, rows AS (SELECT doc_id, unnest(range(greatest(1, (length(p) + 699) // 700))) AS block, p FROM part WHERE length(p) > 0) "
       "SELECT doc_id, CAST(-1 AS BIGINT) AS block, '>' || doc_id || ':11' AS text FROM part UNION ALL "
       "SELECT doc_id, CAST(block AS BIGINT), regexp_replace(regexp_replace(substr(p, block * 700 + 1, 700), '(.{70})', '\\1' || chr(10), 'g'), '\\n$', '') FROM rows")  # fmt: skip
def seq_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bases of every sequence from the eleventh on, as FASTA text of 70 bases a line, ten lines a row."""
    rows = stored(spark, fasta(spark, sf_dir), "fasta")
    total = rows.groupBy("ref").agg(F.sum("bases").alias("n"), F.min("ref_ordinal").alias("ordinal"))
    asked = total.select("ordinal", F.concat("ref", F.lit(":11")).alias("header"), "ref", F.least(F.lit(10), "n").cast("long").alias("start"), F.col("n").alias("end"))
    asked = stored(spark, asked, "asked")
    text = sequence.fasta_rows(asked, sequence.parts(spark, rows, asked), sequence.build_fai(rows), 70, 700)
    return text.select(F.col("ordinal").alias("doc_id"), "block", "text")


@query(f"WITH {FA_SQL} SELECT CAST(doc_id AS VARCHAR) AS name, CAST(length(q) AS BIGINT) AS length, CAST(length(CAST(doc_id AS VARCHAR)) + 2 AS BIGINT) AS \"offset\", CAST(least(60, length(q)) AS BIGINT) AS line_bases, CAST(least(60, length(q)) + 1 AS BIGINT) AS line_width FROM fa WHERE length(q) > 0")
def fai_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.build_fai(fasta(spark, sf_dir)).drop("ref_ordinal")


@query("SELECT event_id, CAST(100 + (event_id // 60) * 61 + event_id % 60 AS BIGINT) AS at FROM events")
def fai_byte_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", sequences.byte_offset(F.lit(100).cast("long"), F.lit(60).cast("long"), F.lit(61).cast("long"), F.col("event_id")).alias("at"))


STRIDE_SQL = f"""{LINE_SQL}, b AS (SELECT doc_id, line_no, CAST(strlen(seq) AS BIGINT) AS n FROM line),
f AS (SELECT *, first_value(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS stride, line_no = max(line_no) OVER (PARTITION BY doc_id) AS last FROM b)"""


@query(f"WITH {STRIDE_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM f WHERE n = 0 OR (CASE WHEN last THEN n > stride ELSE n <> stride END)")
def fai_stride_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("seq").cast("long")
    rows = lines(spark, sf_dir).select(F.col("doc_id").alias("ref"), F.col("line_no").cast("long").alias("line_in_ref"), n.alias("bases"), (n + 1).alias("width"))
    return sequence.stride_violations(rows).select(F.col("ref").alias("doc_id"), F.col("line_in_ref").alias("line_no"))


BLOCK = 512
BLOCK_SQL = f"bl AS (SELECT doc_id, k AS block_no, CAST(least({BLOCK}, strlen(text) - k * {BLOCK}) AS BIGINT) AS usize, CAST(k * {BLOCK} AS BIGINT) AS uoffset FROM (SELECT doc_id, text, unnest(range((strlen(text) + {BLOCK - 1}) // {BLOCK})) AS k FROM documents))"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as archives of blocks of ``BLOCK`` bytes."""
    size = F.octet_length("text").cast("long")
    rows = _table(spark, sf_dir, "documents").filter(size > 0).select("doc_id", size.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), ((size - 1) / BLOCK).cast("long"))).alias("block_no"))
    sized = rows.withColumn("usize", F.least(F.lit(BLOCK), F.col("n") - F.col("block_no") * BLOCK).cast("long"))
    order = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("doc_id", "block_no", "usize", F.coalesce(F.sum("usize").over(order), F.lit(0)).alias("uoffset"))


@query(f"WITH {BLOCK_SQL} SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, usize, uoffset FROM bl")
def block_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


@query(f"WITH {BLOCK_SQL} SELECT doc_id, CAST(max(block_no) AS BIGINT) AS block_no, CAST(1000 - max(uoffset) AS BIGINT) AS skip FROM bl WHERE uoffset <= 1000 GROUP BY doc_id")
def block_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of content byte 1000, or of the last byte before it."""
    known = _table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0).select("doc_id", F.lit(1000).cast("long").alias("at"))
    starts = _blocks(spark, sf_dir).select("doc_id", F.col("uoffset").alias("at"), "block_no", "uoffset")
    return asof.asof_join(known, starts, "at", ["doc_id"]).select("doc_id", "block_no", (F.col("at") - F.col("uoffset")).alias("skip"))


@query(f"""WITH {LINE_SQL}, {BLOCK_SQL}, l AS (SELECT doc_id, line_no, sum(strlen(seq) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - strlen(seq) - 1 AS pos FROM line)
SELECT l.doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(block_no AS BIGINT) AS block_no, CAST(pos - uoffset AS BIGINT) AS skip FROM l ASOF LEFT JOIN bl ON l.doc_id = bl.doc_id AND bl.uoffset <= l.pos""")
def line_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block in which each line of each text begins, and where in it."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long"), F.octet_length("seq").cast("long").alias("n"))
    placed = rows.select("doc_id", "line_no", F.coalesce(F.sum(F.col("n") + 1).over(order), F.lit(0)).alias("at"))
    starts = _blocks(spark, sf_dir).select("doc_id", F.col("uoffset").alias("at"), "block_no", "uoffset")
    return asof.asof_join(placed, starts, "at", ["doc_id"]).select("doc_id", "line_no", "block_no", (F.col("at") - F.col("uoffset")).alias("skip"))


ASCII_SQL = r"txt AS (SELECT doc_id, regexp_replace(text, '[^ -~\n]', '', 'g') AS t FROM documents WHERE text IS NOT NULL)"


def _archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(doc_id, t), the texts in ASCII, and an archive of them in the order of their ids, a line feed behind each."""
    rows = _table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_replace("text", "[^ -~\n]", "").alias("t"))
    folder = f"{shared_dir(spark)}/scratch/texts-{uuid.uuid4().hex}"
    source = splits.write_lines(rows.select("doc_id", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "raw")), [F.col("doc_id"), F.col("line_no")], f"{folder}/plain")
    splits.write_archive(spark, source, f"{folder}/texts.gz", split=ARCHIVE_SPLIT)
    return rows, f"{folder}/texts.gz"


#: Small, so that small tables are several splits.
ARCHIVE_SPLIT = 1 << 18
FULL = 65239


@query(f"""WITH RECURSIVE {ASCII_SQL}, line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS seq, unnest(range(len(string_split(t, chr(10))))) AS line_no FROM txt),
ln AS (SELECT length(seq) + 1 AS n, sum(length(seq) + 1) OVER (ORDER BY doc_id, line_no) AS e FROM line), total AS (SELECT max(e) AS size FROM ln),
ways AS (SELECT 0 AS pos UNION SELECT e FROM ln UNION SELECT unnest(range(CAST(e - n + {FULL} AS BIGINT), CAST(e AS BIGINT), {FULL})) FROM ln),
nxt AS (SELECT w.pos, CASE WHEN w.pos + {FULL} > size THEN size WHEN ln.e > w.pos THEN ln.e ELSE w.pos + {FULL} END AS stop FROM (SELECT pos, pos + {FULL} AS reach, size FROM ways, total) w ASOF LEFT JOIN ln ON ln.e <= w.reach),
cut AS (SELECT CAST(0 AS BIGINT) AS block_no, pos, stop FROM nxt WHERE pos = 0 UNION ALL SELECT block_no + 1, nxt.pos, nxt.stop FROM cut JOIN nxt ON nxt.pos = cut.stop, total WHERE cut.stop < size)
SELECT block_no, CAST(pos AS BIGINT) AS uoffset, CAST(stop - pos AS BIGINT) AS usize FROM cut""")
def archive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of an archive of all texts: cut and written in splits, found again in other splits without an index."""
    return splits.manifest(spark, _archive(spark, sf_dir)[1], split=ARCHIVE_SPLIT // 2).select("block_no", "uoffset", "usize")


@query(f"WITH {ASCII_SQL} SELECT doc_id, CAST(length(t) AS BIGINT) AS n, md5(t) AS md5 FROM txt WHERE length(t) > 0")
def archive_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a range of the archive's content: planned on the block table, inflated in tasks."""
    rows, path = _archive(spark, sf_dir)
    placed = ranked(spark, rows.select("doc_id", F.length("t").cast("long").alias("size"), (F.length("t") + 1).cast("long").alias("step")), [F.col("doc_id")], "place", {"offset": "step"})
    blocks = stored(spark, splits.manifest(spark, path, split=ARCHIVE_SPLIT), "blocks")
    pieces = splits.read_ranges(spark, path, placed.select(F.col("doc_id").alias("id"), "offset", "size"), blocks)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", F.col("data").cast("string").alias("data")))), lambda x: x["data"]), "")
    return pieces.groupBy(F.col("id").alias("doc_id")).agg(text.alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("md5"))


@query(f"WITH {BLOCK_SQL} SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, CAST(greatest(700 - uoffset, 0) AS BIGINT) AS skip, CAST(least(1500 - uoffset, usize) - greatest(700 - uoffset, 0) AS BIGINT) AS take FROM bl WHERE uoffset < 1500 AND uoffset + usize > 700")
def block_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanframe.sources.archive import range_of

    return range_of(_blocks(spark, sf_dir), 700, 800).select("doc_id", "block_no", "skip", "take")


@query(f"WITH {LINE_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM line WHERE starts_with(seq, 'T')")
def comment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    return lines(spark, sf_dir).filter(records.is_comment(F.col("seq"), replace(PRESETS["bed"], comment="T"))).select("doc_id", F.col("line_no").cast("long"))


@query(f"WITH {LINE_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM line WHERE line_no < coalesce((SELECT min(l.line_no) FROM line l WHERE l.doc_id = line.doc_id AND NOT starts_with(l.seq, 'T')), 1000000000)")
def header_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanframe.sources.text import header_lines

    rows = lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("record_id"), F.col("seq").alias("raw"))
    return header_lines(rows, "T", "doc_id").select("doc_id", F.col("record_id").alias("line_no"))


@query(f"WITH {LINE_SQL} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no FROM line WHERE line_no >= 2 AND NOT starts_with(seq, 'T')")
def skip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    config = replace(PRESETS["bed"], comment="T", skip=2)
    return lines(spark, sf_dir).filter(~records.is_meta(F.col("seq"), F.col("line_no") + 1, config)).select("doc_id", F.col("line_no").cast("long"))


@query(f"WITH {EV_SQL}, {_values(REGIONS)} SELECT count(*) AS n_matches, count(DISTINCT record_id) AS n_records, count(DISTINCT v.ref) AS n_references, CAST(sum(least(e, coalesce(b, e)) - greatest(s, a) + 1) AS BIGINT) AS n_bases FROM ev v JOIN req ON {MEETS}")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = overlap.requests_df(spark, _asked(REGIONS))
    found = overlap.overlap_join(ev(spark, sf_dir), asked, "broadcast").join(F.broadcast(asked.select("ordinal", F.col("start").alias("a"), F.col("end").alias("b"))), "ordinal")
    bases = F.least("end", F.coalesce("b", "end")) - F.greatest("start", "a") + 1
    return found.agg(F.count(F.lit(1)).alias("n_matches"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("ref").alias("n_references"), F.sum(bases).alias("n_bases"))


VPOS_SQL = "SELECT event_id, CAST((event_id * 1000) * 65536 + event_id % 65536 AS BIGINT) AS vpos, CAST(event_id * 1000 AS BIGINT) AS coffset, CAST(event_id % 65536 AS BIGINT) AS uoffset FROM events"


@query(VPOS_SQL)
def virtual_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", coords.virtual_position(F.col("event_id") * 1000, F.col("event_id") % 65536).alias("vpos"))
    return rows.select("event_id", "vpos", coords.compressed_part(F.col("vpos")).alias("coffset"), coords.inner_part(F.col("vpos")).alias("uoffset"))


@query("SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '\\r$', '') AS line, CAST(nullif(regexp_extract('##contig=<ID=c,length=' || doc_id || '>', 'length=([0-9]+)', 1), '') AS BIGINT) AS declared FROM documents")
def line_trim_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("##contig=<ID=c,length="), F.col("doc_id").cast("string"), F.lit(">"))
    first = F.substring_index(F.col("text"), "\n", 1)
    return _table(spark, sf_dir, "documents").select("doc_id", records.trim_end(first).alias("line"), records.declared_length(raw, PRESETS["vcf"]).alias("declared"))


@query("""WITH r AS (SELECT event_id, event_type || chr(9) || event_id || chr(9) || (event_id + 1 + CAST(floor(value) AS BIGINT)) AS raw FROM events)
SELECT event_id AS record_id, split_part(raw, chr(9), 1) AS ref, CAST(split_part(raw, chr(9), 2) AS BIGINT) + 1 AS "start", CAST(split_part(raw, chr(9), 3) AS BIGINT) AS "end" FROM r""")
def parse_bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws("\t", "event_type", F.col("event_id").cast("string"), (F.col("event_id") + 1 + F.floor("value")).cast("string"))
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), (F.col("event_id") + 1).alias("line_no"), raw.alias("raw"))
    return records.records(rows, PRESETS["bed"]).select("record_id", "ref", "start", "end")


@query("SELECT '@SQ' || chr(9) || 'SN:' || doc_id || chr(9) || 'LN:' || length(q) || chr(9) || 'M5:' || md5(q) || chr(9) || 'AN:chr' || doc_id || chr(9) || 'UR:file:///d.fa' AS line FROM (SELECT doc_id, upper(regexp_replace(text, '[^!-~]', '', 'g')) AS q FROM documents) WHERE length(q) > 0")
def dictionary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.dictionary(spark, fasta(spark, sf_dir), alias=True, uri="file:///d.fa").select("line")
