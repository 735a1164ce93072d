"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed. The ledger holds what each pair of
blob and rule version was found to contain; only pairs that it lacks are scanned,
each once however many paths share the blob, and findings are joined back to all
paths. Scanning uses regular-expression and array functions of Spark only.

Positions are sums: a text with matches is split at them, and what lies between them
and the matches themselves are added up in order, in a window over one row a match.
The time follows the number of matches. Only blobs that occur again, or that the ledger
may know, are shuffled with their texts; a bitmap lets the others pass.

Defined cases: a null text counts as empty; an empty table gives no rows; rows
that repeat are all returned; paths may be null; texts of any length are scanned whole;
a pair that overlapping runs appended twice is read once; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.plans.bitmap import split
from spanframe.plans.scratch import shared_dir, stored

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """``hint`` (SQL over ``text``) is true wherever the pattern can match; ``value`` and ``least`` bound a group's length.

    A match may not follow a character of ``apart``: a run of such characters is tried once, at its begin.
    """

    kind: str
    pattern: str
    hint: str
    base: bool = True
    value: int = 0
    least: int = 0
    apart: str = ""

    @property
    def search(self) -> str:
        return f"(?<![{self.apart}]){self.pattern}" if self.apart else self.pattern


#: A run that is as long as it can be needs no second test: the length is in the pattern. Assignments are filtered after matching.
RULES = (
    Rule("assign", ASSIGN, "contains(lower(text), 'passw') OR contains(lower(text), 'secret') OR contains(lower(text), 'token') OR contains(lower(text), 'api')", value=2, least=12),
    Rule("access", "AKIA[A-Z0-9]{14,}", "contains(text, 'AKIA')"),
    Rule("hex", "[0-9a-f]{16,}", "text RLIKE '[0-9a-f]{16}'"),
    Rule("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "contains(text, '-----BEGIN ')", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "contains(text, 'eyJ')", base=False, apart="A-Za-z0-9_-"),
)

SPAN = "struct<start:int,rule:int,end:int>"
LEDGER = f"blob string, rules string, found array<{SPAN}>"


def version(rules: Sequence[Rule]) -> str:
    return hashlib.sha256(repr([(r.kind, r.search, r.value, r.least) for r in rules]).encode()).hexdigest()[:16]


def _hits(rule: Rule) -> Column:
    """The matches of a rule in the column ``text``."""
    return F.when(F.expr(rule.hint), F.call_function("regexp_extract_all", F.col("text"), F.lit(rule.search), F.lit(0))).otherwise(F.array().cast("array<string>"))


def found(texts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, found) for those of ``texts`` (blob, text; one row a blob) with matches: 0-based code points, ends exclusive, by start and then rule."""
    hits = texts.select("blob", "text", *(_hits(r).alias(f"hits{k}") for k, r in enumerate(rules)))
    some = hits.filter(" OR ".join(f"size(hits{k}) > 0" for k in range(len(rules))))

    def parts(rule: Rule, k: int) -> Column:
        """For each match: the length of what comes before it, its own, and whether it is long enough."""
        good = (lambda hit: F.length(F.regexp_extract(hit, rule.pattern, rule.value)) >= rule.least) if rule.least else (lambda hit: F.lit(True))
        between = F.when(F.size(f"hits{k}") > 0, F.split("text", rule.search, -1)).otherwise(F.array().cast("array<string>"))
        gaps = F.transform(between, lambda gap: F.length(gap))
        matched = F.transform(F.col(f"hits{k}"), lambda hit: F.struct(F.length(hit).alias("size"), good(hit).alias("good")))
        both = F.arrays_zip(gaps.alias("gap"), matched.alias("hit"))
        return F.filter(F.transform(both, lambda x, i: F.struct(F.lit(k).alias("rule"), i.alias("i"), x["gap"].alias("gap"), x["hit"].alias("hit"))), lambda x: x["hit"].isNotNull())

    each = some.select("blob", F.explode(F.concat(*(parts(r, k) for k, r in enumerate(rules)))).alias("m")).select("blob", "m.*")
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("hit.size")).over(upto).cast("int")).filter("hit.good")
    span = F.struct((F.col("end") - F.col("hit.size")).alias("start"), "rule", "end")
    return placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("found"))


def scan(spark: SparkSession, versions: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, found) for each row of ``versions``; the ledger at the path ``ledger`` gains the pairs it lacked.

    Without a path the ledger is a new one in the shared folder, so every blob is scanned once.
    """
    now, ledger = version(rules), ledger or f"{shared_dir(spark)}/scratch/ledger-{uuid.uuid4().hex}"
    spark.range(0).select(F.lit("").alias("blob"), F.lit("").alias("rules"), F.array().cast(f"array<{SPAN}>").alias("found")).write.mode("ignore").parquet(ledger)
    rows = versions.select(F.col(key).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = stored(spark, rows.select("path", "blob"), "paths")
    entries = lambda: spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == now)
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("times"))
    unseen = stored(spark, blobs.join(entries().select("blob"), "blob", "left_anti"), "unseen")
    # a blob that comes once and has no entry needs no look at others
    again = blobs.filter("times > 1").select("blob").union(entries().select("blob"))
    maybe, once = split(spark, rows, F.col("blob"), again, F.col("blob"))
    maybe, wanted = maybe.alias("r"), unseen.alias("u")
    picked = maybe.join(wanted, F.col("r.path").eqNullSafe(F.col("u.path")) & (F.col("r.blob") == F.col("u.blob"))).select("r.blob", "r.text").dropDuplicates(["blob"])
    scanned = stored(spark, found(once.select("blob", "text").union(picked), rules), "found")
    empty = F.array().cast(f"array<{SPAN}>")
    unseen.select("blob").join(scanned, "blob", "left").select("blob", F.lit(now).alias("rules"), F.coalesce("found", empty).alias("found")).write.mode("append").parquet(ledger)
    # overlapping runs may append a pair twice; written, so that a blob with very many paths can be split
    known = stored(spark, entries().groupBy("blob").agg(F.first("found").alias("found")), "known")
    return paths.join(known, "blob").select(F.col("path").alias(key), "blob", "found")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    base = sum(r.base for r in RULES)
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")
    own = F.filter("found", lambda s: s["rule"] < base)
    out = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("found", lambda s: s["rule"] == k)).cast("long")
    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(RULES) if r.base]
    return out.select("doc_id", *counts, F.sha2(told(own), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


def _sql() -> str:
    kinds = [("assign", ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"), *((r.kind, r.pattern) for r in RULES if not r.base)]
    apart = {r.kind: r.apart for r in RULES}
    part = "SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}', 1)) AS gap, unnest(regexp_extract_all(t, '{p}', 2)) AS hit, {value} AS value, unnest(range(len(regexp_extract_all(t, '{p}', 1)))) AS i FROM d"
    parts = []
    for k, (kind, pattern) in enumerate(kinds):
        flags = "(?is)" if pattern.startswith("(?i)") else "(?s)"
        # what lies before a match, without a look behind: nothing, or it ends in a character that may
        lead = f"((?:.*?[^{apart[kind]}])??)" if apart[kind] else "(.*?)"
        p = (f"{flags}{lead}(" + pattern.removeprefix("(?i)") + ")").replace("'", "''")
        parts.append(part.format(k=k, kind=kind, p=p, value=f"unnest(regexp_extract_all(t, '{p}', 4))" if kind == "assign" else "''"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS e FROM raw),
good AS (
  SELECT doc_id, k, kind, e - length(hit) AS s, e FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(value) >= 12 WHEN 'access' THEN length(hit) >= 18 WHEN 'hex' THEN length(hit) >= 16 ELSE true END),
per AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)"""


OP9_SQL = _sql()
