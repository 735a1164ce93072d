"""Quality rules: learned decision lists over text statistics.

Statistics of whole texts are computed in Arrow batches. A bounded sample of
labelled rows teaches an ordered list of rules, each a conjunction of thresholds:
a rule grows condition by condition on one part of the sample, is pruned on the
other, and joins the list if it stays precise there; what it covers is taken out
and the next one grows. The list leaves Python as one Spark conditional expression.

Defined cases: a null or empty text has no words and fails the base rules; labels
that are null, missing or of one class teach nothing, and the base rules decide
alone; an empty table gives no rows; rows that repeat are judged alike; texts of any
length are counted whole; other columns pass through ``keep_good``, whatever their names;
a key that repeats counts once in the sample of labels.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.columns import small_batches
from spanframe.plans.bitmap import unused

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")
BLANKS, SYMBOLS, MARKS = " \t\n\v\f\r", "#*$%&|<>", "!?"
MAX_LABELLED = 8000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 64
LEAST_PRECISION, LEAST_COVER = 0.95, 8


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    found, end = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            found += i + 3 - max(i, end)
            end = i + 3
    return found


def counts(text: str | None) -> tuple[int, ...]:
    """The statistics of ``COUNTS`` for a whole text; words are runs without ASCII white space."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), text.split("\n")
    seen: set[str] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.strip(BLANKS))
        else:
            seen.add(line)
    data = np.frombuffer(raw, np.uint8)
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), again, repeated_words(words), len(lines), len(set(words)),
        int(((data >= 65) & (data <= 90)).sum()), int(((data >= 48) & (data <= 57)).sum()), sum(map(text.count, MARKS)),
    )


def statistics(text: Column) -> Column:
    """A struct of ``COUNTS``."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(x) for x in texts], columns=list(COUNTS), dtype="int64")

    return F.pandas_udf(run, ", ".join(f"{c} long" for c in COUNTS))(text)


def features(s: Column) -> dict[str, Column]:
    """What rules test: ratios of the statistics, which don't depend on a text's length."""
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return {
        "symbols_per_word": s["n_symbols"] / words,
        "marks_per_word": s["n_marks"] / words,
        "upper_share": s["n_upper"] / chars,
        "digit_share": s["n_digits"] / chars,
        "repeat_share": s["n_repeat_words"] / words,
        "distinct_share": s["n_distinct"] / words,
        "dup_line_share": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "word_length": s["word_chars"] / words,
        "words_per_line": s["n_words"] / F.greatest(s["n_lines"], F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def of(self, x: np.ndarray) -> np.ndarray:
        return x >= self.cut if self.above else x < self.cut


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    inside = np.ones(n, bool)
    for c in rule:
        inside &= c.of(x[c.feature])
    return inside


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, on: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = on.copy()
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if not p0 or not n0:
            break
        best = (0.0, None)
        for name, values in x.items():
            for cut in np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, CUTS))):
                for above in (True, False):
                    covered = inside & (values >= cut if above else values < cut)
                    p, n = (covered & bad).sum(), (covered & ~bad).sum()
                    if p:  # information gained by the positives that stay covered
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].of(x[best[1].feature])
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 1) -> list[Rule]:
    """An ordered list of rules that say "bad", from features and labels."""
    n, rules = len(bad), []
    grown = np.random.default_rng(seed).random(n) < 2 / 3
    left = np.ones(n, bool)
    while len(rules) < MAX_RULES and (left & grown & bad).sum() >= LEAST_COVER:
        rule = _grow(x, bad, left & grown)

        def worth(rule: Rule) -> tuple[float, int]:
            inside = _covered(rule, x, n) & left & ~grown
            p, n_ = (inside & bad).sum(), (inside & ~bad).sum()
            return (p - n_) / max(1, p + n_), -len(rule)

        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        inside = _covered(rule, x, n) & left
        held, p = inside & ~grown, (inside & bad).sum()
        if p < LEAST_COVER or ((held & bad).sum() + 1) / (held.sum() + 2) < min(LEAST_PRECISION, 1 - 1 / (held.sum() + 2)) or (held & bad).sum() == 0:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def expression(rules: list[Rule], x: dict[str, Column]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for c in rule:
            holds = holds & (x[c.feature] >= c.cut if c.above else x[c.feature] < c.cut)
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most about ``max_labelled`` labelled rows, chosen by a hash of their key."""
    labels = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("__label"))
    n = labels.count()
    few = labels.filter(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < min(1 << 20, (max_labelled << 20) // max(n, 1)))
    # at most about max_labelled pairs of a key and a label: small by construction
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(few.select(F.col(key).alias("k"), "__label")), "k")
    rows = rows.groupBy("k").agg(F.min("t").alias("t"), F.min("__label").alias("__label")).withColumn("s", statistics(F.col("t"))).select("__label", "s")
    x = features(F.col("s"))
    found = rows.select(F.col("__label").cast("double").alias("__label"), *(c.cast("double").alias(k) for k, c in x.items())).toPandas()
    found = found.sort_values(list(found.columns), kind="stable")  # the same order on every run
    bad = found["__label"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    return learn({k: found[k].to_numpy() for k in x}, bad)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


VERDICT = ("__s", "__base", "__rule")


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", names: tuple[str, str, str] = VERDICT, **options) -> DataFrame:
    """``docs`` with three columns of ``names``: statistics, whether the base rules failed, and the first learned rule that holds (or 0)."""
    small_batches(spark)
    rules = train(spark, docs, labels, key, text, **options)
    counts_, base, rule = names
    s = F.col(counts_)
    return docs.withColumn(counts_, statistics(F.col(text))).withColumns({base: base_failed(s), rule: expression(rules, features(s))})


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor a learned rule rejects."""
    names = tuple(unused(docs, *VERDICT))
    return judge(spark, docs, labels, names=names, **options).filter(~F.col(names[1]) & (F.col(names[2]) == 0)).drop(*names)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(spark, docs.select("doc_id", "text"), labels)
    return out.select("doc_id", *(F.col("__s")[c].alias(c) for c in COUNTS[:5]), F.col("__base").alias("base_failed"), (~F.col("__base") & (F.col("__rule") == 0)).alias("kept"), F.col("__rule").alias("rule"))
