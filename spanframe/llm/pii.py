"""Personal data by candidate gradient boosting.

Patterns with checks find the base spans. Beside them, generators of high recall
propose overlapping candidates: every window of neighbouring digit groups, and
anything that reads like an address with or without its signs. Boosted trees score
a candidate by its format and by the words and signs around it; a threshold for
each kind, calibrated on examples held out of training, says which are added.

The trees are trained here, on examples that ``examples`` draws with a fixed seed:
formats that the base patterns miss, and numbers and words that only look like
them. Training takes seconds and its result goes with the closure.

Addresses are searched outwards from their sign and groups of digits are joined by at
most ``GAP`` signs, so the time follows a text's length whatever it consists of: very
long texts and runs without a blank are read whole.

Defined cases: a null text counts as empty; an empty table gives no rows; rows that
repeat are all returned; other columns are ignored, whatever their names. Added spans
touch neither base spans nor one another. Offsets are code points from 0, ends exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.columns import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Matches of these begin where a run of digits begins: were it in the middle, the run's begin would match as well.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    """Whether the parts between dots are digits alone and at most 255."""
    return all(part.isdecimal() and len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in text.split("."))


def addresses(text: str, signs: Iterable[tuple[int, int, re.Pattern]]) -> Iterator[tuple[int, int]]:
    """Spans of a local part, a sign (from, to, what must follow) and what follows it, none into the one before."""
    least = 0
    for begin, end, domain in signs:
        if begin < least:
            continue
        local = text[least:begin]
        size = len(local) - len(local.rstrip(LOCAL))
        follows = domain.match(text, end) if size else None
        if follows:
            yield begin - size, follows.end()
            least = follows.end()
        else:
            least = begin  # no local part reaches back over a sign


def base_spans(text: str) -> list[Span]:
    """Spans by kind and start. What a pattern needs is looked for first, as most texts have none of it."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, b, 0) for a, b in addresses(text, ((m.start(), m.end(), DOMAIN) for m in re.finditer("@", text)))]
    if DIGIT.search(text):
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if _octets(m[0])]
        for m in CARD.finditer(text):
            if len(m[0]) >= 16:
                digits = "".join(DIGITS.findall(m[0]))
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return found


GAP = 5
#: A run of digit groups; its groups, with what joins them, are the windows' ends.
RUN = re.compile(rf"[+(]{{0,2}}[0-9]++(?:[().\x20/+-]{{1,{GAP}}}+[0-9]++)*+")
#: The sign of an address or a bracketed word for it; a bare "at" needs a bare "dot" as well.
SIGN = re.compile(r" ?(?:@|[\[({] ?at ?[\])}]) ?|( at )", re.IGNORECASE)
SIGNED = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot )[A-Za-z0-9-]++)++", re.IGNORECASE)
BARE = re.compile(r"[A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++", re.IGNORECASE)
MAYBE_SPOKEN = re.compile(r"@|[\[({] ?at ?[\])}]| at [A-Za-z0-9-]+ dot ", re.IGNORECASE)


def candidates(text: str) -> Iterator[Span]:
    """Overlapping spans that may be personal data."""
    if MAYBE_SPOKEN.search(text):
        for start, end in addresses(text, ((m.start(), m.end(), BARE if m[1] else SIGNED) for m in SIGN.finditer(text))):
            yield start, end, 0
    if not DIGIT.search(text):
        return
    for run in RUN.finditer(text):
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in DIGITS.finditer(run[0])]
        for i, (start, _) in enumerate(groups):
            begin = start
            while begin > run.start() and text[begin - 1] in "+(":
                begin -= 1
            digits = ""
            for j in range(i, len(groups)):
                digits += text[groups[j][0] : groups[j][1]][:20]
                if len(digits) > 19:
                    break
                end = groups[j][1]
                if j - i == 3 and text[start:end].count(".") == 3 and _octets(text[start:end].replace(" ", "")):
                    yield begin, end, 1
                if len(digits) >= 13 and luhn(digits):
                    yield begin, end, 2
                if 7 <= len(digits) <= 15:
                    yield begin, end, 3


WORDS = {
    0: re.compile(r"mail|contact|write|reach|kontakt|correo|courriel", re.IGNORECASE),
    1: re.compile(r"\bip\b|host|server|address|login|addr", re.IGNORECASE),
    2: re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta", re.IGNORECASE),
    3: re.compile(r"phone|call|tel|mobile|cell|fax|anruf|appel|ring", re.IGNORECASE),
}
OTHER = re.compile(r"order|invoice|version|serial|isbn|part|item|page|date|total|price|ref|build|line|id\b", re.IGNORECASE)
SPOKEN, LAST = re.compile(r"\b(?:at|dot)\b", re.IGNORECASE), re.compile(r"[^. )\]}]*$")
NAMES = ("kind", "digits", "length", "groups", "first", "last", "longest", "shortest", "spaces", "dashes", "dots", "parens", "plus", "slashes", "luhn", "octets", "left_letter", "right_letter", "left_digit", "right_digit", "left_joint", "right_joint", "says_kind", "says_other", "at", "spoken", "letters", "tld", "starts")


def _beside(text: str, start: int, kind: int) -> tuple:
    """What stands to the left."""
    left = text[max(0, start - 24) : start]
    return (left[-1:].isalpha(), left.rstrip(" ")[-1:].isdigit(), left[-1:] in tuple(".-/_#=$%,:+"), bool(WORDS[kind].search(left)), bool(OTHER.search(left)))


def _behind(text: str, end: int) -> tuple:
    """What stands to the right."""
    right = text[end : end + 12]
    return (right[:1].isalpha(), right.lstrip(" ")[:1].isdigit(), right[:1] in tuple("-/_%$+@"))


def describe(text: str, span: Span, beside=_beside, behind=_behind) -> list[float]:
    start, end, kind = span
    body = text[start:end]
    groups = DIGITS.findall(body)
    digits = "".join(groups)
    sizes = list(map(len, groups)) or [0]
    left_letter, left_digit, left_joint, says_kind, says_other = beside(text, start, kind)
    right_letter, right_digit, right_joint = behind(text, end)
    spoken, letters = (len(SPOKEN.findall(body)), sum(map(str.isalpha, body))) if kind == 0 else (0, 0)
    return [
        kind, len(digits), len(body), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), body.count(" "), body.count("-"), body.count("."), body.count("("), body.startswith(("+", "(+")), body.count("/"),
        luhn(digits), kind == 1 and bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups), left_letter, right_letter, left_digit, right_digit, left_joint, right_joint,
        says_kind, says_other, body.count("@"), spoken, letters, len(LAST.search(body)[0]), int(digits[:1] or 0),
    ]


def examples(n: int, seed: int) -> list[tuple[str, Span, bool]]:
    """(text, span, whether it is personal data): formats and contexts drawn at random."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvy") for _ in range(r.randint(2, 9)))

    def card(k: int) -> str:
        head = r.choice("3456") + digit(k - 2)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def parted(x: str, joint: str) -> str:
        sizes = (4, 6, 5) if len(x) == 15 else (4, 4, 4, 4, 4)
        out, at = [], 0
        for s in sizes:
            out.append(x[at : at + s])
            at += s
        return joint.join(p for p in out if p)

    def yes(kind: int) -> str:
        if kind == 0:
            at, dot = r.choice([("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" @ ", ".")])
            return f"{word()}{r.choice(['.', '_', ''])}{r.choice([word(), digit(2), ''])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'example' + dot + 'com'])}".replace(".@", "@").replace(". ", " ").replace(".(", "(")
        if kind == 1:
            return ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == 2:
            return parted(card(r.choice([16, 16, 16, 15, 13])), r.choice(["", " ", "-", "."]))
        a, b, c = r.choice("23456789") + digit(2), digit(3), digit(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"+{r.randint(30, 99)} {digit(3)} {digit(7)}", f"00{r.randint(30, 99)} {digit(3)} {digit(6)}"])

    def no(kind: int) -> str:
        if kind == 0:
            return r.choice([f"{word()} at {word()}. {word().title()}", f"{word()} at {word()} dot {word()} {word()}", f"{word()} @ {word()} ... {word()}", f"{word()} at {word()}.{word()}"])
        if kind == 1:
            return r.choice([".".join(str(r.randint(0, 999)) for _ in range(4)) if r.random() < 0.5 else f"{r.randint(256, 999)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(256, 999)}", f"{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(300, 9999)}"])
        if kind == 2:
            bad = card(16)
            bad = bad[:-1] + str((int(bad[-1]) + r.randint(1, 9)) % 10)
            return r.choice([bad, parted(bad, r.choice(" -")), digit(13), digit(14), digit(18), f"{digit(5)} {digit(9)}", f"20{digit(2)}-{digit(2)}-{digit(2)} {digit(2)} {digit(2)} {digit(2)}"])
        return r.choice([digit(7), digit(8), digit(10), digit(12), f"20{digit(2)}-{digit(2)}-{digit(2)}", f"{digit(2)}/{digit(2)}/20{digit(2)}", f"{digit(3)}.{digit(4)}", f"{digit(1)}.{digit(2)}.{digit(4)}", f"{digit(4)} {digit(4)}", f"{digit(2)} {digit(2)} {digit(2)} {digit(2)}", f"{digit(5)}-{digit(4)}", f"{digit(3)} {digit(5)} {digit(3)}"])

    says = {0: ["email", "mail me", "contact", "write to"], 1: ["ip", "host", "server address", "login from"], 2: ["card", "visa", "credit card", "paid with card"], 3: ["phone", "call", "tel", "mobile"]}
    others = ["order", "invoice", "version", "serial", "part", "item", "ref", "total", "id"]
    out = []
    while len(out) < n:
        kind, good = r.randrange(4), r.random() < 0.5
        body = (yes if good else no)(kind)
        hint = r.choice(says[kind]) if r.random() < (0.4 if good else 0.1) else r.choice(others) if r.random() < (0.03 if good else 0.5) else word()
        prefix = " ".join(word() for _ in range(r.randint(0, 4))) + " " + hint + r.choice([" ", ": ", " ", " "] if good else [" ", ": ", " ", "-", "#", "$", "."])
        beside = None
        if good and kind and r.random() < 0.4:  # two finds side by side
            other = r.choice([1, 2, 3])
            mate = yes(other)
            beside = (len(prefix), len(prefix) + len(mate), other)
            prefix += mate + " "
        text = prefix + body + r.choice([" ", ". ", ", ", "\n"] if good else [" ", ". ", "-", "/", "%", ", "]) + word()
        span = (len(prefix), len(prefix) + len(body), kind)
        out += [(text, s, good) for s in (span, beside) if s]
        if good and kind:  # windows that cut or stretch the true one are wrong
            wrong = [c for c in candidates(text) if c not in (span, beside)]
            out += [(text, c, False) for c in r.sample(wrong, min(2, len(wrong)))]
    return out[:n]


ROUNDS, DEPTH, RATE, BINS = 80, 3, 0.2, 24
LEAST_PRECISION = 0.997
SCORED = 4096  # candidates described at once


class Boosted:
    """Trees of one depth over binned features, each fitted to the log-loss gradient of those before."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.cuts = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
        bins = self._bins(x)
        score, self.trees = np.zeros(len(y)), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), int), []
            for depth in range(DEPTH):
                splits = {}
                for k in range(1 << depth):
                    inside = node == k
                    if inside.sum() < 10:
                        splits[k] = (0, len(self.cuts[0]) + 1)
                        continue
                    best = (-1.0, 0, 0)
                    for f in range(bins.shape[1]):
                        b = bins[inside, f]
                        gs, hs = np.cumsum(np.bincount(b, g[inside], BINS + 1)), np.cumsum(np.bincount(b, h[inside], BINS + 1))
                        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1)
                        c = int(gain[:-1].argmax())
                        if gain[c] > best[0] + 1e-12:
                            best = (float(gain[c]), f, c)
                    splits[k] = best[1:]
                tree.append([splits[k] for k in range(1 << depth)])
                feature, cut = np.array(tree[-1]).T
                node = 2 * node + (bins[np.arange(len(node)), feature[node]] > cut[node])
            leaf = np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
            score += RATE * leaf[node]
            self.trees.append((tree, (RATE * leaf).tolist()))

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T)], axis=1)

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        """The probability of each candidate."""
        if len(rows) < 8:
            return np.array([self._score(row) for row in rows])
        bins = self._bins(np.array(rows, float))
        every, total = np.arange(len(rows)), np.zeros(len(rows))
        for tree, leaf in self.trees:
            node = np.zeros(len(rows), int)
            for level in tree:
                feature, cut = np.array(level).T
                node = 2 * node + (bins[every, feature[node]] > cut[node])
            total += np.array(leaf)[node]
        return 1 / (1 + np.exp(-total))

    def _score(self, row: list[float]) -> float:
        """For one candidate; most texts have few, so no arrays are made."""
        bins = [bisect_left(c, v) for c, v in zip(self._lists, row)]
        total = 0.0
        for tree, leaf in self.trees:
            node = 0
            for level in tree:
                f, c = level[node]
                node = 2 * node + (bins[f] > c)
            total += leaf[node]
        return 1 / (1 + float(np.exp(-total)))

    @property
    def _lists(self) -> list[list[float]]:
        if not hasattr(self, "_kept"):
            self._kept = [c.tolist() for c in self.cuts]
        return self._kept


@lru_cache(maxsize=1)
def trained(n: int = 6000, seed: int = 11) -> tuple[Boosted, tuple[float, ...]]:
    """The trees and each kind's threshold: the lowest score from which held-out precision holds."""
    drawn = examples(n, seed)
    x, y = np.array([describe(t, s) for t, s, _ in drawn], float), np.array([good for *_, good in drawn], float)
    split = 2 * n // 3
    model = Boosted(x[:split], y[:split])
    scores = model.scores(x[split:].tolist())
    least = []
    for kind in range(len(KINDS)):
        mine = x[split:, 0] == kind
        order = np.argsort(-scores[mine], kind="stable")
        good = y[split:][mine][order]
        precise = np.flatnonzero((np.cumsum(good) + 1) / (np.arange(len(good)) + 2) >= LEAST_PRECISION - 1 / (np.arange(len(good)) + 2))
        least.append(float(scores[mine][order][precise[-1]]) if len(precise) else 1.1)
    return model, tuple(least)


def added_spans(text: str, base: list[Span], model: Boosted, least: tuple[float, ...]) -> list[Span]:
    """Candidates over their kind's threshold, the best first, that touch nothing taken before."""
    taken = sorted(s[:2] for s in base)  # base spans of two kinds may overlap: their outline counts
    for k in range(1, len(taken)):
        taken[k] = (taken[k][0], max(taken[k][1], taken[k - 1][1]))

    def free(s: Span) -> bool:
        k = bisect_left(taken, (s[1],))
        return not k or taken[k - 1][1] <= s[0]

    maybe = []
    open_ = filter(free, candidates(text))
    beside, behind = lru_cache(64)(_beside), lru_cache(64)(_behind)  # windows share their ends
    while some := list(islice(open_, SCORED)):
        maybe += [(score, s) for score, s in zip(model.scores([describe(text, s, beside, behind) for s in some]).tolist(), some) if score >= least[s[2]]]
    out = []
    for _, s in sorted(maybe, key=lambda x: (-x[0], x[1][0], -x[1][1], x[1][2])):
        if free(s):
            out.append(s)
            insort(taken, s[:2])
    return out


def find(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans): arrays of (kind, start, end) by kind and start for every row of ``docs``."""
    small_batches(spark)
    model, least = trained()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    order = lambda s: (s[2], s[0])
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for x in batch.column(1):
                x = x.as_py() or ""
                own = base_spans(x)
                base.append(named(sorted(own, key=order)))
                spans.append(named(sorted(own + added_spans(x, own, model, least), key=order)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, item), pa.array(spans, item)], names=["key", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, base {kind}, spans {kind}").withColumnRenamed("key", key)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *map(count, KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
