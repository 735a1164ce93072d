"""Language, personal data, quality rules, segmentations and the pipeline."""

import collections
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanframe.llm import language, near, pii, quality, segments

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_phrases(text, sample):
    """Cross-parsing by search: the longest match from each place, over."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


def test_phrases_are_longest_matches(rows):
    samples = tuple((lang, "\n".join(t for _, t, x, _ in rows[:100] if x == lang)[:3000]) for lang in ("de", "en", "fr"))
    parser = language.CrossParser(samples)
    spell = lambda codes: "".join(chr(c + 1) for c in codes)
    texts = [parser.fold(t[:900]) for _, t, *_ in rows[100:130]] + [parser.fold("漢字 only"), np.zeros(0, np.int32)]
    got = parser.phrases(texts)
    for k, codes in enumerate(texts):
        for j, (_, sample) in enumerate(samples):
            assert got[k, j] == slow_phrases(spell(codes), spell(parser.fold(sample)))


@pytest.mark.parametrize("dense", [0, 1 << 16, language.DENSE_BYTES])
def test_every_letter_counts(monkeypatch, dense):
    """Thousands of letters, those of one language high among the code points; tables of any size say the same."""
    monkeypatch.setattr(language, "DENSE_BYTES", dense)
    r = random.Random(2)
    scripts = {"zh": range(0x4E00, 0x4E00 + 1500), "ko": range(0xAC00, 0xAC00 + 900), "xx": range(0x4E00 + 1500, 0x4E00 + 3000), "en": range(97, 123)}
    words = {lang: ["".join(chr(r.choice(span)) for _ in range(r.randint(1, 4))) for _ in range(300)] for lang, span in scripts.items()}
    draw = lambda lang, n: " ".join(r.choice(words[lang]) for _ in range(n))
    samples = tuple((lang, draw(lang, 1500)) for lang in sorted(scripts))
    parser = language.CrossParser(samples)
    assert parser.fold.size > 1500
    texts = {lang: draw(lang, 40) for lang in scripts}
    assert [x for x, _ in parser.predict(list(texts.values()))] == list(texts)
    spell = lambda codes: "".join(chr(c + 1) for c in codes)
    got = parser.phrases([parser.fold(t) for t in texts.values()])
    for k, text in enumerate(texts.values()):
        for j, (_, sample) in enumerate(samples):
            assert got[k, j] == slow_phrases(spell(parser.fold(text)), spell(parser.fold(sample)[: language.SAMPLE]))


def test_many_languages(spark):
    r = random.Random(6)
    words = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7))) for _ in range(60)] for k in range(120)}
    rows = [(n, " ".join(r.choice(words[lang]) for _ in range(60)), lang) for n, lang in enumerate(sorted(words) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.learn(docs.filter("doc_id < 360"))
    assert len(samples) == 120
    got = {x.doc_id: x.lang_pred for x in language.identify(spark, docs.filter("doc_id >= 360"), samples).collect()}
    assert sum(got[n] == lang for n, _, lang in rows[360:]) >= 0.98 * 120


def test_predictions_in_full(rows):
    """The language with the fewest normalised phrases, by search."""
    samples = tuple((lang, "\n".join(t for _, t, x, _ in rows[:100] if x == lang)[:2000]) for lang in ("de", "en", "fr"))
    parser = language.CrossParser(samples)
    spell = lambda codes: "".join(chr(c + 1) for c in codes)
    texts = [t[:600] for _, t, *_ in rows[100:125]]
    for text, (lang, score) in zip(texts, parser.predict(texts)):
        cost = sorted((slow_phrases(spell(parser.fold(text)), spell(parser.fold(sample))) * np.log2(len(parser.fold(sample))), name) for name, sample in samples)
        assert (lang, score) == (cost[0][1], pytest.approx(cost[1][0] / (cost[0][0] + cost[1][0])))


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_blocks_of_a_long_text(rows, monkeypatch, block):
    """Stretches are corrected: as without them, also where the parses meet late or never."""
    r = random.Random(block)
    prose = " ".join(t for _, t, *_ in rows if t)[:3 * block + 2000]
    monotone, period = "a" * 5000, "abcab" * 900
    parser = language.CrossParser((("a", "a" * 997), ("en", rows[1][1]), ("p", "abcab" * 37), ("x", "".join(r.choice("ab") for _ in range(300)))))
    texts = [parser.fold(t) for t in (prose, "", monotone, period, "b" + monotone, "x", "".join(r.choice("abc ") for _ in range(700)), "ab" * 300 + "q" + monotone[:600])]
    monkeypatch.setattr(language, "BLOCK", 1 << 20)
    whole = parser.phrases(texts)
    monkeypatch.setattr(language, "BLOCK", block)
    assert (parser.phrases(texts) == whole).all()
    assert (parser.phrases(texts[::-1]) == whole[::-1]).all()


def test_held_out_accuracy(spark, sf):
    got = language.op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_hard(spark, hard, nothing, docs):
    samples = language.learn(docs)
    got = language.identify(spark, hard, samples).collect()
    assert len(got) == hard.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2, 3, 4))
    assert language.identify(spark, nothing, samples).count() == 0
    assert language.learn(nothing) == () and {r.lang_pred for r in language.identify(spark, hard, ()).collect()} == {"und"}


PERSONAL = [
    ("mail a.b+c@x-y.example.com. or z@host", [(5, 26, 0)]), ("at 10.0.0.255, 256.1.1.1 and 1.2.3.4.5", [(3, 13, 1), (29, 36, 1)]), ("card 4111 1111-1111 1111, 4111111111111112", [(5, 24, 2)]),
    ("call +1 (988) 555-2485 or +12", [(5, 22, 3)]), ("é🙂 x@y.zz", [(3, 9, 0)]), ("@ 12 +", []), ("", []),
]


@pytest.mark.parametrize("text,want", PERSONAL)
def test_base_spans(text, want):
    assert pii.base_spans(text) == want


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_base(text):
    """The contract's patterns as they are written."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    want = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    want += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    want += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return want + [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_base_spans_in_full(rows):
    """The shortcuts find what plain use of the patterns finds."""
    r = random.Random(1)
    drawn = ["".join(r.choice(some) for _ in range(r.randint(0, 40))) for some in ("ab1@.-+ ", "a@.", "0123456789 -", "12.", "+1 ().-9x", "a@-%_ \n.b") for _ in range(2000)]
    for text in [t for _, t, *_ in rows] + drawn:
        assert pii.base_spans(text) == slow_base(text)


RUNS = ["0" * 5000 + ".1.1.1", "a" * 10**6 + " x@y.zz", "1" * 10**6, "a@" * 10**6, "@a.b" * 250_000, "(" * 10**6 + "1", " at b dot  a" * 80_000, "+" * 10**6, "1" + " " * 10**6 + "1", "1.1.1." * 5000, "1 2 3 4 " * 2500]


@pytest.mark.parametrize("text", RUNS, ids=lambda x: repr(x[:8]))
def test_long_runs(text):
    began = time.process_time()
    base = pii.base_spans(text)
    spans = sorted(base + pii.added_spans(text, base, *pii.trained()))
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert time.process_time() - began < 30  # the square of a megabyte would take hours
    if text[0] == "0":
        assert spans == [(0, 5006, 1)]


def test_added_spans():
    model, least = pii.trained()
    drawn = pii.examples(4000, 77)
    said = model.scores([pii.describe(t, s) for t, s, _ in drawn]) >= np.array(least)[[s[2] for _, s, _ in drawn]]
    for kind, name in enumerate(pii.KINDS):
        mine = [(good, x) for (_, s, good), x in zip(drawn, said) if s[2] == kind]
        right, wrong, all_ = sum(g and x for g, x in mine), sum(x and not g for g, x in mine), sum(g for g, _ in mine)
        assert right >= 0.95 * all_ and wrong <= 0.03 * right, name
    found = collections.Counter()
    for text, (a, b, kind), good in drawn:
        if good:
            base = pii.base_spans(text)
            found[kind, any(x <= a and b <= y for x, y, _ in base + pii.added_spans(text, base, model, least))] += 1
    for kind, name in enumerate(pii.KINDS):
        assert found[kind, True] >= 0.9 * (found[kind, True] + found[kind, False]), name
    text = "call +1 (269) 555-3296 4111111111111111 now, or (212) 555-0187; mail jo [at] site [dot] org"
    base = pii.base_spans(text)
    added = pii.added_spans(text, base, model, least)
    assert {text[a:b] for a, b, _ in added} >= {"+1 (269) 555-3296", "jo [at] site [dot] org"}
    spans = sorted(base + added)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for clean in ("Version 2.0 of 2024-01-02 at page 12, item 12345 costs 1,234.50", "she was at home. It was cold at a a.", "order 2024-11-02 10:20:30 line 123 456"):
        assert pii.added_spans(clean, [], model, least) == []


def test_one_score_and_many():
    model, _ = pii.trained()
    rows = [pii.describe(t, s) for t, s, _ in pii.examples(50, 5)]
    assert model.scores(rows) == pytest.approx([float(model.scores([row])[0]) for row in rows])


def test_few_added_spans_in_prose(rows):
    """Texts without personal data gain nothing, but for numbers that look like it in every way."""
    model, least = pii.trained()
    gained = [t[a:b] for _, t, *_ in rows if not (base := pii.base_spans(t)) for a, b, _ in pii.added_spans(t, base, model, least)]
    assert len(gained) <= 0.01 * len(rows), gained


def test_pii_hard(spark, hard, nothing):
    got = pii.find(spark, hard).collect()
    assert len(got) == hard.count() and not any(r.spans for r in got)
    assert pii.find(spark, nothing).count() == 0


def slow_counts(text):
    words = WORD.findall(text or "")
    lines = (text or "").split("\n")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    dup = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_statistics(rows):
    for text in [t for _, t, *_ in rows] + ["", None, "a b c a b c a b", "x\n\nx\n \n \nx", "a\x85b c\x1cd", "a b c d a b c"]:
        assert quality.counts(text)[:5] == slow_counts(text)


def test_rules_are_learned(spark, sf):
    r = np.random.default_rng(3)
    x = {"a": r.random(3000), "b": r.random(3000), "c": r.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.97)
    rules = quality.learn(x, bad)
    said = np.zeros(3000, bool)
    for rule in rules:
        said |= quality._covered(rule, x, 3000)
    assert (said & bad).sum() >= 0.9 * bad.sum() and (said & ~bad).sum() <= 0.02 * (~bad).sum()
    assert quality.learn(x, np.zeros(3000, bool)) == []
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(*(x[k][:200] for k in "abc"))], "a double, b double, c double")
    got = [v[0] for v in df.select(quality.expression(rules, {k: F.col(k) for k in "abc"})).collect()]
    assert [g > 0 for g in got] == said[:200].tolist()


def test_quality_keeps_clean(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from
    got = quality.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    clean, junk = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean) and sum(r.kept for r in junk) <= 0.3 * len(junk)


def test_quality_hard(spark, hard, nothing, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for some in (labels, labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert quality.judge(spark, hard, some).count() == hard.count()
    assert quality.keep_good(spark, hard, labels).columns == hard.columns
    assert quality.keep_good(spark, nothing, labels).count() == 0


@pytest.fixture(scope="module")
def sampler():
    return segments.Sampler(segments.vocabulary(segments.MODEL), 3, 5)


def ways(word, vocabulary, names):
    """All segmentations of a unit with their probabilities, by recursion."""
    if not word:
        return {(): 0.0}
    out = {}
    for k in range(1, len(word) + 1):
        if word[:k] in names:
            i, logp = names[word[:k]]
            for rest, more in ways(word[k:], vocabulary, names).items():
                out[(i, *rest)] = logp + more
    return out


def test_samples_follow_the_lattice(sampler):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=segments.MODEL)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    total = np.log((1.0 / np.arange(1, sp.get_piece_size() + 1)).sum())
    names = {sp.id_to_piece(i): (i, -np.log(k) - total) for k, i in enumerate(sorted(usable, key=lambda i: (-sp.get_score(i), i)), 1)}
    all_ = ways("▁thing", sampler.vocabulary, names)
    mass = np.log(sum(np.exp(v) for v in all_.values()))
    p = {k: float(np.exp(v - mass)) for k, v in all_.items()}
    n = 20_000
    got = sampler(np.arange(n, dtype=np.uint64), ["thing"] * n)
    first, inverse = collections.Counter(), collections.Counter()
    for mine in got:
        ids = [tuple(sampler.lattice.piece[s[0]].tolist()) for s in mine]
        assert len(set(ids)) == len(ids) == 3 and all(s[2] >= t[2] for s, t in zip(mine, mine[1:]))
        first[ids[0]] += 1
        for i, s in zip(ids, mine):
            assert s[1] == pytest.approx(np.log(p[i]), abs=1e-9)
            inverse[i] += 1 / s[3]
    for i, q in p.items():
        if q > 0.01:
            assert first[i] / n == pytest.approx(q, abs=5 * (q / n) ** 0.5)
            assert inverse[i] / n == pytest.approx(1, abs=0.15)  # inclusion scores weigh samples without bias


def test_few_segmentations_and_round_trip(sampler, rows):
    texts = ["", " ", "\n", "a", "漢字🙂", "a▁b  c\n\td ", "x" * 3000] + [t for _, t, *_ in rows[:30]]
    got = sampler(np.arange(len(texts), dtype=np.uint64), texts)
    ids, bounds = sampler.ids([s[0] for mine in got for s in mine])
    at = 0
    for text, mine in zip(texts, got):
        assert mine and len({s[0].tobytes() for s in mine}) == len(mine)
        for _ in mine:
            assert sampler.vocabulary.decode(ids[bounds[at] : bounds[at + 1]]) == text
            at += 1
    assert len(got[0]) == 1 and got[0][0][3] == 1.0
    alone = sampler(np.array([9], np.uint64), texts[9:10])[0]
    again = sampler(np.arange(len(texts), dtype=np.uint64), texts)[9]
    assert [s[1] for s in alone] == [s[1] for s in again]  # whatever else is in the batch


def spelled(sampler, texts):
    found = sampler(np.arange(len(texts), dtype=np.uint64), texts)
    ids, bounds = sampler.ids([s[0] for mine in found for s in mine])
    return [(ids[x:y].tolist(), *s[1:]) for x, y, s in zip(bounds, bounds[1:], [s for mine in found for s in mine])]


def test_kept_lattices_change_nothing(rows):
    vocabulary = segments.vocabulary(segments.MODEL)
    parts = [[t for _, t, *_ in rows[k : k + 7]] for k in range(0, 42, 7)]
    kept, bare = segments.Sampler(vocabulary, 2, 5), segments.Sampler(vocabulary, 2, 5, kept_chars=0)
    for texts in parts:
        assert spelled(kept, texts) == spelled(bare, texts) == spelled(segments.Sampler(vocabulary, 2, 5), texts)
    assert len(bare.keys) < len(kept.keys)


def test_common_units_outlast_the_bound(monkeypatch):
    """When more than the bound is kept, units that recur stay: their lattices aren't built again, and nothing else changes."""
    vocabulary = segments.vocabulary(segments.MODEL)
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    common = [word() for _ in range(40)]
    parts = [[" ".join([*r.sample(common, 40), *(word() for _ in range(100))]) for _ in range(3)] for _ in range(12)]
    built, plain = collections.Counter(), segments.Lattice.__init__

    def noting(self, vocabulary, points, length):
        built.update(points[end - n : end].tobytes() for n, end in zip(length.tolist(), np.cumsum(length).tolist()))
        plain(self, vocabulary, points, length)

    want = [spelled(segments.Sampler(vocabulary, 2, 5, kept_chars=0), texts) for texts in parts]
    monkeypatch.setattr(segments.Lattice, "__init__", noting)
    spelled(segments.Sampler(vocabulary, 2, 5), [" ".join(common)])
    units = set(built)
    built.clear()
    one, most = segments.Sampler(vocabulary, 2, 5, kept_chars=3000), 0
    for texts, right in zip(parts, want):
        assert spelled(one, texts) == right
        most = max(most, len(one.lattice.degree))
    assert len(units) >= 40 and all(built[u] == 1 for u in units)
    assert most < 3000 + max(sum(map(len, texts)) for texts in parts) * 2


def test_units_with_one_hash(rows, monkeypatch):
    vocabulary = segments.vocabulary(segments.MODEL)
    texts = [t for _, t, *_ in rows[:5]]
    want = spelled(segments.Sampler(vocabulary, 2, 5), texts)
    one = segments.Sampler(vocabulary, 2, 5)
    plain, clashes = segments.Sampler._numbered, []

    def clashing(self, points, start):
        number = plain(self, points, start)
        if self.mixer < 3:
            clashes.append(self.mixer)
            return np.where(number == 5, 6, number)
        return number

    monkeypatch.setattr(segments.Sampler, "_numbered", clashing)
    assert spelled(one, texts) == want and clashes == [1, 2]


def test_cuts_are_no_pieces(sampler, rows):
    """No piece lies across a cut: the pieces of any unsplit encoding keep to the units."""
    vocabulary = sampler.vocabulary
    names = [bytes(vocabulary.raw[i]).decode("utf-8", "replace").replace(" ", segments.SPACE) for i in range(len(vocabulary.raw)) if vocabulary.raw_size[i] > 1]
    for name in names[::7]:
        points = np.array(list(map(ord, name)), np.uint32)
        assert vocabulary.joints(points).all() or "\ufffd" in name
    assert vocabulary.joints(np.array(list(map(ord, "a▁b\n")), np.uint32)).tolist() == [False, True, False]


def test_large_batches_are_cut(rows, monkeypatch):
    """A worker samples some HELD_CHARS bytes of text at once, however large the batches are; a longer text goes by itself."""
    import pyarrow as pa

    texts = [t for _, t, *_ in rows[:120]] + [None, "", "one text that is long " * 400, "é" * 900, "end"]
    table = pa.table({"key": range(len(texts)), "text": texts, "t": pa.nulls(len(texts), pa.int64()), "copy": pa.array([0] * len(texts), pa.int32())})
    plain, met = segments.Sampler.__call__, []

    def noting(self, seeds, texts):
        met.append([len(t.encode()) for t in texts])
        return plain(self, seeds, texts)

    monkeypatch.setattr(segments.Sampler, "__call__", noting)

    def run(size, bound):
        met.clear()
        monkeypatch.setattr(segments, "HELD_CHARS", bound)
        batches = [table.to_batches()[0].slice(0, 0), *table.to_batches(max_chunksize=size)]
        return [r for batch in segments.sampled(iter(batches), segments.Sampler(segments.vocabulary(segments.MODEL), 2, 5)) for r in batch.to_pylist()]

    want = run(1000, 1 << 40)
    assert len(met) == 1 and all(r["exact"] for r in want) and {r["key"] for r in want} == set(range(len(texts)))
    for size in (1000, 7, 1):
        assert run(size, 3000) == want
        assert [n for part in met for n in part] == [len((t or "").encode()) for t in texts]
        assert all(sum(part) <= 3000 or len(part) == 1 for part in met)
        assert all(sum(a) + b[0] > 3000 for a, b in zip(met, met[1:]))


def test_copies_are_sampled_each(spark):
    rows = [(1, "some words of a text")] * 3 + [(2, "other"), (1, "some words of a text")]
    got = segments.sample(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert collections.Counter((r.doc_id, r.copy) for r in got) == {(1, 0): 2, (1, 1): 2, (1, 2): 2, (1, 3): 2, (2, 0): 2}
    assert len({(r.copy, r.sample, r.perturbed) for r in got if r.doc_id == 1}) == 8


def test_segments_hard(spark, hard, nothing):
    got = segments.sample(spark, hard).collect()
    assert all(r.exact for r in got)
    per = collections.Counter(r.doc_id for r in got)
    assert per[2] == per[3] == 1 and per[6] == 2 and per[5] == 4
    assert segments.sample(spark, nothing).count() == 0
    decoded = segments.sample(spark, hard).select("doc_id", segments.decode(F.col("ids")).alias("text")).filter("doc_id = 7").collect()
    assert {r.text for r in decoded} == {"été ▁ 漢字 🙂\r\nx"}


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, sf).cache()
        ids = lambda df: {r[0] for r in df.select("doc_id").distinct().collect()}
        assert ids(kept) <= ids(before), name
        if name != "encoding":
            assert kept.columns == columns
        if name == "quality rules":
            assert ids(kept) == {r.doc_id for r in quality.op7_quality(spark, sf).filter("kept").collect()}
        if name == "line dedup":
            assert ids(kept) == ids(before) and kept.count() == before.count()
        if name == "near dedup":
            found = near.classes(spark, before).collect()  # held against brute force in test_near
            assert ids(kept) == {r.component for r in found} and kept.count() == len({r.component for r in found})
        if name == "mixing":
            assert kept.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    assert kept.filter("not exact").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == kept.count()


def test_pipeline_on_nothing(spark, sf, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0, name
