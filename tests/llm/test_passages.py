"""Line dedup against repeated runs of lines that are found without chunks."""

import random

import pytest

import corpus_pipeline
from spanframe.llm import line_dedup


def repeated(rows, least=50):
    """{key: lines in a run of ``least`` words or more that an earlier text has}, from all runs of all texts; lines have no blanks between."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(" \t\n\v\f\r")]
        words = [len(x.split()) for _, x in lines]
        own, gone = set(), set()
        for i in range(len(lines)):
            n = 0
            for j in range(i, min(len(lines), i + 60)):
                n += words[j]
                if n >= least:
                    body = "\n".join(x for _, x in lines[i : j + 1])
                    if body in seen:
                        gone |= {k for k, _ in lines[i : j + 1]}
                    own.add(body)
        seen |= own
        out[d] = gone
    return out


def planted():
    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passages = [[line(r.randint(11, 30)) for _ in range(r.randint(2, 5))] for _ in range(25)]
    passages = [p for p in passages if sum(len(x.split()) for x in p) > 50]
    rows = []
    for k in range(120):
        own = [line(r.randint(1, 40)) for _ in range(r.randint(2, 9))]
        at = r.randint(0, len(own))
        rows.append((k, "\n".join(own[:at] + r.choice(passages) + own[at:])))
    return rows + [(1000 + k, text + "\n\n" * (k % 2)) for k, text in rows[:40]]


def removed(spark, rows):
    got = line_dedup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), told=True, passages=True).collect()
    return {r.doc_id: {int(x) for x in r.removed.split(",") if x} for r in got}, {r.doc_id: r.text for r in got}


def test_passages_go_whole(spark):
    rows = planted()
    want, (got, texts) = repeated(rows), removed(spark, rows)
    assert sum(map(len, want.values())) > 300
    assert all(want[d] <= got[d] for d, _ in rows)
    assert all(texts[1000 + k] == "" for k in range(40) if len(rows[k][1].split()) >= 50)
    # every line is still there somewhere, and lines that came once stay
    left = {x for text in texts.values() for x in text.split("\n")}
    assert {x for _, text in rows for x in text.split("\n") if x} <= left


def test_query_and_stage(spark, sf, docs, rows):
    texts = [(d, t) for d, t, *_ in rows]
    want = repeated(texts)
    got = {r.doc_id: {int(x) for x in r.removed.split(",") if x} for r in line_dedup.op4_line_dedup(spark, sf).collect()}
    assert any(want.values()) and all(want[d] <= got[d] for d, _ in texts)
    stage = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf).collect()}
    assert all(stage[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got[d]) for d, t in texts)


@pytest.mark.parametrize("text", [None, "", "\n\n", " \n\t\n", "x\n" * 3, "a b\n\nc"])
def test_little_stays(spark, text):
    _, texts = removed(spark, [(1, text), (2, text)]) if text is not None else (None, {1: None})
    assert texts[1] == text
