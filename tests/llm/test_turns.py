import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from spanframe.llm.turns import ADDED, LOST, OPEN, RETOLD, Reader, audit, repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def brute(turns):
    """The cheapest labels over all edits, one insertion at most at each place."""
    best = None
    chunks = [i + op for i in ("", "I") for op in "DKR"]
    for labels in product(chunks, repeat=len(turns)):
        for tail in ("", "I"):
            cost, roles = 0, ""
            # the output's roles follow from the labels: a kept turn shows its own, the others what may follow
            k = 0
            for edit in "".join(labels) + tail:
                follows = {"": "u", "s": "u", "u": "a", "a": "u"}.get(roles[-1:])
                if not follows:
                    break
                if edit == "I":
                    cost, roles = cost + ADDED, roles + follows
                    continue
                role, _, doomed, cut = turns[k]
                k += 1
                if edit == "D":
                    cost += LOST
                    continue
                if doomed or edit == "R" and role[:1] == follows:
                    break
                cost += OPEN * cut + RETOLD * (edit == "R")
                roles += (role[:1] or "?") if edit == "K" else follows
            else:
                if LEGAL.match(roles):
                    best = min(best or (cost, "".join(labels) + tail), (cost, "".join(labels) + tail))
    return best


def test_cheapest_repair_against_every_edit():
    r = random.Random(5)
    for _ in range(150):
        turns = [(r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["One.", "Two!", "cut", " ", "more?", "Some text."])) for _ in range(r.randint(0, 4))]
        reader, out, seen, judged = Reader(), [], set(), []
        for k, (role, text) in enumerate(turns):
            out += reader.feed(k, role, text)
            blank, again = not text.strip(), (role, text) in seen
            seen.add((role, text))
            judged.append((role, text, blank or again, not blank and not again and text[-1] not in ".!?"))
        out += reader.end()
        told = reader.summary()
        assert (told["cost"], told["audit"]) == brute(judged)
        kept = [(role, text) for edit, role, text in out if edit != "D"]
        assert LEGAL.match("".join(role[:1] for role, _ in kept))
        assert "".join(edit for edit, *_ in out) == told["audit"]
        assert told["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()


def test_settles_as_it_reads():
    reader = Reader()
    most = 0
    for k in range(20_000):
        list(reader.feed(k, "user" if k % 2 else "assistant", f"Text {k}."))
        depth = 0
        step = next(iter(reader.repair.paths.values())).step
        while step:
            depth, step = depth + 1, step[1]
        most = max(most, depth)
    list(reader.end())
    assert most < 20 and len(reader.summary()["audit"]) == 20_000


@pytest.fixture(scope="module")
def talk(spark):
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "system", "Be kind."),
        (2, 0, "user", None), (2, 1, None, "text"), (3, 5, "assistant", ""), (None, 0, "user", "q?"), (None, 3, "assistant", "a 漢字 🙂."),
        (4, 0, "user", "word " * 50_000 + "."), (4, 1, "assistant", "Fine!"), (None, None, None, None),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_hard_rows(talk):
    clash = talk.withColumns({c: F.lit("x") for c in ("conv", "there", "kind", "copy", "place", "edit")})
    got = {r.conv_id: r for r in audit(clash).collect()}
    assert got[1].audit == "KKKD" and got[1].cost == 2 and got[1].duplicate == 1 and got[1].gaps == 0
    assert got[2].audit == "DD" and got[2].blank == 1 and got[2].truncated == 1
    assert got[3].audit == "D" and got[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].audit == "KK" and got[4].repaired_sha256 == hashlib.sha256(("user:" + "word " * 50_000 + ".\nassistant:Fine!").encode()).hexdigest()
    assert got[None].gaps == 2 and got[None].audit == "DKK"
    turns = [tuple(r) for r in repair(clash).filter("conv_id = 1").orderBy("place").collect()]
    assert [t[1:4] for t in turns] == [(0, "K", "system"), (1, "K", "user"), (2, "K", "assistant"), (3, "D", "assistant")]


def test_empty_and_layout(spark, talk):
    assert audit(talk.limit(0)).collect() == [] and repair(talk.limit(0)).collect() == []
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(audit(talk.repartition(7))) == rows(audit(talk.coalesce(1)))
    assert audit(talk.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))).filter("conv_id = 'c1'").first().audit == "KKKD"
