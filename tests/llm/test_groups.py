"""Sharding, near duplicates and media against brute force."""

import hashlib
import heapq
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanframe.llm import media, sharding, simhash
from spanframe.llm.components import components


@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 200)), max_size=8, unique_by=lambda x: x[0]), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_lpt_is_the_heap(classes, shards):
    classes = sorted(classes, reverse=True)
    heap = [(0, k) for k in range(shards)]
    want = []
    for size, n in classes:
        given_ = [0] * shards
        for _ in range(n):
            load, k = heapq.heappop(heap)
            given_[k] += 1
            heapq.heappush(heap, (load + size, k))
        want.append((size, given_))
    assert list(sharding.lpt(classes, shards)) == want


def test_shards(spark, docs, rows):
    got = {r.doc_id: r for r in sharding.shard(spark, docs).collect()}
    loads, slots, together = defaultdict(int), defaultdict(list), defaultdict(set)
    for d, text, *_ in rows:
        r = got[d]
        assert (r["size"], r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        together[text].add(r.shard)
    assert all(len(s) == 1 for s in together.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the heap over groups gives the same loads
    groups = defaultdict(int)
    for _, text, *_ in rows:
        groups[text] += len(text.encode()) + 1
    heap = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert sorted(loads.values()) == sorted(heap)


def test_shards_hard(spark, hard, nothing):
    got = sharding.shard(spark, hard).collect()
    assert len(got) == hard.count() and sum(r["size"] == 1 for r in got) == 3
    assert len({r.shard for r in got if r.doc_id in (1, 5)}) == 1
    assert sharding.shard(spark, nothing).count() == 0


def slow_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ") if w]
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints):
    """Smallest key reachable, from all pairs."""
    keys = list(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_classes(spark, docs, rows, hot):
    got = simhash.classes(spark, docs, hot=hot).collect()
    prints = {d: slow_fingerprint(t) for d, t, *_ in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    want = slow_classes(prints)
    assert {r.doc_id: r.component for r in got} == want and len(set(want.values())) < len(rows)


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_lose_none(spark, hot):
    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(12):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
        for _ in range(10):  # crowded halves
            prints.add(p ^ r.getrandbits(4))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {tuple(sorted((e.a % (1 << 64), e.b % (1 << 64)))) for e in simhash.links(spark, df, hot).collect()}
    all_ = sorted(prints)
    assert got == {(a, b) for i, b in enumerate(all_) for a in all_[:i] if (a ^ b).bit_count() <= 3}


def test_simhash_hard(spark, hard, nothing):
    got = simhash.classes(spark, hard).collect()
    assert len(got) == hard.count()
    assert {r.component for r in got if r.fp == 0} == {2}
    assert all(r.component == 1 for r in got if r.doc_id in (1, 5)) and {r.component for r in got if r.doc_id in (8, 9)} == {8}
    kept = simhash.keep_one(spark, hard)
    assert kept.columns == hard.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "2", "6", "7", "8", "None", "None"]
    assert simhash.classes(spark, nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {e.node: e.root for e in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<p>First <b>bold</b> &amp; text<p>Second<figure><img src="sha256:aa" alt="A"><figcaption>Cap <i>one</i></figcaption></figure>
<img src="/x.png">tail<video src="v.mp4"></video></body>"""


def test_sequence_of_a_page():
    got = [(x["pos"], x["kind"], x["text"] or x["src"], x["digest"], x["caption"]) for x in media.sequence(PAGE)]
    assert got == [(0, "text", "First bold & text", None, None), (1, "text", "Second", None, None), (2, "media", "sha256:aa", "aa", "Cap one"), (3, "media", "/x.png", None, None), (4, "text", "tail", None, None), (5, "media", "v.mp4", None, None)]
    assert media.sequence(None) == media.sequence("") == [] and media.sequence("<p>a</div></b><<img") is not None


@pytest.mark.parametrize("text", ["", "x", "é" * 32, "a" * 64, "a" * 65, "b\0" * 5000, None])
def test_png_round_trip(text):
    payload = media.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) and payload.rstrip(b"\0") == (text or "").encode().rstrip(b"\0")
    form = media.to_png(payload)
    rows = media.from_png(form)
    assert rows.tobytes() == payload and media.feature(rows) == media.feature(np.frombuffer(payload, np.uint8).reshape(-1, 64))
    with pytest.raises(ValueError):
        media.from_png(form[:-20] + bytes([form[-20] ^ 1]) + form[-19:])


@pytest.mark.parametrize("page,want", [
    ("<figure><figcaption>before</figcaption><img src=a></figure>", [("media", "a", "before")]),
    ("<figure><img src=a><figcaption>one</figcaption></figure><p>x<figcaption>loose</figcaption></p><img src=b>", [("media", "a", "one"), ("text", "xloose", None), ("media", "b", None)]),
    ("<figure><img src=a><figure><img src=b><figcaption>in</figcaption></figure><img src=c><figcaption>out</figcaption></figure>", [("media", "a", "out"), ("media", "b", "in"), ("media", "c", "out")]),
    ("<figure><img src=a><figcaption>not closed", [("media", "a", "not closed")]),
    ("<head><title>never closed<p>seen</p><p>too</p>", [("text", "seen", None), ("text", "too", None)]),
    ("<div><noscript><img src=no>unseen</div><p>seen</p>", [("text", "seen", None)]),
    ("<div><template>unseen<p>this as well</p></div>after<img src=yes>", [("text", "after", None), ("media", "yes", None)]),
    ("<p>" * 3000 + "deep" + "</p>" * 10 + "</div>" * 3000, [("text", "deep", None)]),
    ("<figure/><img src=a><video src=v><figcaption>x</figcaption></video>", [("media", "a", None), ("media", "v", None), ("text", "x", None)]),
])
def test_captions_and_unclosed_elements(page, want):
    got = media.sequence(page)
    assert [(x["kind"], x["text"] or x["src"], x["caption"]) for x in got] == want
    assert [x["pos"] for x in got] == list(range(len(got)))


def slow_png(form):
    """The samples of a greyscale PNG, by its specification, filters included."""
    assert form.startswith(b"\x89PNG\r\n\x1a\n") and form.endswith(b"IEND" + zlib.crc32(b"IEND").to_bytes(4, "big"))
    at, parts, data = 8, {}, b""
    while at < len(form):
        n, kind = int.from_bytes(form[at : at + 4], "big"), form[at + 4 : at + 8]
        assert zlib.crc32(form[at + 4 : at + 8 + n]) == int.from_bytes(form[at + 8 + n : at + 12 + n], "big")
        parts[kind] = form[at + 8 : at + 8 + n]
        data += parts[kind] if kind == b"IDAT" else b""
        at += 12 + n
    width, height = int.from_bytes(parts[b"IHDR"][:4], "big"), int.from_bytes(parts[b"IHDR"][4:8], "big")
    assert parts[b"IHDR"][8:] == bytes([8, 0, 0, 0, 0])
    raw, out, above = zlib.decompress(data), [], [0] * width
    for y in range(height):
        kind, line, done = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)], []
        for x, v in enumerate(line):
            left = done[x - 1] if x else 0
            done.append((v + (0, left, above[x], (left + above[x]) // 2)[kind]) % 256)
        out += done
        above = done
    return bytes(out)


def slow_feature(payload):
    n = len(payload) // 64
    cells = defaultdict(int)
    sizes = defaultdict(int)
    for k, v in enumerate(payload):
        y, x = divmod(k, 64)
        cells[y * 8 // n, x // 8] += v
        sizes[y * 8 // n, x // 8] += 1
    total = sum(payload)
    bits = "".join(str(int(cells[b, c] * len(payload) > total * sizes[b, c])) for b in range(8) for c in range(8))
    return f"{int(bits, 2):016x}:{total}:{sum(v > 0 for v in payload)}"


def test_media_query(spark, sf, rows):
    got = media.op5_media(spark, sf).collect()
    assert len(got) == len(rows)
    texts = {d: text for d, text, *_ in rows}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        form = media.to_png(payload)
        assert slow_png(form) == payload and (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        assert r.feature == slow_feature(payload)
        # the payload's place among the paragraphs, and its own caption
        assert (r.pos, r.caption) == (sum(bool(line.split()) for line in texts[r.doc_id].split("\n")), f"Document {r.doc_id}")


def test_page_sequences(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = defaultdict(list)
    for r in media.page_sequences(spark, sf).collect():
        got[r.page_id].append((r.pos, r.kind, r.text))
    assert set(got) <= set(pages)
    for k, page in pages.items():
        items = sorted(got[k])
        assert [x[0] for x in items] == list(range(len(items)))
        # the same words in the same order as without tags and what isn't shown
        bare = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style|title)\b.*?</\1>", " ", page)
        words = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", bare))).split()
        assert " ".join(x[2] for x in items if x[1] == "text").split() == words


def test_media_hard(spark, hard, nothing, tmp_path):
    for df, name in ((hard, "hard"), (nothing, "none")):
        df.drop("n_chars").write.parquet(str(tmp_path / name / "documents.parquet"))
        got = media.op5_media(spark, str(tmp_path / name)).collect()
        assert len(got) == df.count() and all(r.payload_sha256 for r in got)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    from pyspark.sql import functions as F

    items = pages.select("page_id", F.explode(media.interleave(F.col("html"))).alias("item"))
    assert items.filter("item.kind = 'text'").count() > 50
    assert media.resolve(items, media.measure(media.store(spark, nothing)), "page_id").filter("payload_bytes is not null").count() == 0
