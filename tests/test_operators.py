"""Joins, islands and index tables against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from spanframe.functions import coords
from spanframe.functions.config import FormatError
from spanframe.functions.regions import RegionError, parse_region
from spanframe.operators import index, islands
from spanframe.operators.overlap import first_match, overlap_join, pairs, query, target_filter
from spanframe.plans.ordering import ranked


def draw(seed, n, refs=("a", "b"), most=3000):
    r = random.Random(seed)
    out = []
    for k in range(n):
        s = r.randint(1, most)
        out.append((k, r.choice(refs), s, s + r.choice((0, 0, 1, 5, 40, 900))))
    return out


def frame(spark, rows, name="record_id"):
    return spark.createDataFrame(rows, f"{name} long, ref string, start long, end long")


def meets(r, q):
    return r[1] == q[1] and r[3] >= q[2] and (q[3] is None or r[2] <= q[3])


@pytest.mark.parametrize("strategy", ["broadcast", "binned"])
@pytest.mark.parametrize("seed", [1, 2])
def test_joins(spark, strategy, seed):
    rows, asked = draw(seed, 150), draw(seed + 100, 25)
    asked = [q if k % 5 else (*q[:3], None) for k, q in enumerate(asked)] + [(25, "none", 1, 5)]
    pairs = sorted((q[0], r[0]) for q in asked for r in rows if meets(r, q))
    records, requests = frame(spark, rows), frame(spark, asked, "ordinal")
    assert sorted((x.ordinal, x.record_id) for x in overlap_join(records, requests, strategy).collect()) == pairs
    lowest = {}
    for o, r in pairs:
        lowest.setdefault(r, o)
    assert {x.record_id: x.ordinal for x in first_match(records, requests, strategy).collect()} == lowest
    assert sorted(x.record_id for x in target_filter(records, requests, strategy).collect()) == sorted(lowest)


def test_long_interval_in_binned_plan(spark):
    rows = [(0, "a", 1, 100_000)] + [(k, "a", k, k) for k in range(1, 200)]
    got = overlap_join(frame(spark, rows), frame(spark, [(0, "a", 99_000, None), (1, "a", 5, 5)], "ordinal"), "binned")
    assert sorted((x.ordinal, x.record_id) for x in got.collect()) == [(0, 0), (1, 0), (1, 5)]


@pytest.mark.parametrize("seed", [3, 4])
def test_plans_agree_at_any_coordinate(spark, seed):
    """Around the borders of bins, trees and capacity, for points, wide and open requests."""
    r = random.Random(seed)
    edges = [1, 1 << 14, 1 << 17, 1 << 26, 1 << 29, 1 << 38, 1 << 41, (1 << 41) + (1 << 14), 1 << 50, coords.LONG_MAX - 10]
    place = lambda: max(1, r.choice(edges) + r.randint(-3, 3))
    span = lambda: sorted((place(), place())) if r.random() < 0.5 else (lambda p: [p, p + r.randint(0, 4)])(place())
    rows = [(k, r.choice("ab"), *span()) for k in range(120)] + [(120, "a", (1 << 41) + 5, (1 << 41) + 5)]
    asked = [(k, r.choice("ab"), *span()) for k in range(60)] + [(60, "a", (1 << 41) + 1, None), (61, "b", 1, None)]
    asked = [q if k % 7 else (*q[:3], None) for k, q in enumerate(asked)]
    want = sorted((q[0], x[0]) for q in asked for x in rows if meets(x, q))
    for strategy in ("broadcast", "binned"):
        got = overlap_join(frame(spark, rows), frame(spark, asked, "ordinal"), strategy)
        assert got.columns == ["record_id", "ref", "start", "end", "ordinal"]
        assert sorted((x.ordinal, x.record_id) for x in got.collect()) == want


@pytest.mark.parametrize("seed", [5, 6])
def test_cells_and_pairs_at_any_coordinate(spark, seed):
    """Around the borders of cells of all widths; points, wide and open requests; ends before starts and equal rows."""
    r = random.Random(seed)
    edges = [1, *(1 << k for k in (6, 7, 9, 10, 13, 16, 30, 38, 41, 50, 60, 62)), coords.LONG_MAX - 10]
    place = lambda: max(1, r.choice(edges) + r.randint(-3, 3))
    near = lambda p: [p, min(coords.LONG_MAX, p + r.choice((-3, 0, 1, 40, 500, 1500, 9000)))]
    span = lambda: sorted((place(), place())) if r.random() < 0.4 else near(place())
    rows = [(k, r.choice("ab"), *span()) for k in range(150)]
    rows += [(k, *rows[k - 150][1:]) for k in range(150, 170)] + [(3, "a", 7, 90)]
    asked = [(k, r.choice("ab"), *span()) for k in range(70)] + [(70, "a", (1 << 41) + 1, None), (71, "b", 1, None), (72, "c", 1, None)]
    asked = [q if k % 7 else (*q[:3], None) for k, q in enumerate(asked)]
    got = overlap_join(frame(spark, rows), frame(spark, asked, "ordinal"), "cells")
    assert got.columns == ["record_id", "ref", "start", "end", "ordinal"]
    assert sorted((x.ordinal, x.record_id) for x in got.collect()) == sorted((q[0], x[0]) for q in asked for x in rows if meets(x, q))
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and meets(x, y))
    assert sorted((x.record_id, x.other_id) for x in pairs(frame(spark, rows)).collect()) == want
    assert pairs(frame(spark, rows).limit(0)).collect() == [] == overlap_join(frame(spark, rows), frame(spark, asked, "ordinal").limit(0), "cells").collect()


@pytest.mark.parametrize("name", ["interval_pairs_binned", "layout_overlap"])
def test_dense_records_are_compared_with_few(spark, tmp_path, monkeypatch, name):
    """What is compared, counted as if all of it met, is not much more than what meets."""
    import datetime

    from spanframe.plans.queries import QUERIES

    r, began = random.Random(8), datetime.datetime(2024, 1, 1)
    events = [(k, began + datetime.timedelta(seconds=r.randint(0, 30_000)), "view", r.random() * 60) for k in range(4000)]
    spark.createDataFrame(events, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(0, 9000, 3).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES[name](spark, str(tmp_path)).count()
    monkeypatch.setattr(coords, "overlaps", lambda *_: F.lit(True))
    assert 1000 < found <= QUERIES[name](spark, str(tmp_path)).count() < 5 * found


def test_many_wide_requests(spark):
    """100,000 requests over whole references: some bins each, not one for each 16 kb."""
    records = frame(spark, [(k, "a", 1 + k * 100_000_000, 5 + k * 100_000_000) for k in range(21)])
    requests = spark.range(100_000).select(F.col("id").alias("ordinal"), F.lit("a").alias("ref"), F.lit(1).cast("long").alias("start"), F.when(F.col("id") % 2 == 0, F.lit(1 << 31)).cast("long").alias("end"))
    assert overlap_join(records, requests, "binned").count() == 21 * 100_000


def test_query_modes(spark):
    rows = [(0, "chr1", 7, 8, "x"), (1, "chr1", 20, 35, "y"), (2, "chr2", 5, 5, "z")]
    df = spark.createDataFrame(rows, "record_id long, ref string, start long, end long, raw string")
    ask = lambda *texts: [parse_region(t) for t in texts]
    raws = lambda *a, **k: [r.raw for r in query(spark, df, *a, **k).collect()]
    assert raws(ask("chr2:1-20", "chr1:1-20")) == ["z", "x", "y"]
    assert raws(ask("chr1:1-25", "chr1:10-30")) == ["x", "y", "y"]
    assert raws(ask("chr1:1-25", "chr1:10-30"), unique=True) == ["x", "y"]
    assert raws(ask("chr1:15-30", "chr1:1-25"), unique=True) == ["y", "x"]
    assert raws(ask("chr1:1-25", "chr1:10-30", "chr2:9"), separate=True) == ["#chr1:1-25", "x", "y", "#chr1:10-30", "y", "#chr2:9"]
    assert raws(targets=ask("chr1:15-40", "chr2:1-10")) == ["y", "z"]
    assert raws(ask("chr1:1-25"), ask("chr1:13-40")) == ["y"]
    assert raws(ask("chr1:20-", "chr2")) == ["y", "z"]
    for bad in (dict(unique=True, separate=True, requests=ask("chr1")), dict(), dict(targets=ask("chr1"), separate=True)):
        with pytest.raises(ValueError):
            query(spark, df, **bad)
    with pytest.raises(RegionError):
        query(spark, df, ask("chr9"), references=df)


def covered(rows):
    return {(r, p) for _, r, s, e in rows for p in range(s, e + 1)}


def pieces(points):
    out = []
    for ref, p in sorted(points):
        if out and out[-1][0] == ref and out[-1][2] == p - 1:
            out[-1][2] = p
        else:
            out.append([ref, p, p])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", [3, 4])
def test_islands(spark, seed):
    rows, others = draw(seed, 25), draw(seed + 50, 10)
    all_ = covered(rows)
    got = lambda df: sorted((r.ref, r.start, r.end) for r in df.collect())
    assert got(islands.coalesce(frame(spark, rows))) == pieces(all_)
    hull = {(ref, p) for ref in ("a", "b") for p in range(min(p for r, p in all_ if r == ref), max(p for r, p in all_ if r == ref) + 1)}
    assert got(islands.gaps(frame(spark, rows))) == pieces(hull - all_)
    left = islands.subtract(frame(spark, others, "id"), frame(spark, rows))
    for o in others:
        assert got(left.filter(F.col("id") == o[0])) == pieces(covered([o]) - all_)


def test_open_end_is_merged_without_overflow(spark):
    rows = [(0, "a", 5, coords.LONG_MAX), (1, "a", 9, 10), (2, "a", 1, 4)]
    assert [tuple(r) for r in islands.coalesce(frame(spark, rows)).collect()] == [("a", 1, coords.LONG_MAX)]


def test_index_tables(spark):
    rows = sorted(draw(9, 200, most=100_000), key=lambda r: (r[1], r[2]))
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    df = frame(spark, rows).withColumn("next_id", F.col("record_id") + 1)
    shift = 10
    linear = {}
    for k, ref, _, e in rows:
        for w in range(((e - 1) >> shift) + 1):
            linear.setdefault((ref, w), k)
    assert {(r.ref, r.window): r.min_offset for r in index.linear_index(df, shift).collect()} == linear
    meta = {r.ref: (r.first_id, r.last_id, r.n) for r in index.metadata(df).collect()}
    na = sum(r[1] == "a" for r in rows)
    assert meta == {"a": (0, na, na), "b": (na, 200, 200 - na)}
    held = [(r.chunk_start, r.chunk_end) for r in index.bin_chunks(df, shift, 4).collect()]
    assert sum(b - a for a, b in held) == 200 and len({a for a, _ in held}) == len(held)
    index.validate(df)


@pytest.mark.parametrize("rows,say", [
    ([(0, "a", 5, 6), (1, "a", 4, 6)], "starts before"),
    ([(0, "a", 1, 2), (1, "b", 1, 2), (2, "a", 3, 4)], "one piece"),
    ([(0, "a", 1, 536_870_913)], "beyond"),
])
def test_index_rejects(spark, rows, say):
    with pytest.raises(FormatError, match=say):
        index.validate(frame(spark, rows).withColumn("next_id", F.col("record_id") + 1))


def test_index_takes_its_last_position(spark):
    index.validate(frame(spark, [(0, "a", 1, 536_870_912)]).withColumn("next_id", F.lit(1)))


def test_layout_prunes(spark, tmp_path):
    """Many requests: hits as without a layout, from few of its slabs; names of references stay text."""
    rows = [(k, "01" if k % 3 else "a", 1 + k * 9973 % 5_000_000, 1 + k * 9973 % 5_000_000 + k % 500) for k in range(3000)]
    path = str(tmp_path / "layout")
    index.write_layout(frame(spark, rows), path)
    asked = [(k, "01", 1 + k * 31, 200 + k * 31) for k in range(2500)] + [(9000, "a", 4_900_000, None), (9001, "b", 1, None)]
    requests = spark.createDataFrame(asked, "ordinal long, ref string, start long, end long")
    df = index.read_layout(spark, path, requests)
    want = sorted((o, r[0]) for o, ref, a, b in asked for r in rows if r[1] == ref and r[3] >= a and (b is None or r[2] <= b))
    assert sorted((r.ordinal, r.record_id) for r in df.collect()) == want
    read = index.slabs_for(spark, path, requests).agg(F.sum("n")).first()[0]
    assert read < 0.1 * len(rows)
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [concat_ws" in plan
    assert index.read_layout(spark, path, requests.limit(0)).collect() == []


@pytest.mark.parametrize("csi", [False, True])
def test_lookup_against_the_codec(spark, csi):
    """Chunks of requests of any width, near the tree's end and beyond, with and without windows."""
    from spanframe.operators.lookup import index_tables, lookup, merged
    from spanframe.sources.tabix_codec import Index, Reference, chunks_of
    from spanframe.functions.config import PRESETS

    r, most = random.Random(csi), coords.capacity()
    rows, at = [], 0
    for ref in ("a", "b"):
        for start in sorted(r.choice([r.randint(1, 3_000_000), r.randint(1, most - 1)]) for _ in range(400)):
            rows.append((at, at + 10, ref, start, min(most, start + r.choice([0, 50, 40_000, 3_000_000]))))
            at += r.choice([10, 10, 700_000])
    df = spark.createDataFrame(rows, "record_id long, next_id long, ref string, start long, end long")
    found = {n: Reference(n) for n in ("a", "b")}
    for x in index.bin_chunks(df).orderBy("ref", "bin", "chunk_start").collect():
        found[x.ref].bins.setdefault(x.bin, []).append((x.chunk_start, x.chunk_end))
    for x in [] if csi else index.linear_index(df).orderBy("ref", "window").collect():
        found[x.ref].linear.append(x.min_offset)
    held = Index("csi" if csi else "tbi", PRESETS["bed"], list(found.values()))
    asked = [(k, r.choice("aabc"), (a := r.choice([1, r.randint(1, 3_000_000), r.randint(1, most + 5)])), r.choice([None, a, a + 20_000, a + 5_000_000, most, most + 9])) for k in range(300)]
    asked = [x for x in asked if x[3] is None or x[3] >= x[2]]
    got: dict = {}
    for x in merged(lookup(spark.createDataFrame(asked, "ordinal long, ref string, start long, end long"), *index_tables(spark, held))).collect():
        got.setdefault(x.ordinal, []).append((x.chunk_start, x.chunk_end))
    assert {k: sorted(v) for k, v in got.items()} == {k: c for k, ref, a, b in asked if ref in found and (c := chunks_of(held, found[ref], a, b))}


@pytest.mark.parametrize("depth", [5, 3])
def test_merged_lookup_of_sorted_records(spark, depth):
    """As every chunk held against every request: any width, near the tree's end and beyond, ends before starts."""
    from spanframe.operators.lookup import lookup_merged

    r, most = random.Random(depth), coords.capacity(14, depth)
    rows, at = [], 0
    for ref in ("a", "b"):
        for start in sorted(r.choice([r.randint(1, 3_000_000), r.randint(1, most - 1)]) for _ in range(300)):
            rows.append((at, at + 10, ref, start, min(most, start + r.choice([0, 50, 40_000, 3_000_000]))))
            at += r.choice([10, 10, 700])
    df = spark.createDataFrame(rows, "record_id long, next_id long, ref string, start long, end long")
    bins, linear = index.bin_chunks(df, 14, depth), index.linear_index(df, 14)
    asked = [(k, r.choice("aabc"), (a := r.choice([1, 1 << 20, r.randint(1, 3_000_000), r.randint(1, most + 5)])), r.choice([None, a, a - 1, a - 50_000, a + 20_000, a + 5_000_000, most, most + 9])) for k in range(400)]
    got: dict = {}
    for x in lookup_merged(spark.createDataFrame(asked, "ordinal long, ref string, start long, end long"), bins, linear, 14, depth).collect():
        got.setdefault(x.ordinal, []).append((x.chunk_start, x.chunk_end))
    held = [(x.ref, k := max(k for k in range(depth + 1) if x.bin >= coords.level_offset(k)), x.bin - coords.level_offset(k), x.chunk_start, x.chunk_end) for x in bins.collect()]
    windows = {(x.ref, x.window): x.min_offset for x in linear.collect()}
    want: dict = {}
    for o, ref, a, b in asked:
        if a > most:
            continue
        low, high = a - 1 >> 14, (most if b is None else min(b, most)) - 1 >> 14
        least = windows.get((ref, min(low, max((w for x, w in windows if x == ref), default=0))), 0)
        for start, end in sorted(c for x, k, own, *c in held if x == ref and low >> 3 * (depth - k) <= own <= high >> 3 * (depth - k) and c[1] > least):
            if o in want and start <= want[o][-1][1]:
                want[o][-1] = (want[o][-1][0], max(end, want[o][-1][1]))
            else:
                want.setdefault(o, []).append((start, end))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_lookup_of_every_event_makes_few_rows(spark, tmp_path, monkeypatch):
    """A request an event, some for all of the reference: what is merged are the windows asked for, not requests times chunks."""
    import datetime

    import duckdb

    from spanframe.operators import lookup
    from spanframe.plans.queries import QUERIES, SQL

    r, began = random.Random(7), datetime.datetime(2024, 1, 1)
    places = [(began + datetime.timedelta(seconds=r.randint(0, 600_000)), r.choice((3.0, 70.0, 900.0))) for _ in range(400)]
    spark.createDataFrame([(k, places[k % 400][0], "view", places[k % 400][1]) for k in range(12_000)], "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    merged, inner = [], lookup.coalesce
    monkeypatch.setattr(lookup, "coalesce", lambda spans: merged.append(spans.count()) or inner(spans))
    got = QUERIES["index_lookup"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got.select("ordinal", "chunk_start", "chunk_end").collect())) == sorted(duck.sql(f"SELECT ordinal, chunk_start, chunk_end FROM ({SQL['index_lookup']})").fetchall())
    assert sum(merged) < 12_000


def test_ranked(spark):
    rows = [(k, k * 7919 % 101, k % 4) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, v long, w long")
    got = ranked(spark, df, [F.col("v").desc(), F.col("id")], "place", {"ahead": "w"}).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    total = 0
    expected = {}
    for place, (k, _, w) in enumerate(order):
        expected[k] = (place, total)
        total += w
    assert {r.id: (r.place, r.ahead) for r in got} == expected
    assert ranked(spark, df.limit(0), [F.col("id")], "place").count() == 0
