"""Helpers of plans: the bitmap split and the shared folder."""

import pytest
from pyspark.sql import functions as F

from spanframe.plans.bitmap import split
from spanframe.plans.scratch import shared_dir, stored


@pytest.mark.parametrize("bits", [6, 10, 24])
def test_split_keeps_every_key_together(spark, bits):
    df = spark.createDataFrame([(k if k % 50 else None, f"row {k}") for k in range(2000)], "id long, text string")
    keys = spark.createDataFrame([(k,) for k in range(0, 2000, 7)] + [(None,)], "k long")
    maybe, others = split(spark, df, F.col("id"), keys, F.col("k"), bits)
    assert maybe.columns == others.columns == df.columns
    wanted = {k for k in range(0, 2000, 7) if k % 50} | {None}
    left, right = {r.text: r.id for r in maybe.collect()}, {r.text: r.id for r in others.collect()}
    assert len(left) + len(right) == 2000 and not left.keys() & right.keys()
    assert not wanted & set(right.values())
    if bits == 24:
        assert set(left.values()) == wanted


def test_split_by_nothing(spark):
    df = spark.range(10)
    maybe, others = split(spark, df, F.col("id"), spark.range(0), F.col("id"))
    assert maybe.count() == 0 and others.count() == 10


def test_stored_goes_to_the_named_folder(spark):
    df = stored(spark, spark.range(5), "five")
    assert df.count() == 5 and all(shared_dir(spark).removeprefix("file:") in f for f in df.inputFiles())
    assert stored(spark, spark.range(0), "none").count() == 0


def test_release_keeps_what_is_read(spark):
    from spanframe.plans import scratch

    older = scratch.stored(spark, spark.range(3), "older")
    begun = scratch.mark()
    inner, kept = scratch.stored(spark, spark.range(5), "inner"), scratch.stored(spark, spark.range(7), "kept")
    scratch.release(spark, begun, kept)
    assert older.count() == 3 and kept.count() == 7
    with pytest.raises(Exception):
        inner.count()
    scratch.release(spark, begun)
    with pytest.raises(Exception):
        kept.count()
    assert older.count() == 3


def test_split_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(k, "x", "y", "z") for k in range(50)], "k long, __place string, __word string, __BITS string")
    maybe, others = split(spark, df, F.col("k"), df.filter("k % 7 = 0").select("k"), F.col("k"))
    assert maybe.columns == others.columns == df.columns
    assert {r.k for r in maybe.collect()} >= set(range(0, 50, 7)) and maybe.count() + others.count() == 50
