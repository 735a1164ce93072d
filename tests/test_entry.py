"""Every query that has SQL agrees with DuckDB on the small tables; streams agree with their batch form."""

import os

import duckdb
import pytest

from spanframe.plans.queries import QUERIES, SQL, ev
from spanframe.functions.regions import parse_region
from spanframe.operators.overlap import overlap_join, requests_df
from spanframe.streaming.overlap import stream_overlap, windowed_hits

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    expected = duck.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(expected.columns)
    rows = lambda table: sorted(repr(tuple(r[table[1].index(n)] for n in names)) for r in table[0])
    assert rows(([tuple(r) for r in got.collect()], got.columns)) == rows((expected.fetchall(), expected.columns))


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    asked = requests_df(spark, [parse_region("view:1-1500000"), parse_region("error")])
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    span = "event_id AS record_id", "event_type AS ref", "unix_timestamp(ts) - 1704067199 AS start", "unix_timestamp(ts) - 1704067199 + floor(value) AS end", "ts"
    for df, name in ((stream_overlap(stream.selectExpr(*span), asked), "hits"), (windowed_hits(stream.selectExpr(*span), asked), "windows")):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "hits" else "complete").start()
        q.processAllAvailable()
        q.stop()
    want = overlap_join(ev(spark, SF), asked, "broadcast").count()
    assert want and spark.table("hits").count() == want
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == want
