import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = "word other " * 20_000
#: Nulls, empty and blank texts, ties, repeated rows, non-ASCII, a very long text.
HARD = [
    (1, "one two three four", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "  \n\t ", "de", "b"), (5, "one two three four", "en", "a"), (5, "one two three four", "en", "a"),
    (None, "null key", "en", "a"), (None, None, None, None), (6, LONG, "en", "a"), (7, "été ▁ 漢字 🙂\r\nx", "fr", "c"), (8, "one", "en", "z"), (9, "one", "xx", "z"), (10, "a\0b", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def hard(spark):
    """The hard rows, with columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(HARD, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    for name in ("size", "shard", "key", "k", "t", "h", "fp", "component", "sample", "target", "copies", "blob", "found", "gone", "place", "row", "n", "__key", "__place", "__word", "__bits", "__gone", "__s", "__base", "__rule", "__label", "__range", "__n", "id", "no", "fp_", "prefix", "root", "epochs", "cut", "extra", "tie", "sample_key", "copy", "spans", "base", "items", "digest", "s0"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def nothing(spark, hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
