from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "word " * 30_000
TEXTS = [
    (1, "One fine day the old fox went over the hill to see a friend.\nSecond line here.\n"),
    (2, "One fine day the old fox went over the hill to see a friend.\nSecond line here.\n"),
    (2, "One fine day the old fox went over the hill to see a friend.\nSecond line here.\n"),
    (3, None),
    (4, ""),
    (5, " \n\t\n"),
    (None, "a text without an id, which has words enough to be a text of its own"),
    (6, LONG),
    (7, "x" * 40_000),
    (8, "One fine day the old fox went over the hill to see a cousin.\nÉtude — 漢字 🙂 <|endoftext|>\u2028\x1c!"),
]


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    from tagloom.llm.workers import reach

    reach(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators might use."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.withColumns({c: F.lit("kept") for c in ("id", "node", "place", "rules", "lines", "hash", "line", "stats")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
