from __future__ import annotations

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import dates, text

CASES = [
    ("Buy #TSLA $tsla #covidー19 #中共病毒 #Mañana #A_b-c $straße", ["#tsla", "#covidー19", "#中共病毒", "#mañana", "#a_b"], ["$TSLA", "$STRAS"]),
    ("##x $googlinc $brk.b $5", ["#x"], ["$GOOGL", "$BRK"]),
    ("#a #a", ["#a", "#a"], []),
    ("http://x.test/p#frag", ["#frag"], []),
    ("", [], []),
    (None, [], []),
]


def test_extraction_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, text string")
    got = df.select("id", text.extract_hashtags(F.col("text")).alias("h"), text.extract_cashtags(F.col("text")).alias("c")).orderBy("id").collect()
    assert [(r["h"], r["c"]) for r in got] == [(c[1], c[2]) for c in CASES]


def test_sql_functions_match_the_columns(spark):
    text.register_sql_functions(spark)
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, text string")
    got = spark.sql("SELECT id, extract_hashtags(text) h, extract_cashtags(text) c FROM {df} ORDER BY id", df=df).collect()
    assert [(r["h"], r["c"]) for r in got] == [(c[1], c[2]) for c in CASES]


def test_extraction_equals_python_on_many_texts(spark):
    alphabet = "aZ9_# $ßñéー中ЖאΩ-.é\n"
    texts: list[str] = []

    @settings(max_examples=300, database=None)
    @given(st.text(alphabet=alphabet, max_size=25))
    def collect(s):
        texts.append(s)

    collect()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = df.select("id", text.extract_hashtags(F.col("text")).alias("h"), text.extract_cashtags(F.col("text")).alias("c")).orderBy("id").collect()
    for s, r in zip(texts, got):
        assert r["h"] == re.findall(r"#\w+", s.lower()), s
        assert r["c"] == re.findall(r"\$[A-Z]{1,5}", s.upper()), s


@pytest.mark.parametrize(
    "line, spaces, whitespace",
    [
        ("a  b ", ["a", "", "b"], ["a", "b"]),
        ("", [""], []),
        ("   ", [], []),
        (" a", ["", "a"], ["a"]),
        ("a\tb\r\nc", ["a\tb\r\nc"], ["a", "b", "c"]),
    ],
)
def test_tokenizers(spark, line, spaces, whitespace):
    df = spark.createDataFrame([(line,)], "value string")
    row = df.select(text.space_tokens(F.col("value")).alias("s"), text.whitespace_tokens(F.col("value")).alias("w")).first()
    assert row["s"] == spaces and row["w"] == whitespace


def test_small_string_helpers(spark):
    df = spark.createDataFrame([("Covid", "x", 1), ("", None, None), (None, "y", 2)], "a string, b string, n int")
    got = df.select(text.hash_label(F.col("a")), text.text_or_unknown(F.col("n")), text.tag_label(F.col("b"), F.lit("t"))).collect()
    assert [tuple(r) for r in got] == [("#covid", "1", "x: t"), (None, "unknown", "t"), (None, "2", "y: t")]


def test_dates(spark):
    raw = ["2020-04-09T23:59:51Z", "2020-04-09 23:59:51+00:00", "garbage", None]
    df = spark.createDataFrame([(r,) for r in raw], "c string")
    day = dt.date(2020, 4, 9)
    assert [r[0] for r in df.select(dates.to_day(F.col("c"))).collect()] == [day, day, None, None]
    one = spark.createDataFrame([(day,)], "d date").select(
        dates.week_start(F.col("d")), dates.monday_zero(F.col("d")), dates.iso_day(F.col("d")), dates.month_day(F.col("d"))
    )
    assert dict(one.dtypes)[one.columns[0]] == "timestamp"
    assert tuple(one.first()) == (dt.datetime(2020, 4, 6), 3, "2020-04-09", "04-09")


def test_days_since_epoch(spark):
    df = spark.createDataFrame([(18361.0,), (0.0,), (1e9,), (-1e9,), (None,)], "d double")
    got = [r[0] for r in df.select(dates.day_from_epoch(F.col("d"))).collect()]
    assert got == [dt.date(2020, 4, 9), dt.date(1970, 1, 1), None, None, None]
