"""CSV records cut by many tasks equal those of the reader that takes a file in one task."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.sources import csv_records as cr
from tagloom.sources.tweets import CORRUPT_COLUMN, TWEET_CSV_SCHEMA, read_tweets_csv
from tests.conftest import rows

FIELDS = ["plain", "", 'say ""hi""', "two\nlines", 'a,b', "\n\n", '""', "x" * 300, "é\r\nñ", "#tag\n" * 20, 'inch 5"" tv,\n""']


def state_by_characters(line: str, inside: bool) -> bool:
    """The same rule, character by character."""
    field, at = not inside, 0  # whether a field begins here
    while at < len(line):
        c = line[at]
        if inside:
            if c == '"':
                if line[at + 1 : at + 2] == '"':
                    at += 1
                else:
                    inside, field = False, False
                    while at + 1 < len(line) and line[at + 1] != ",":
                        at += 1
        elif c == ",":
            field = True
        elif c == '"' and field:
            inside = True
        else:
            field = False
        at += 1
    return inside


@settings(max_examples=400, deadline=None)
@given(st.text('",ab', max_size=14), st.booleans())
def test_state_of_a_line(line, inside):
    assert cr.Quotes().ends_inside(line, inside) == state_by_characters(line, inside)


def write_files(folder, n_files: int, n_rows: int, seed: int, end: str = "\n") -> None:
    rnd = random.Random(seed)
    folder.mkdir()
    for i in range(n_files):
        lines = ["id,text,created_at"]
        for k in range(rnd.randrange(n_rows)):
            text = rnd.choice(FIELDS)
            quoted = f'"{text}"' if any(c in text for c in ',"\n\r') or rnd.random() < 0.3 else text
            lines.append(f'{k},{quoted},2020-04-{1 + k % 30:02d}')
            if rnd.random() < 0.05:
                lines.append("")
        (folder / f"f{i}.csv").write_bytes(end.join(lines).encode() + (end.encode() if rnd.random() < 0.5 else b""))


def by_one_task(spark, path):
    whole = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField(CORRUPT_COLUMN, T.StringType())])
    read = spark.read.options(header=True, escape='"', multiLine=True, columnNameOfCorruptRecord=CORRUPT_COLUMN).schema(whole)
    return read.csv(path).select("created_at", "text", CORRUPT_COLUMN)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "20")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_many_ranges_give_the_rows_of_one_task(spark, tmp_path, small_ranges, seed, end):
    write_files(tmp_path / "t", 4, 60, seed, end)
    path = str(tmp_path / "t")
    assert cr.lines_of(spark, path).rdd.getNumPartitions() > 10
    assert rows(read_tweets_csv(spark, path)) == rows(by_one_task(spark, path))


def test_without_a_broadcast_of_the_ranges(spark, tmp_path, small_ranges, monkeypatch):
    write_files(tmp_path / "t", 2, 60, 5)
    monkeypatch.setattr(cr, "broadcast_if_bounded", lambda df, n: df)
    assert rows(read_tweets_csv(spark, str(tmp_path / "t"))) == rows(by_one_task(spark, str(tmp_path / "t")))


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    text = "line of a very long field\n" * 200
    (tmp_path / "t.csv").write_text(f'text,created_at\n"{text}",2020-04-09\nshort,2020-04-10\n')
    found = rows(read_tweets_csv(spark, str(tmp_path / "t.csv")), "text", "created_at")
    assert found == [(text, "2020-04-09"), ("short", "2020-04-10")]


def test_malformed_rows_and_quotes_in_plain_fields(spark, tmp_path, small_ranges):
    lines = ["id,text,created_at"] + [f'{i},screen of 5" size,2020-04-09' for i in range(30)] + ["1,2", "1,2,3,4", ""]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    found = read_tweets_csv(spark, str(tmp_path / "t.csv"))
    assert rows(found) == rows(by_one_task(spark, str(tmp_path / "t.csv")))
    assert found.where(F.col(CORRUPT_COLUMN).isNotNull()).count() == 2


def test_differing_headers_and_open_quotes_raise(spark, tmp_path, small_ranges):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("text,created_at\nx,2020-04-09\n")
    (tmp_path / "t" / "b.csv").write_text("created_at,text\n2020-04-09,x\n")
    with pytest.raises(Exception, match="header differs"):
        read_tweets_csv(spark, str(tmp_path / "t")).collect()
    (tmp_path / "open.csv").write_text('text,created_at\n"x,2020-04-09\n' + "y,2020\n" * 50)
    with pytest.raises(Exception, match="not closed within 100"):
        cr.csv_records(spark, str(tmp_path / "open.csv"), max_record=100)


def test_empty_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("text,created_at\n")
    assert read_tweets_csv(spark, str(tmp_path / "t.csv")).columns == [*TWEET_CSV_SCHEMA.fieldNames(), CORRUPT_COLUMN]
    assert read_tweets_csv(spark, str(tmp_path / "t.csv")).count() == 0
