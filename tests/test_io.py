from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tagloom import session
from tagloom.sinks import writers
from tagloom.sources import tables as src
from tests.conftest import rows


def test_daily_counts_from_dates_or_day_numbers(spark, tmp_path):
    day = dt.date(2020, 4, 9)
    for name, kind in (("dates", "date"), ("days", "int")):
        value = day if kind == "date" else 18361
        df = spark.createDataFrame([(value, "#a", 2, "x"), (None, "#b", 1, "x")], f"date {kind}, tag string, count int, extra string")
        writers.write_table(df, str(tmp_path / name))
        got = src.read_daily_counts(spark, str(tmp_path / name), "hashtag")
        assert dict(got.dtypes) == {"date": "date", "tag": "string", "tag_type": "string", "count": "bigint"}
        assert rows(got) == [(None, "#b", "hashtag", 1), (day, "#a", "hashtag", 2)]
        assert "extra" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="missing columns"):
        src.with_tag_type(df.drop("tag"), "hashtag")


def test_modeling_frame_needs_its_columns(spark):
    with pytest.raises(ValueError, match="rolling_std_7"):
        src.modeling_rows(spark.createDataFrame([(True,)], "modeling_ready boolean"))


def test_optional_artifacts(spark, tmp_path):
    assert src.read_if_exists(spark, str(tmp_path / "none"), "csv") is None
    assert src.read_first_existing(spark, [str(tmp_path / "none")], "json") is None
    spark.range(3).write.csv(str(tmp_path / "b"), header=True)
    found = src.read_first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "csv")
    assert dict(found.dtypes) == {"id": "int"} and found.count() == 3


def test_date_partitions_prune(spark, tmp_path):
    df = spark.range(100).selectExpr("date_add(DATE'2020-01-01', cast(id % 5 as int)) AS date", "cast(id as string) AS text")
    writers.write_by_date(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert rows(back.select("date", "text")) == rows(df)
    plan = back.where("date = DATE'2020-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert len(list((tmp_path / "t" / "date=2020-01-02").glob("*.parquet"))) == 1


def test_comparison_rows_of_other_runs_survive(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 1)], "run_label string, n int")
    writers.write_comparison(df, str(tmp_path / "c"))
    writers.write_comparison(df.where("run_label = 'b'").withColumn("n", F.lit(2)), str(tmp_path / "c"))
    assert rows(spark.read.parquet(str(tmp_path / "c")), "run_label", "n") == [("a", 1), ("b", 2)]


def test_a_failed_and_repeated_comparison_leaves_one_version(spark, tmp_path):
    path = str(tmp_path / "c")
    old = spark.createDataFrame([("a", 1), ("b", 1)], "run_label string, n int")
    writers.write_comparison(old, path)
    new = spark.range(0, 40, 1, 8).select(F.lit("b").alias("run_label"), F.col("id").cast("int").alias("n"))
    lost = new.withColumn("n", F.when(F.col("n") == 39, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        writers.write_comparison(lost, path)
    assert rows(spark.read.parquet(path), "run_label", "n") == [("a", 1), ("b", 1)]
    for _ in range(2):
        writers.write_comparison(new, path)
    assert rows(spark.read.parquet(path), "run_label", "n") == [("a", 1), *sorted((("b", n) for n in range(40)), key=repr)]


def test_pairs_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, count long")
    writers.write_pairs(df, str(tmp_path / "p"))
    lines = [line for f in sorted((tmp_path / "p").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["(c,9)", "(a,2)", "(b,2)"]


def test_staged_tables_live_in_the_shared_folder(spark):
    folder = session.shared_folder(spark)
    table = session.staged(spark.range(5), "numbers")
    assert all(f"{folder}/tagloom/" in f and "/numbers-" in f for f in table.inputFiles())
    plan = table.where("id > 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan


def test_staging_frees_its_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.length()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    table = session.staged(spark.range(5_000).groupBy((F.col("id") % 700).alias("k")).count(), "groups")
    until = time.time() + 5
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and table.count() == 700
    assert spark.conf.get(session.FREE_SHUFFLES) == "false"


def test_broadcast_only_with_a_small_bound(spark):
    df = spark.range(3)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(session.broadcast_if_bounded(df, 30))
    assert not hinted(session.broadcast_if_bounded(df, None))
    assert not hinted(session.broadcast_if_bounded(df, session.BROADCAST_ROWS + 1))


class _Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, key, default=None):
        return self.folder or default


class _Session:
    """Just enough of a session to ask for its folder."""

    def __init__(self, master, folder=None):
        self.conf = _Conf(folder)
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()


def test_the_cluster_names_the_shared_folder():
    assert session.shared_folder(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(_Session("yarn"))
    local = _Session("local[2]")
    assert session.shared_folder(local) == session.shared_folder(local)
