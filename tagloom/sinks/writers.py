"""Text, Parquet, CSV and JSON outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.corpus import combined_corpus


def write_token_lists(tokens: DataFrame, folder: str) -> dict[str, str]:
    """Text lists of the hashtags, the URLs and both, one token per line."""
    parts = {
        "hashtags": tokens.where(F.col("kind") == "hashtag").select("token"),
        "urls": tokens.where(F.col("kind") == "url").select("token"),
    }
    parts["combined"] = combined_corpus(parts["hashtags"], parts["urls"])
    paths = {name: f"{folder}/{name}" for name in parts}
    for name, df in parts.items():
        df.write.mode("overwrite").text(paths[name])
    return paths


def write_pairs(counts: DataFrame, path: str, key: str = "word") -> None:
    """``(word,count)`` lines, highest count first, ties by word."""
    lines = F.concat(F.lit("("), F.col(key), F.lit(","), F.col("count").cast("string"), F.lit(")"))
    # The sort columns stay out of the file but order it: text keeps row order per part file.
    (
        counts.orderBy(F.desc("count"), key)
        .select(lines.alias("value"))
        .write.mode("overwrite")
        .text(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table; the session carries the rebase settings."""
    df.write.mode("overwrite").parquet(path)


def write_by_date(df: DataFrame, path: str) -> None:
    """Parquet partitioned by date.

    Rows are gathered by date so that a date gives few files; the rebalance
    hint lets AQE split a date that is too big for one task.
    """
    gathered = df.hint("rebalance", F.col("date"))
    gathered.write.mode("overwrite").partitionBy("date").parquet(path)


def write_run_csv(df: DataFrame, path: str, run_label: str) -> None:
    """CSV of one run; other runs in the same folder are left alone."""
    (
        df.withColumn("run_label", F.lit(run_label))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("header", True)
        .partitionBy("run_label")
        .csv(path)
    )


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row nested run summary as JSON."""
    summary.write.mode("overwrite").json(path)


def write_comparison(rows: DataFrame, path: str) -> None:
    """Replace the runs present in ``rows`` in a table partitioned by run label.

    New partitions are written aside and take the place of old ones when all tasks have
    ended; a write that fails leaves the table as it was, and a repeated one leaves one
    version of its runs.
    """
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_label")
        .parquet(path)
    )
