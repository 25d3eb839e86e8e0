"""Raw text, JSON and CSV inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.tweets import is_readable
from tagloom.operators.quality import require_columns
from tagloom.sources.csv_records import csv_records

TWEET_CSV_SCHEMA = T.StructType(
    [T.StructField("created_at", T.StringType()), T.StructField("text", T.StringType())]
)
CORRUPT_COLUMN = "_corrupt"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as one ``value`` column."""
    return spark.read.text(path)


def drop_blank_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.where(F.trim(F.col(column)) != "")


def read_tweets_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as ``json``, blank lines skipped; parsing is left to the entity functions."""
    return drop_blank_lines(read_tokens(spark, path)).withColumnRenamed("value", "json")


def is_unreadable(json: str = "json") -> Column:
    """Whether a line is not one JSON object."""
    return ~F.coalesce(is_readable(F.col(json)), F.lit(False))


def unreadable_tweets(tweets: DataFrame) -> DataFrame:
    """Lines that are not valid JSON, so that a job can report them."""
    return tweets.where(is_unreadable() & F.col("json").isNotNull())


def read_tweets_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = TWEET_CSV_SCHEMA,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header row; other columns than those of the schema are ignored.

    Columns are found by their header name; files whose headers differ raise.  Malformed
    rows keep their text in ``_corrupt``.  Big files are read by many tasks, also where
    fields have line breaks; ``multi_line=False`` cuts records at every line break, which
    saves a pass.  ``schema=None`` reads every column and infers the types in an extra
    pass, by one task for each file if records may have line breaks.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    if schema is None:
        return spark.read.options(**options, inferSchema=True).csv(path)
    # Spark matches a given schema by position, so name the file's own columns first.
    header = require_columns(spark.read.options(**options).csv(path), schema.fieldNames()).columns
    typed = {field.name: field.dataType for field in schema.fields}
    fields = [T.StructField(name, typed.get(name, T.StringType())) for name in header]
    whole = T.StructType([*fields, T.StructField(CORRUPT_COLUMN, T.StringType())])
    if multi_line:
        return parsed_records(csv_records(spark, path), whole).select(*schema.fieldNames(), CORRUPT_COLUMN)
    return (
        spark.read.options(**options, mode="PERMISSIVE", enforceSchema=False, columnNameOfCorruptRecord=CORRUPT_COLUMN)
        .schema(whole)
        .csv(path)
        .select(*schema.fieldNames(), CORRUPT_COLUMN)
    )


def parsed_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Fields of CSV records; the first of each file must name the schema's columns."""
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN, "multiLine": "true"}
    names = [f.name for f in schema.fields if f.name != CORRUPT_COLUMN]
    texts = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    found = F.from_csv("record", texts, {"escape": '"'})
    same = F.array_compact(F.array(*[found[f"c{i}"] for i in range(len(names) + 1)])) == F.array(*[F.lit(n) for n in names])
    message = F.concat(F.lit("a file's header differs from the others: "), F.col("record"))
    wanted = F.when(~F.col("first"), True).when(same, False).otherwise(F.raise_error(message).cast("boolean"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.where(wanted).select(F.from_csv("record", fields, options).alias("row")).select("row.*")
