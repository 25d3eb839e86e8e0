"""Tag extraction and tokenizing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# What counts as a tag.  Java's plain \w is ASCII-only, so the
# Unicode letter and number classes are spelled out.
HASHTAG_PATTERN = r"#[\p{L}\p{N}_]+"
CASHTAG_PATTERN = r"[$][A-Z]{1,5}"
WHITESPACE_PATTERN = r"[ \t\n\r\f]+"


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def extract_hashtags(text: Column) -> Column:
    """All hashtags, lower-cased, repeats kept; null text gives an empty array."""
    found = F.regexp_extract_all(F.lower(text), F.lit(HASHTAG_PATTERN), F.lit(0))
    return F.coalesce(found, _no_strings())


def extract_cashtags(text: Column) -> Column:
    """All cashtags, upper-cased, one to five letters, no right boundary."""
    found = F.regexp_extract_all(F.upper(text), F.lit(CASHTAG_PATTERN), F.lit(0))
    return F.coalesce(found, _no_strings())


def hash_label(name: Column) -> Column:
    """``Covid`` -> ``#covid``; empty and null names give null."""
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("#"), F.lower(name)))


def space_tokens(line: Column) -> Column:
    """Split on single spaces: inner empties stay, trailing ones go.

    An empty line is one empty token; a line of spaces only has none.
    """
    kept = F.split(F.regexp_replace(line, " +$", ""), " ", -1)
    return F.when(line.rlike("^ +$"), _no_strings()).otherwise(kept)


def whitespace_tokens(line: Column) -> Column:
    """Split on runs of whitespace; never yields an empty token."""
    return F.array_remove(F.split(line, WHITESPACE_PATTERN), "")


def tag_label(tag_type: Column, tag: Column) -> Column:
    """``hashtag: #covid``."""
    return F.concat_ws(": ", tag_type, tag)


def text_or_unknown(value: Column) -> Column:
    """Any category as a string, missing ones as ``unknown``."""
    return F.coalesce(value.cast("string"), F.lit("unknown"))


def register_sql_functions(spark: SparkSession) -> None:
    """Offer the extractors to SQL users as temporary native functions."""
    bodies = {
        "extract_hashtags": f"regexp_extract_all(lower(t), r'{HASHTAG_PATTERN}', 0)",
        "extract_cashtags": f"regexp_extract_all(upper(t), r'{CASHTAG_PATTERN}', 0)",
    }
    for name, body in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS ARRAY<STRING> "
            f"RETURN coalesce({body}, CAST(array() AS ARRAY<STRING>))"
        )
