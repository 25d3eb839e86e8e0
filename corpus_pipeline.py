"""The corpus pipeline: rules, classifier, line dedup, near duplicates, packing.

Each stage takes all documents that the stage before it kept and returns those it
keeps, with the columns of ``documents``; the last returns the pieces of packed
sequences.  Stages are written as Parquet below the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import classifier, jaccard_join, line_dedup, packing, quality_rules
from tagloom.llm.workers import reach
from tagloom.session import staged

#: A score from which a document is kept.
GOOD = 0.7


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    reach(spark)
    return quality_rules.keep_good(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below GOOD go; the model is fitted on the labels of those that came here."""
    reach(spark)
    model = classifier.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(classifier.score("text", model) >= GOOD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of nothing else; n_chars follows the text."""
    reach(spark)
    kept = line_dedup.keep_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    reach(spark)
    return jaccard_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    reach(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("packing", packed),
]

#: Scores of a fitted model are beyond SQL; tests check what each stage keeps, its near-duplicate classes and its pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
