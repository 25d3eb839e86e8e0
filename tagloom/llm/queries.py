"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import bpe, chat, classifier, divergence, fingerprints, jaccard_join, licenses, line_dedup, packing, quality_rules, search, sql, url_filter, warc
from tagloom.llm.workers import reach
from tagloom.session import stage_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: A score from which a document counts as good.
GOOD = 0.7


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reach(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if check is not None:
            ORACLE[name] = check
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_template_tree", sql.URL_FILTER)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, then templates learned from the urls that rules label."""
    judged = url_filter.judge(table(spark, sf_dir, "pages"), sql.URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit_documents(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(classifier.fold() == 2, F.lit(False)).alias("held_out"), classifier.score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


@query("op3_line_dedup", sql.LINE_DEDUP)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("lines.text", 256).alias("text_sha256"))


@query("op4_quality_rules", sql.QUALITY_RULES)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[f"rules.{n}" for n in names])


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip("text", path).alias("coded"))
    return coded.select("doc_id", "coded.*")


@query("op6_document_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op7_lexical_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_warc_chunks", sql.WARC)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    path = stage_path(spark, "warc")
    warc.write_archives(warc.record_blocks(pages), path)
    read = warc.read_archives(spark, path)
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.Join(table(spark, sf_dir, "documents")).documents()
    return joined.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_texts")


@query("op10_license_scan", sql.LICENSES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, language and id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs, path=path).select("doc_id", "license", "license_by", "license_from")


@query("op11_source_divergence", sql.SOURCE_DIVERGENCE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_lexical_search", sql.LEXICAL_SEARCH)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_chat_format", sql.CHAT)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says the template's own marks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, i, role, sql.CHAT_SAMPLE) for i, role in enumerate(("user", "assistant"))], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(added))).withColumnRenamed("conversation", "conv_id")
