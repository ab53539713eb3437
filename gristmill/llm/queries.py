"""Registered queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import table
from gristmill.llm.decontamination import contaminations
from gristmill.llm.lm_scoring import score_documents
from gristmill.llm.minhash import minhash_duplicates
from gristmill.llm.mixing import mix
from gristmill.llm.oracles import minhash_sql, mixing_sql, search_sql, secret_scan_sql, sharding_sql, spelling_sql, substring_dedup_sql
from gristmill.llm.pii import find_pii
from gristmill.llm.quality_classifier import verdicts, with_verdicts
from gristmill.llm.quality_rules import apply_rules
from gristmill.llm.ranked_search import ranked_documents
from gristmill.llm.secret_scan import scan
from gristmill.llm.sharding import shard
from gristmill.llm.simhash import near_duplicates
from gristmill.llm.spelling import spelling_variants
from gristmill.llm.substring_dedup import remove_repeats


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of documents by source: one row for each document and epoch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", F.col("mix_source").alias("source"), "epoch", "block", "slot",
                            "release", "deadline", "position")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("text_hash"))
    return with_verdicts(rows, F.col("text_hash"), verdicts(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", "lang", "quality_bits", "quality_least", "quality_limit", F.col("quality_kept").alias("kept"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [op1_mixing, op2_secret_scan, op3_quality_rules, op4_lm_scoring, op5_substring_dedup, op6_simhash, op7_quality_classifier, op8_pii, op9_decontamination,
              op10_sharding, op11_minhash, op12_spelling, op13_search]
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing_sql(), "op2_secret_scan": secret_scan_sql(), "op5_substring_dedup": substring_dedup_sql(),
            "op10_sharding": sharding_sql(), "op11_minhash": minhash_sql(), "op12_spelling": spelling_sql(), "op13_search": search_sql()}
