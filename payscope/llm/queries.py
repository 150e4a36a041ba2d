"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payscope.llm import (
    hard_negatives,
    language_mix,
    license_scan,
    line_dedup,
    merkle,
    mixing,
    packing,
    period_runs,
    quality,
    secret_scan,
    simhash,
    topk_search,
    toxicity,
)
from payscope.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(table(spark, sf_dir, "documents")))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.search(rows, F.col("vec_id") % 20 == 0, k=20)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.find(table(spark, sf_dir, "documents")))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_pairs(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed_documents(table(spark, sf_dir, "documents"), vocabulary)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mix.classify(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(table(spark, sf_dir, "embeddings").withColumn("label", changed))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.find(table(spark, sf_dir, "documents"), change=period_runs.planted)
    return period_runs.digest(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_topk_search": op2_topk_search,
    "op3_license_scan": op3_license_scan,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_mix_sources": op5_mix_sources,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_language_id": op11_language_id,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_period_runs": op13_period_runs,
}

