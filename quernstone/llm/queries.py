"""Queries of the corpus operators, each over its whole table, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quernstone.llm import arc2warc, decontaminate, kdshard, knnquality, langkernel, packing, simhash, suffixdedup, urlglob, weakrules
from quernstone.session import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark text in documents. Special cases: decontaminate.spans."""
    return decontaminate.verdicts(decontaminate.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of documents by their metadata. Special cases: kdshard.assign."""
    return kdshard.assign(table(spark, sf_dir, "documents"))


def op3_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document. Special cases: knnquality.classify."""
    return knnquality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's URL. Special cases: urlglob.judge."""
    return urlglob.judge(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. Special cases: langkernel.identify."""
    return langkernel.identify(table(spark, sf_dir, "documents"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of every page, by way of an ARC archive of it. Special cases: arc2warc.warc_records and convert."""
    return arc2warc.convert_pages(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that repeat earlier documents. Special cases: suffixdedup.spans."""
    return suffixdedup.spans(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in training sequences. Special cases: packing.assign."""
    return packing.assign(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near and exact duplicates among documents. Special cases: simhash.groups."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document. Special cases: weakrules.score."""
    return weakrules.score(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_decontaminate, op2_kd_sharding, op3_knn_quality, op4_url_filter, op5_language_id, op6_arc_to_warc, op7_suffix_dedup, op8_best_fit_packing, op9_simhash_near_dedup, op10_weak_supervision)
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {"op1_decontaminate": decontaminate.verdicts_sql(), "op4_url_filter": urlglob.judge_sql()}
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
