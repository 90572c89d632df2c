"""The operators over their whole tables: (spark, directory) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folia.llm import (
    html_marginals, line_crf, line_templates, order_minhash, packing, pii, sharding, spelling, super_kmers, toxicity, weak_quality,
    winnowing, witnesses,
)
from folia.llm.oracles import ORACLES


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_sharding(spark: SparkSession, root: str) -> DataFrame:
    return sharding.shard(_table(spark, root, "documents"), 24)


def op2_pii(spark: SparkSession, root: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, root, "documents"))


def op3_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents")
    return weak_quality.score(docs, weak_quality.train(docs))


def op4_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, root, "documents"))


def op5_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, root, "labels")))


def op6_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.best_fit(_table(spark, root, "documents"))


def op7_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents")
    return line_crf.quality(docs, line_crf.train(docs, _table(spark, root, "labels")))


def op8_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    return line_templates.line_counts(_table(spark, root, "documents"))


def op9_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return winnowing.decontaminate(_table(spark, root, "documents"), _table(spark, root, "benchmark"))


def op10_html_extraction(spark: SparkSession, root: str) -> DataFrame:
    pages = _table(spark, root, "pages")
    return html_marginals.extract(pages, html_marginals.train(pages))


def op11_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    return witnesses.manifest(_table(spark, root, "documents"))


def op12_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    kept = super_kmers.drop_repeated(_table(spark, root, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", super_kmers.digest(kept["kept_text"]).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    return spelling.variants(_table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_pii, op3_quality_classifier, op4_near_dedup, op5_toxicity, op6_packing, op7_quality_rules, op8_line_dedup,
        op9_decontamination, op10_html_extraction, op11_merkle_manifest, op12_substring_dedup, op13_spelling_variants,
    )
}

__all__ = ["ORACLES", "QUERIES"]
