"""Artifact inspection, validation and retrieval evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions import text as T
from folia.sources.files import EVAL_CASE_SCHEMA
from folia.sources.sinks import COUNT_FIELDS, artifact_counts

# --- Fixed values: fields every artifact must carry, and the default cases ----------------
REQUIRED_FIELDS = {
    "doc_catalog": ("doc_id", "path", "title", "category", "aliases", "summary_short"),
    "title_aliases": ("alias", "normalized_alias", "doc_id", "title", "category", "alias_type"),
    "doc_summaries": (
        "doc_id", "title", "category", "summary_short", "summary_structured", "focus_points", "related_doc_ids",
    ),
    "sections_structured": (
        "section_id", "doc_id", "path", "title", "section_heading", "content_type", "text", "token_count",
        "has_formula", "has_table",
    ),
    "formula_cards": (
        "formula_id", "doc_id", "title", "path", "section_heading", "formula_text", "variables", "variable_hints",
    ),
}
INDEX_FIELDS = {"document": ("token_count", "title"), "section": ("section_heading", "section_kind")}
DEFAULT_CASES = (
    ("rule_count", "偿二代二期监管规则一共有多少号规定？", "Knowledge_Base_MarkDown/manifest.json", "规则数量类"),
    ("rule2_overview", "保险公司偿付能力监管规则第2号主要涉及什么内容？", "rules/保险公司偿付能力监管规则第2号：最低资本.md", "单规则概览类"),
    ("minimum_capital_components", "最低资本由哪些部分组成？", "rules/保险公司偿付能力监管规则第2号：最低资本.md", "条文结论类"),
    ("rule2_formula", "规则第2号里最低资本的计算公式是什么？请解释变量含义。", "rules/保险公司偿付能力监管规则第2号：最低资本.md", "公式解释类"),
    ("threshold_interest_curve", "终极利率暂定为多少？", "attachments/附件1：寿险合同负债评估的折现率曲线.md", "阈值类"),
    ("attachment4_summary", "附件4是什么，主要包含什么内容？", "attachments/附件4：保险公司压力测试必测压力情景和必测因素.md", "附件定位类"),
    ("notice_adjustment", "优化保险公司偿付能力监管标准的通知调整了哪些规则？", "notices/【2023-9 金规5号】国家金融监督管理总局关于优化保险公司偿付能力监管标准的通知.md", "通知调整类"),
    ("control_risk_relation", "控制风险最低资本按照哪一项规则计量？", "rules/保险公司偿付能力监管规则第12号：偿付能力风险管理要求与评估.md", "跨规则关系类"),
)


def default_eval_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_CASES), EVAL_CASE_SCHEMA)


def samples(tables: dict[str, DataFrame], size: int = 2) -> dict[str, DataFrame]:
    """First rows of each artifact."""
    return {name: table.limit(size) for name, table in tables.items()}


def missing_fields(df: DataFrame, name: str, required: tuple[str, ...], key: list | None = None) -> DataFrame:
    """(artifact, missing, rows, first_key): one row per required field that is absent or NULL somewhere.

    ``first_key`` is the smallest key of an offending row, one aggregate over the table.
    """
    absent = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    spot = F.struct(*(key or df.columns[:1]))
    counted = df.agg(
        F.count("*").alias("n"),
        F.min(spot).cast("string").alias("any_key"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in present],
        *[F.min(F.when(F.col(c).isNull(), spot)).cast("string").alias(f"k_{c}") for c in present],
    )
    rows = [
        F.struct(F.lit(c).alias("missing"), F.col("n").alias("rows"), F.col("any_key").alias("first_key")) for c in absent
    ] + [
        F.struct(F.lit(c).alias("missing"), F.col(f"n_{c}").alias("rows"), F.col(f"k_{c}").alias("first_key"))
        for c in present
    ]
    return counted.select(F.lit(name).alias("artifact"), F.inline(F.array(*rows))).filter(F.col("rows") > 0)


def count_mismatches(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """(field, expected, actual) where the build manifest disagrees with the tables."""
    fields = [COUNT_FIELDS[n] for n in tables if COUNT_FIELDS[n] in manifest.columns]
    actual = artifact_counts(tables).select(*[F.col(f).alias(f"a_{f}") for f in fields])
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit(0)).cast("long").alias("expected"), F.col(f"a_{f}").alias("actual"))
            for f in fields
        ]
    )
    # Both sides are single rows.
    return manifest.join(F.broadcast(actual), F.lit(True)).select(F.inline(pairs)).filter("expected <> actual")


def noisy_variables(formulas: DataFrame, limit: int = 5) -> DataFrame:
    """First formulas whose variables still hold LaTeX control words, with three of the words."""
    words = F.filter("variables", lambda v: T.norm_text(v).isin(*P.LATEX_CONTROL_WORDS))
    noisy = formulas.select("formula_id", F.slice(words, 1, 3).alias("noisy")).filter(F.size("noisy") > 0)
    return noisy.orderBy("formula_id").limit(limit)


def validate(tables: dict[str, DataFrame], manifest: DataFrame | None) -> dict[str, DataFrame]:
    """Validation reports; the artifacts are sound when ``missing`` and ``counts`` are empty."""
    spark = next(iter(tables.values())).sparkSession
    expected = [*REQUIRED_FIELDS, "relation_edges", "build_manifest"]
    present = {**tables, **({"build_manifest": manifest} if manifest is not None else {})}
    gone = spark.createDataFrame([(n,) for n in expected if n not in present], "artifact string")
    fields = [missing_fields(tables[n], n, f) for n, f in REQUIRED_FIELDS.items() if n in tables]
    reports = {"absent": gone, "missing": reduce(DataFrame.unionByName, fields)}
    if manifest is not None:
        reports["counts"] = count_mismatches(tables, manifest)
    if "formula_cards" in tables:
        reports["warnings"] = noisy_variables(tables["formula_cards"])
    return reports


def index_metadata_report(documents: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Fields a retrieval index needs and does not have."""
    report = missing_fields(documents, "document", INDEX_FIELDS["document"])
    return report if sections is None else report.unionByName(missing_fields(sections, "section", INDEX_FIELDS["section"]))


def readiness(present: dict[str, bool], spark: SparkSession) -> DataFrame:
    """One row with a flag per input and ``ready`` when all are there."""
    columns = {**present, "ready": all(present.values())}
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"`{c}` boolean" for c in columns))


# --- retrieval evaluation ----------------------------------------------------------------
def evaluate_retrieval(cases: DataFrame, candidates: DataFrame, prefix: str = P.REGULATORY_ZH.doc_prefix) -> DataFrame:
    """Per case whether its expected document is among the candidates, with the first ten.

    ``cases(case_id, question, expected_doc, category)``; ``candidates(case_id, ord, doc_id)``.
    The hit test is an equi-join; only ten candidates per case are listed.
    """
    wanted = cases.withColumn("expected_doc", T.canonical_doc_id("expected_doc", prefix))
    ids = candidates.select("case_id", "ord", T.canonical_doc_id("doc_id", prefix).alias("doc_id")).filter("doc_id <> ''")
    first = ids.groupBy("case_id", "doc_id").agg(F.min("ord").alias("ord"))
    found = wanted.join(
        first.select("case_id", F.col("doc_id").alias("expected_doc")), ["case_id", "expected_doc"], "left_semi"
    ).select("case_id", F.lit(True).alias("ok"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("ord", "doc_id"))
    shown = (
        first.withColumn("rank", rank).filter(F.col("rank") <= 10).groupBy("case_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("c"))
        .select("case_id", F.transform("c", lambda s: s["doc_id"]).alias("candidate_doc_ids"))
    )
    none = F.slice(F.array(F.lit("")), 1, 0)
    return (
        wanted.join(found, "case_id", "left").join(shown, "case_id", "left")
        .withColumn("ok", F.coalesce("ok", F.lit(False)))
        .withColumn("candidate_doc_ids", F.coalesce("candidate_doc_ids", none))
    )


def pass_rate(results: DataFrame, *by: str) -> DataFrame:
    passed = F.count_if("ok")
    return results.groupBy(*by).agg(
        F.count("*").alias("case_count"), passed.alias("passed"), (F.count("*") - passed).alias("failed"),
        F.bround(passed / F.greatest(F.lit(1), F.count("*")), 4).alias("pass_rate"),
    )


def hit_previews(hits: DataFrame, limit: int = 8, chars: int = 240) -> DataFrame:
    """First hits per question with a text preview, ready for a report."""
    return hits.filter(F.col("rank") <= limit).select(
        "query_id", "rank", "path", "source_kind", "section_heading", "retrieval_score",
        F.left(T.strip("text"), F.lit(chars)).alias("text_preview"),
    )
