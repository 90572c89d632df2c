"""Evidence of planned questions, verified answers and catalog answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions import text as T
from folia.operators.routing import asks_rule_count

# --- Fixed values: how much evidence of each kind is cited and answered from --------------
CITED = {"summary": 2, "section": 3, "formula": 2}
ANSWERED = {"summary": 2, "section": 4, "formula": 2}
SCORE_SCALE = 100.0
CATALOG_FLOOR = 1.25
CATALOG_TYPES = ("locate", "summary", "comparison", "version")
CATALOG_DOC_ID = "manifest.json"
CATALOG_PATH = P.REGULATORY_ZH.doc_prefix + "manifest.json"
CATALOG_TITLE = "知识库目录清单"
NO_EVIDENCE = "当前 ready_data 证据不足以回答该问题；建议先检查最相关 Markdown 或重建 ready_data。"
KIND_ORDER = {"summary": 0, "section": 1, "formula": 2}

EVIDENCE_COLUMNS = (
    "query_id", "kind", "rank", "id", "doc_id", "path", "title", "section_heading", "article_no", "text", "score",
)


def evidence_scope(plans: DataFrame) -> DataFrame:
    """(query_id, scope_ord, doc_id): the planned scope, else the first two titles, in their order."""
    titles = F.transform(F.slice(F.coalesce("title_hits", F.slice("title_hits", 1, 0)), 1, 2), lambda h: h["doc_id"])
    chosen = F.when(F.size("scoped_doc_ids") > 0, F.col("scoped_doc_ids")).otherwise(titles)
    return (
        plans.filter(F.col("question_type") != "catalog")
        .select("query_id", F.posexplode(F.array_distinct(chosen)).alias("scope_ord", "doc_id"))
    )


def wants_formulas() -> Column:
    return T.has_any(F.col("question"), P.FORMULA_SEARCH_MARKERS) | (F.col("question_type") == "formula")


def wants_relations() -> Column:
    return T.has_any(F.col("question"), P.RELATION_SEARCH_MARKERS) | F.col("question_type").isin("version", "comparison")


def summary_evidence(hits: DataFrame) -> DataFrame:
    text = F.coalesce(T.blank_to_null(F.col("summary_structured")), F.col("summary_short"))
    return _evidence(hits, "summary", F.col("doc_id"), text, F.lit(None), F.lit(None))


def section_evidence(hits: DataFrame) -> DataFrame:
    return _evidence(hits, "section", F.col("section_id"), F.col("text"), F.col("section_heading"), F.col("article_no"))


def formula_evidence(hits: DataFrame) -> DataFrame:
    names = F.concat(F.lit("变量："), F.array_join("variables", "、"))
    text = T.strip(F.concat_ws("\n", "formula_text", names))
    return _evidence(hits, "formula", F.col("formula_id"), text, F.col("section_heading"), F.col("article_no"))


def _evidence(hits: DataFrame, kind: str, key: Column, text: Column, heading: Column, article: Column) -> DataFrame:
    return hits.select(
        "query_id", F.lit(kind).alias("kind"), "rank", key.alias("id"), "doc_id", "path", "title",
        heading.cast("string").alias("section_heading"), article.cast("string").alias("article_no"),
        text.alias("text"), "score",
    )


def _within(caps: dict[str, int]) -> Column:
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return F.col("rank") <= cap[F.col("kind")]


def _kind_rank() -> Column:
    return F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair])[F.col("kind")]


def citations(evidence: DataFrame) -> DataFrame:
    """First two summaries, three sections and two formulas per question, numbered in that order."""
    order = Window.partitionBy("query_id").orderBy(_kind_rank(), "rank")
    return evidence.filter(_within(CITED)).withColumn("citation", F.row_number().over(order)).select(
        "query_id", "citation", F.col("kind").alias("source_kind"), "id", "path", "title", "section_heading", "article_no"
    )


def evidence_hits(evidence: DataFrame, *, limit: int = 8) -> DataFrame:
    """Evidence as retrieval hits: two summaries, four sections, two formulas, score / 100."""
    order = Window.partitionBy("query_id").orderBy(_kind_rank(), "rank")
    return (
        evidence.filter(_within(ANSWERED) & (F.col("text") != ""))
        .withColumn("ord", F.row_number().over(order))
        .filter(F.col("ord") <= limit)
        .select(
            "query_id", "ord", "path", "title", "text", F.col("kind").alias("source_kind"), "section_heading",
            "article_no", (F.col("score") / SCORE_SCALE).alias("retrieval_score"),
        )
    )


def title_snippets(plans: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of the first two titles for the question types that want them, score at least 1.25.

    ``documents(path, title, text, token_count)``; the lookup is an equi-join on the path.
    """
    hits = plans.filter(F.col("question_type").isin(*CATALOG_TYPES)).select(
        "query_id", F.posexplode(F.slice("title_hits", 1, 2)).alias("ord", "h")
    )
    return hits.select("query_id", "ord", F.col("h.path").alias("path")).join(documents, "path").withColumn(
        "retrieval_score", F.lit(CATALOG_FLOOR)
    )


def verified_answers(
    questions: DataFrame, evidence: DataFrame, explanations: DataFrame, catalog_text: DataFrame
) -> DataFrame:
    """Extractive answer per question: catalog, else formula, else section, else summary, else none.

    ``explanations(formula_id, formula_text, variables, applicability_evidence)``;
    ``catalog_text(catalog_text)`` a single row.  ``citation`` is the source that the answer's ``[1]`` stands for: the
    catalog, the first formula or section, or the first of all sources for a summary; NULL where there is no answer.
    """
    top = evidence.filter(F.col("rank") == 1)

    def only(kind: str, *columns: str) -> DataFrame:
        return top.filter(F.col("kind") == kind).select(
            "query_id", *[F.col(c).alias(f"{kind}_{c}") for c in columns]
        )

    formula = only("formula", "id").withColumnRenamed("formula_id", "formula_key").join(
        explanations.select(
            F.col("formula_id").alias("formula_key"), "formula_text", "variables", "applicability_evidence"
        ),
        "formula_key",
    )
    joined = (
        questions.join(formula, "query_id", "left")
        .join(only("section", "text", "title", "section_heading", "article_no"), "query_id", "left")
        .join(only("summary", "text", "title"), "query_id", "left")
    )
    names = F.coalesce(T.blank_to_null(F.array_join("variables", "、")), F.lit("未识别到稳定变量"))
    context = F.when(
        F.col("applicability_evidence") != "",
        F.concat(F.lit("\n\n适用上下文证据："), T.truncate("applicability_evidence", 500)),
    ).otherwise("")
    from_formula = F.concat(
        F.lit("根据 ready_data 中的公式卡和对应 section，最相关公式为：\n\n"), F.col("formula_text"),
        F.lit("\n\n已过滤 LaTeX 控制词后的变量包括："), names, F.lit("。"), context, F.lit(" [1]"),
    )
    article = F.coalesce(F.concat(T.blank_to_null(F.col("section_article_no")), F.lit(" ")), F.lit(""))
    heading = F.coalesce(T.blank_to_null(F.col("section_section_heading")), F.col("section_title"))
    from_section = F.concat(
        F.lit("根据结构化 section 证据，"), article, heading, F.lit(" 中的相关规定是："),
        T.truncate("section_text", 700), F.lit(" [1]"),
    )
    from_summary = F.concat(
        F.lit("根据摘要层证据，"), F.col("summary_title"), F.lit(" 的要点是："), F.col("summary_text"), F.lit(" [1]")
    )
    is_catalog = F.col("question_type") == "catalog"
    # ``catalog_text`` is a single row by construction.
    answered = joined.join(F.broadcast(catalog_text), F.lit(True)).select(
        "query_id", "question", F.lit("verified").alias("mode"),
        F.when(is_catalog, F.concat(F.lit("根据目录元数据，"), F.col("catalog_text"), F.lit(" [1]")))
        .otherwise(F.coalesce(from_formula, from_section, from_summary, F.lit(NO_EVIDENCE))).alias("answer"),
        F.when(is_catalog, "catalog")
        .when(F.col("formula_text").isNotNull(), "formula")
        .when(F.col("section_text").isNotNull(), "section")
        .when(F.col("summary_text").isNotNull(), "summary")
        .otherwise("none").alias("answered_from"),
    )
    source = F.struct("source_kind", "id", "path", "title", "section_heading", "article_no")
    first = citations(evidence).groupBy("query_id", F.col("source_kind").alias("answered_from")).agg(
        F.min_by(source, "citation").alias("cited")
    )
    nothing = F.lit(None).cast("string")
    catalog = F.struct(
        F.lit("catalog").alias("source_kind"), F.lit(CATALOG_DOC_ID).alias("id"), F.lit(CATALOG_PATH).alias("path"),
        F.lit(CATALOG_TITLE).alias("title"), nothing.alias("section_heading"), nothing.alias("article_no"),
    )
    citation = F.when(F.col("answered_from") == "catalog", catalog).otherwise(F.col("cited")).alias("citation")
    return answered.join(first, ["query_id", "answered_from"], "left").select(
        "query_id", "question", "mode", "answer", "answered_from", citation
    )


# --- catalog answers ---------------------------------------------------------------------
def numbered_rules(manifest: DataFrame) -> DataFrame:
    """One row: number of numbered rule files, lowest and highest number with their files."""
    number = F.regexp_extract("title", P.RULE_NO, 1).try_cast("decimal(38,0)")
    rules = manifest.filter((F.col("category") == "rules") & F.col("title").rlike(P.RULE_NO)).withColumn("no", number)
    return rules.agg(
        F.count("*").alias("n_rules"),
        F.min("no").alias("first_no"),
        F.max("no").alias("last_no"),
        F.min_by(F.struct("title", "path"), F.struct("no", "path")).alias("first"),
        F.max_by(F.struct("title", "path"), F.struct("no", "path")).alias("last"),
    )


def catalog_count_answers(questions: DataFrame, manifest: DataFrame, *, language: str = "en") -> DataFrame:
    """Answer to rule-count questions straight from the manifest; no row for other questions."""
    facts = numbered_rules(manifest).filter(F.col("n_rules") > 0)
    n, lo, hi = (F.col(c).cast("string") for c in ("n_rules", "first_no", "last_no"))
    if language == "zh":
        answer = F.concat(
            F.lit("根据当前知识库清单，偿二代二期监管规则共收录 "), n, F.lit(" 项，编号从第"), lo, F.lit("号到第"), hi,
            F.lit(f"号。 [1] {CATALOG_PATH}"),
        )
        summary = [
            F.concat(F.lit("当前 manifest 共收录 "), n, F.lit(" 份 `rules` 类文件。")),
            F.concat(F.lit("规则编号范围：第"), lo, F.lit("号至第"), hi, F.lit("号。")),
        ]
    else:
        answer = F.concat(
            F.lit("According to the current knowledge-base manifest, the Phase II solvency rules include "), n,
            F.lit(" numbered rule files, running from Rule "), lo, F.lit(" to Rule "), hi,
            F.lit(f".[1] {CATALOG_PATH}"),
        )
        summary = [
            F.concat(F.lit("The manifest contains "), n, F.lit(" rule files.")),
            F.concat(F.lit("Rule numbers range from "), lo, F.lit(" to "), hi, F.lit(".")),
        ]
    samples = [
        F.when(
            (F.col(f"{end}.path") != "") & (F.col(f"{end}.title") != ""),
            F.concat(F.lit("- "), F.col(f"{end}.title"), F.lit(" ("), F.col(f"{end}.path"), F.lit(")")),
        )
        for end in ("first", "last")
    ]
    # One aggregate row is attached to every question; it is a single row by construction.
    return questions.filter(asks_rule_count("question")).join(F.broadcast(facts), F.lit(True)).select(
        "query_id", "question", F.lit("catalog").alias("mode"), answer.alias("answer"),
        F.lit(CATALOG_PATH).alias("path"), F.concat_ws("\n", *summary, *samples).alias("text"),
        F.lit(1.0).alias("retrieval_score"),
    )


def catalog_evidence(manifest: DataFrame) -> DataFrame:
    """One evidence row with the number of rule files."""
    count = F.coalesce(F.sum(F.when(F.col("category") == "rules", 1)), F.lit(0)).cast("string")
    text = F.concat(F.lit("manifest 共收录 "), count, F.lit(" 份 rules 类文件，可用于回答监管规则数量问题。"))
    return manifest.agg(text.alias("text")).select(
        F.lit(CATALOG_DOC_ID).alias("doc_id"), F.lit(CATALOG_PATH).alias("path"),
        F.lit(CATALOG_TITLE).alias("title"), F.lit("catalog").alias("source_kind"), "text", F.lit(1.0).alias("score"),
    )
