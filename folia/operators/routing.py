"""Question routing: types, strategies, scope and query expansion over a question table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions import text as T

# --- Fixed values: when one title dominates ----------------------------------------------
SCOPE_MIN_SCORE, SCOPE_MIN_LEAD = 60.0, 20.0
MAX_SCOPED_QUERIES = 4
CATALOG_PATH = P.REGULATORY_ZH.doc_prefix + "manifest.json"


def _tight(question) -> Column:
    return F.replace(T.col(question), F.lit(" "), F.lit(""))


def question_type(question) -> Column:
    """First matching type; the order of the tests is part of the meaning."""
    tight = _tight(question)
    return (
        F.when(T.has_any(tight, P.COMPARE_MARKERS), "comparison")
        .when(tight.rlike(P.CATALOG_COUNT), "catalog")
        .when(T.has_any(tight, P.FORMULA_TYPE_MARKERS), "formula")
        .when(T.has_any(tight, P.VERSION_MARKERS), "version")
        .when(T.has_any(tight, P.COMPLIANCE_MARKERS), "compliance")
        .when(T.has_any(tight, P.SUMMARY_MARKERS), "summary")
        .when(T.col(question).rlike(f"{P.RULE_NO}|{P.ATTACHMENT_NO}"), "locate")
        .otherwise("analysis")
    )


def retrieval_strategy(question) -> Column:
    """``document``, ``section`` or ``hybrid``."""
    tight = _tight(question)
    about_document = T.has_any(tight, P.DOCUMENT_QUERY_MARKERS)
    about_section = T.has_any(tight, P.SECTION_QUERY_MARKERS)
    return (
        F.when(T.has_any(tight, P.HYBRID_QUERY_MARKERS), "hybrid")
        .when(about_document & ~about_section, "document")
        .when(about_section & ~about_document, "section")
        .otherwise("hybrid")
    )


def is_catalog_count(question) -> Column:
    tight = _tight(F.replace(T.col(question), F.lit("？"), F.lit("?")))
    return T.has_any(tight, P.COUNT_QUERY_MARKERS) & T.has_any(tight, P.COUNT_SCOPE_MARKERS)


def asks_rule_count(question) -> Column:
    tight = _tight(question)
    return T.has_any(tight, ("规则", "规定")) & is_catalog_count(tight)


def needs_history(question) -> Column:
    """Follow-up that only makes sense with the turns before it."""
    text = F.lower(T.strip(question))
    opens = text.rlike(rf"\A(?:{T.alternatives(P.FOLLOWUP_PREFIXES)})")
    numbered = text.rlike(rf"{P.RULE_NO}|{P.ATTACHMENT_NO}|第\d+号")
    word = r"(?<![\p{L}\p{N}_])(?:" + "|".join(P.FOLLOWUP_WORDS) + r")(?![\p{L}\p{N}_])"
    refers = T.has_any(text, P.FOLLOWUP_TERMS) | text.rlike(word)
    return (text != "") & (opens | (~numbered & refers))


def plan_strategy(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in P.PLAN_STRATEGIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("summary-hybrid"))


def evidence_steps(kind: Column) -> Column:
    later = [F.when(kind.isin(*types), step) for step, types in P.EVIDENCE_STEPS.items()]
    return F.when(kind == "catalog", F.array(F.lit("catalog"))).otherwise(
        F.array_compact(F.array(F.lit("titles"), *later))
    )


def answer_rule(kind: Column) -> Column:
    return F.when(kind == "catalog", P.CATALOG_ANSWER_RULE).otherwise(P.EVIDENCE_ANSWER_RULE)


def resolve_scope(questions: DataFrame, title_hits: DataFrame) -> DataFrame:
    """Scope per question: (query_id, exact_scope_doc_ids, scoped_doc_ids).

    ``questions(query_id, question, question_type)``; ``title_hits(query_id, rank, doc_id,
    title, score)``.  A rule or attachment number that a title repeats fixes the scope;
    otherwise the first title does when it dominates the second.  All of it is one aggregate
    per question.
    """
    asked = questions.select(
        "query_id", "question_type",
        T.first_match("question", P.RULE_NO, 1).alias("q_rule"),
        T.first_match("question", P.ATTACHMENT_NO, 1).alias("q_attachment"),
    )
    hits = asked.join(title_hits.select("query_id", "rank", "doc_id", "title", "score"), "query_id", "left")
    same_rule = F.col("q_rule") == T.first_match("title", P.RULE_NO, 1)
    same_attachment = F.col("q_attachment") == T.first_match("title", P.ATTACHMENT_NO, 1)

    def first_where(condition: Column) -> Column:
        return F.min_by(F.when(condition, F.col("doc_id")), F.when(condition, F.col("rank")))

    grouped = hits.groupBy("query_id", "question_type").agg(
        F.coalesce(first_where(same_rule), first_where(same_attachment)).alias("exact"),
        first_where(F.col("rank") == 1).alias("top"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
    )
    dominant = (
        ~F.col("question_type").isin("comparison", "catalog")
        & (F.col("s1") >= SCOPE_MIN_SCORE)
        & (F.col("s1") >= F.coalesce("s2", F.lit(0.0)) + SCOPE_MIN_LEAD)
    )

    def listed(value: Column) -> Column:
        return F.array_compact(F.array(value))

    return grouped.select(
        "query_id",
        listed(F.col("exact")).alias("exact_scope_doc_ids"),
        listed(F.coalesce("exact", F.when(dominant, F.col("top")))).alias("scoped_doc_ids"),
    )


def _top_structs(hits: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Ordered hit list per question; the hits are already cut to a few per question."""
    item = F.struct("rank", *columns)
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias(name))


def plan_questions(questions: DataFrame, title_hits: DataFrame, summary_hits: DataFrame, scope: DataFrame) -> DataFrame:
    """Routing record per question: strategy, evidence plan, scoped queries, recommended paths."""
    titles = _top_structs(title_hits, ["doc_id", "title", "path", "score"], "title_hits")
    summaries = _top_structs(summary_hits, ["doc_id", "title", "path", "summary_short", "score"], "summary_hits")
    kind = F.col("question_type")
    record = (
        questions.join(titles, "query_id", "left").join(summaries, "query_id", "left").join(scope, "query_id", "left")
    )
    scoped = F.col("scoped_doc_ids")

    def in_scope(name: str) -> Column:
        kept = F.filter(name, lambda h: F.array_contains(scoped, h["doc_id"]))
        return F.when((F.size(scoped) > 0) & (F.size(kept) > 0), kept).otherwise(F.col(name))

    none = F.slice(F.array(F.lit("")), 1, 0)
    limit = F.when(F.size(scoped) > 0, 1).otherwise(2)

    def first(hits: Column, n: Column | int, value) -> Column:
        size = n if isinstance(n, Column) else F.lit(n)
        return F.coalesce(F.transform(F.slice(hits, F.lit(1), size), value), none)

    from_titles = first(in_scope("title_hits"), limit, lambda h: T.strip(h["title"]))
    from_summaries = first(
        in_scope("summary_hits"), limit,
        lambda h: F.when(
            (T.strip(h["title"]) != "") & (T.strip(h["summary_short"]) != ""),
            F.concat_ws(" ", T.strip(h["title"]), T.strip(h["summary_short"])),
        ).otherwise(""),
    )
    candidates = F.concat(F.array(F.col("question")), from_titles, from_summaries)
    paths = F.concat(
        first(in_scope("title_hits"), 2, lambda h: h["path"]), first(in_scope("summary_hits"), 2, lambda h: h["path"])
    )
    is_catalog = kind == "catalog"
    return record.select(
        "query_id", "question", "question_type",
        plan_strategy(kind).alias("retrieval_strategy"),
        F.struct(
            F.when(is_catalog, none).otherwise(F.coalesce(scoped, none)).alias("scope_doc_ids"),
            evidence_steps(kind).alias("steps"),
            answer_rule(kind).alias("answer_rule"),
        ).alias("evidence_plan"),
        F.when(~is_catalog, F.col("title_hits")).alias("title_hits"),
        F.when(~is_catalog, F.col("summary_hits")).alias("summary_hits"),
        F.when(is_catalog, none).otherwise(F.coalesce("exact_scope_doc_ids", none)).alias("exact_scope_doc_ids"),
        F.when(is_catalog, none).otherwise(F.coalesce(scoped, none)).alias("scoped_doc_ids"),
        F.when(is_catalog, F.array(F.col("question")))
        .otherwise(F.slice(T.distinct_by_norm(candidates), 1, MAX_SCOPED_QUERIES)).alias("scoped_queries"),
        F.when(is_catalog, F.array(F.lit(CATALOG_PATH))).otherwise(F.array_distinct(paths)).alias("recommended_paths"),
    )
