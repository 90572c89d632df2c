"""Merging, reranking and budgeting of retrieval hits.

A hit table has ``query_id, ord, path, text, retrieval_score`` and any further columns;
``ord`` is the position in the candidate list of its question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions import text as T
from folia.sources.shared import stored

# --- Fixed values: rerank weights --------------------------------------------------------
LEXICAL_WEIGHT, PATH_WEIGHT, DOMAIN_WEIGHT, PHRASE_WEIGHT, SEMANTIC_WEIGHT = 0.35, 0.15, 0.20, 0.10, 0.10
QUESTION_TERMS = 8


def merge_hits(hits: DataFrame, keys: tuple[str, ...] = ("query_id", "path", "text")) -> DataFrame:
    """One row per (question, path, text): the first row, with the highest score of its copies."""
    rest = [c for c in hits.columns if c not in (*keys, "ord", "retrieval_score")]
    first = F.min_by(F.struct("ord", *rest), "ord").alias("first")
    merged = hits.groupBy(*keys).agg(first, F.max("retrieval_score").alias("retrieval_score"))
    return merged.select(*keys, "first.ord", "retrieval_score", *[f"first.{c}" for c in rest])


# --- domain context ----------------------------------------------------------------------
def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def domain_context(questions: DataFrame) -> DataFrame:
    """Add planner hint, reflector hint and the ordered priority terms of each question."""
    terms = T.content_terms("question")
    none = F.slice(_literals([""]), 1, 0)
    hit = [F.arrays_overlap(terms, _literals(r["keywords"])) for r in P.DOMAIN_RULES]

    def hint(name: str, default: str) -> Column:
        shown = F.concat_ws(" ", *[F.when(h, r[name]) for h, r in zip(hit, P.DOMAIN_RULES)])
        return F.coalesce(T.blank_to_null(shown), F.lit(default))

    chosen = [F.when(h, _literals(r["priority_terms"])).otherwise(none) for h, r in zip(hit, P.DOMAIN_RULES)]
    return (
        questions.withColumn("planner_hint", hint("planner_hint", P.DEFAULT_PLANNER_HINT))
        .withColumn("reflector_hint", hint("reflector_hint", P.DEFAULT_REFLECTOR_HINT))
        .withColumn("priority_terms", F.array_distinct(F.concat(*chosen, F.slice(terms, 1, QUESTION_TERMS))))
    )


# --- rerank ------------------------------------------------------------------------------
def rerank(hits: DataFrame, questions: DataFrame, top_k: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Add rerank_score, matched terms and rank; a question with one hit keeps a NULL score.

    What compares words is reduced to numbers first; the windows over the hits of a question then carry no term
    lists.  Min and max of the retrieval score are window aggregates.
    """
    asked = domain_context(questions.select("query_id", "question")).select(
        "query_id", F.lower("question").alias("q_lower"),
        T.distinct_terms("question").alias("q_terms"), "priority_terms",
    )
    group = Window.partitionBy(*by)
    joined = F.concat_ws(" ", "path", "text")

    def share(wanted: str, have: str) -> Column:
        found = F.size(F.array_intersect(F.col(wanted), F.col(have)))
        return found / F.greatest(F.lit(1), F.size(wanted))

    phrase = F.when(F.contains(F.lower(joined), F.col("q_lower")), 1.0).otherwise(0.0)
    words = (
        F.col("retrieval_score")
        + LEXICAL_WEIGHT * share("q_terms", "doc_terms")
        + PATH_WEIGHT * share("q_terms", "path_terms")
        + DOMAIN_WEIGHT * share("priority_terms", "doc_terms")
        + PHRASE_WEIGHT * phrase
    )
    rows = (
        hits.join(asked, "query_id")
        .withColumn("doc_terms", T.distinct_terms(joined))
        .withColumn("path_terms", T.distinct_terms(F.replace("path", F.lit("/"), F.lit(" "))))
        .withColumn("word_score", words)
        .withColumn("matched", F.array_sort(F.array_intersect("priority_terms", "doc_terms")))
        .drop("q_lower", "q_terms", "priority_terms", "doc_terms", "path_terms")
        .withColumn("low", F.min("retrieval_score").over(group))
        .withColumn("high", F.max("retrieval_score").over(group))
        .withColumn("n_hits", F.count("*").over(group))
    )
    spread = (F.col("retrieval_score") - F.col("low")) / (F.col("high") - F.col("low"))
    semantic = F.when(F.col("high") == F.col("low"), 1.0).otherwise(spread)
    many = F.col("n_hits") > 1
    scored = (
        rows.withColumn("rerank_score", F.when(many, F.col("word_score") + SEMANTIC_WEIGHT * semantic))
        .withColumn("domain_terms_matched", F.when(many, F.col("matched")))
        .drop("word_score", "matched", "low", "high", "n_hits")
    )
    order = group.orderBy(F.desc_nulls_last("rerank_score"), F.desc("retrieval_score"), F.asc("ord"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


# --- context budget ----------------------------------------------------------------------
def hit_tokens() -> Column:
    stored = F.when(F.col("token_count") > 0, F.col("token_count"))
    return F.coalesce(stored, T.token_count("text"))


def within_budget(
    hits: DataFrame, budget: Column, *, max_hits: Column | None = None, by: tuple[str, ...] = ("query_id",), rank: str = "rank"
) -> DataFrame:
    """Greedy selection in rank order: a hit that does not fit is skipped, the first always fits.

    A running sum cannot express the skip, so the ranks and token counts of a group are folded.
    Once a hit of n tokens is skipped every later hit of n tokens is skipped too, so at most
    budget/n + 1 hits per size can be selected; the others are removed before the fold, which
    bounds the folded list by the budget and not by the number of hits.
    """
    size = "n_tokens"
    cap = F.lit(None) if max_hits is None else max_hits
    # Texts stay behind: only ranks and counts take part in the selection.
    slim = hits.select(
        *by, rank, hit_tokens().cast("long").alias(size), budget.cast("long").alias("_budget"),
        F.coalesce(cap.cast("int"), F.lit(2**31 - 1)).alias("_cap"),
    )
    most = F.col("_budget") / F.greatest(F.col(size), F.lit(1)) + 1

    turn = F.row_number().over(Window.partitionBy(*by, size).orderBy(rank))
    possible = slim.withColumn("_turn", turn).filter(F.col("_turn") <= most)
    item = F.struct(F.col(rank).alias("rank"), F.col(size).alias("n"))
    listed = possible.groupBy(*by).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.first("_budget").alias("b"), F.first("_cap").alias("cap")
    )
    start = F.struct(
        F.lit(0).cast("long").alias("total"), F.lit(False).alias("done"), F.array().cast("array<int>").alias("picked")
    )

    def step(state: Column, x: Column) -> Column:
        fits = ~state["done"] & ((F.size(state["picked"]) == 0) | (state["total"] + x["n"] <= F.col("b")))
        total = F.when(fits, state["total"] + x["n"]).otherwise(state["total"])
        picked = F.when(fits, F.concat(state["picked"], F.array(x["rank"]))).otherwise(state["picked"])
        done = state["done"] | (fits & ((total >= F.col("b")) | (F.size(picked) >= F.col("cap"))))
        return F.struct(total.alias("total"), done.alias("done"), picked.alias("picked"))

    chosen = listed.select(*by, F.explode(F.aggregate("items", start, step)["picked"]).alias(rank))
    return hits.join(chosen, [*by, rank], "left_semi")


def answer_hits(
    hits: DataFrame,
    questions: DataFrame,
    *,
    doc_tokens: int = P.REGULATORY_ZH.doc_context_tokens,
    section_tokens: int = P.REGULATORY_ZH.section_context_tokens,
) -> DataFrame:
    """Context of an answer: reranked documents and sections within their token budgets.

    With both kinds present three documents and six sections at most are kept and ranked
    together; with one kind its own order stands.
    """
    is_section = F.coalesce(F.col("source_kind") == "section", F.lit(False))
    split = hits.withColumn("is_section", is_section)
    both = split.withColumn("mixed", F.size(F.collect_set("is_section").over(Window.partitionBy("query_id"))) > 1)
    side = ("query_id", "is_section")
    # Stored, since the budget reads it twice: once slim for the choice, once for the chosen rows.
    ordered = stored(rerank(both, questions, by=side).drop("domain_terms_matched"), "ordered")
    budget = F.when(F.col("is_section"), section_tokens).otherwise(doc_tokens)
    cap = F.when(F.col("mixed"), F.when(F.col("is_section"), 6).otherwise(3))
    kept = within_budget(ordered, budget, max_hits=cap, by=side)
    # The joint ranking is computed for every question in one pass and used by the mixed ones.
    sided = kept.withColumnsRenamed({"rank": "side_rank", "rerank_score": "side_score"}).withColumn(
        "ord", F.row_number().over(Window.partitionBy("query_id").orderBy("is_section", "side_rank"))
    )
    joint = rerank(sided, questions).drop("domain_terms_matched")
    return (
        joint.withColumn("rank", F.when(F.col("mixed"), F.col("rank")).otherwise(F.col("side_rank")))
        .withColumn("rerank_score", F.when(F.col("mixed"), F.col("rerank_score")).otherwise(F.col("side_score")))
        .drop("mixed", "is_section", "side_rank", "side_score")
    )


# --- rendering ---------------------------------------------------------------------------
def source_heading() -> Column:
    section = (F.col("source_kind") == "section") & (F.col("section_heading") != "")
    return F.when(section, F.concat_ws(" | ", "path", "section_heading")).otherwise(F.col("path"))


def render_context(hits: DataFrame) -> DataFrame:
    """Numbered context per question in rank order."""
    in_section = F.coalesce(F.col("source_kind") == "section", F.lit(False))
    header = F.when(
        in_section, F.concat(F.col("path"), F.lit(" | "), F.coalesce("section_heading", F.lit("Section")))
    ).otherwise(F.col("path"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("header"), F.lit("\n"), F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct("n", block.alias("block"))))
    return (
        hits.select("query_id", position.alias("n"), header.alias("header"), "text")
        .groupBy("query_id")
        .agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"))
    )


def source_list(hits: DataFrame, base_url: str) -> DataFrame:
    """Numbered sources per question: path, address, snippet, kind and heading."""
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("index", position).filter(T.strip("path") != "").select(
        "query_id", "index", T.strip("path").alias("path"), T.blob_url(T.strip("path"), base_url).alias("url"),
        T.snippet("text").alias("snippet"), "source_kind", "section_heading", source_heading().alias("heading"),
    )


# --- several queries per question --------------------------------------------------------
def normalize_queries(values: Column, limit: int = 4) -> Column:
    """Trimmed sub-queries, distinct ignoring case, first ``limit``."""
    clean = F.transform(values, lambda v: T.strip(F.btrim(T.strip(v), F.lit("-"))))
    return F.slice(T.distinct_by_norm(clean, F.lower), 1, limit)


def synthesis_width(top_k: int) -> int:
    return max(top_k, min(10, 2 * top_k))


def first_seen_hits(hits: DataFrame) -> DataFrame:
    """Hits of a question over its sub-queries; a (path, text) counts for the query that found it first.

    ``hits(question_id, query_ord, rank, path, text, …)``.
    """
    rest = [c for c in hits.columns if c not in ("question_id", "path", "text")]
    first = F.min_by(F.struct(*rest), F.struct("query_ord", "rank")).alias("first")
    return hits.groupBy("question_id", "path", "text").agg(first).select(
        "question_id", "path", "text", *[f"first.{c}" for c in rest]
    )


def retrieval_history(sub_queries: DataFrame, first_hits: DataFrame) -> DataFrame:
    """New hits and their paths per executed sub-query, zero when a query found nothing new."""
    paths = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"])
    counts = first_hits.groupBy("question_id", "query_ord").agg(F.count("*").alias("new_hits"), paths.alias("paths"))
    none = F.slice(F.array(F.lit("")), 1, 0)
    return sub_queries.join(counts, ["question_id", "query_ord"], "left").select(
        "question_id", "query_ord", "query",
        F.coalesce("new_hits", F.lit(0)).alias("new_hits"), F.coalesce("paths", none).alias("paths"),
    )
