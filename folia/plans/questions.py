"""Deterministic answering of a question table over ready data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.operators import evidence as E
from folia.operators import graph as G
from folia.operators import lexical as L
from folia.operators import routing as R
from folia.operators.titles import resolve_documents, search_titles
from folia.sources.shared import stored


def plan(questions: DataFrame, tables: dict[str, DataFrame], *, limit: int = 5) -> DataFrame:
    """Routing record per question (see ``routing.plan_questions``)."""
    typed = questions.withColumn("question_type", R.question_type("question"))
    searchable = typed.filter(F.col("question_type") != "catalog")
    # Title hits and scope feed several later searches; a few rows per question are stored once.
    title_hits = stored(search_titles(searchable, tables["doc_catalog"], limit=limit), "title_hits")
    scope = stored(R.resolve_scope(typed, title_hits), "scope")
    # Summaries are searched inside the scope, else inside the title hits, else everywhere.
    scoped = scope.select("query_id", F.explode("scoped_doc_ids").alias("doc_id"))
    by_title = title_hits.select("query_id", "doc_id").join(
        scoped.select("query_id").distinct(), "query_id", "left_anti"
    )
    summary_hits = L.search_summaries(
        searchable.select("query_id", "question"), tables["doc_summaries"], tables["doc_catalog"],
        limit=limit, scope=scoped.unionByName(by_title),
    )
    return stored(R.plan_questions(typed, title_hits, summary_hits, scope), "plans")


def collect_evidence(plans: DataFrame, tables: dict[str, DataFrame], *, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(evidence, relations) of planned questions; catalog questions have none of either.

    An edge between two scoped documents is listed once.
    """
    asked = plans.filter(F.col("question_type") != "catalog").select("query_id", "question", "question_type")
    scope = E.evidence_scope(plans)
    plain = asked.select("query_id", "question")
    summaries = L.search_summaries(
        plain, tables["doc_summaries"], tables["doc_catalog"], limit=limit, scope=scope
    )
    sections = L.search_sections(plain, tables["sections_structured"], limit=limit, scope=scope)
    formulas = L.search_formulas(
        asked.filter(E.wants_formulas()).select("query_id", "question"), tables["formula_cards"], limit=limit, scope=scope
    )
    evidence = (
        E.summary_evidence(summaries)
        .unionByName(E.section_evidence(sections))
        .unionByName(E.formula_evidence(formulas))
    )
    related = asked.filter(E.wants_relations()).select("query_id", "question")
    unscoped = related.join(scope.select("query_id").distinct(), "query_id", "left_anti")
    resolved = resolve_documents(unscoped, tables["doc_catalog"]).select("query_id", "doc_id")
    inside = scope.join(related.select("query_id"), "query_id", "left_semi")
    edges = G.trace_in_scope_order(tables["relation_edges"], inside, limit=limit).unionByName(
        G.trace_relations(tables["relation_edges"], resolved, limit=limit)
    )
    return stored(evidence, "evidence"), stored(edges, "relations")


def answer(plans: DataFrame, tables: dict[str, DataFrame], manifest: DataFrame, *, limit: int = 5) -> DataFrame:
    """Verified answer per planned question, with the source it cites."""
    evidence, _ = collect_evidence(plans, tables, limit=limit)
    wanted = evidence.filter((F.col("kind") == "formula") & (F.col("rank") == 1)).select(F.col("id").alias("formula_id"))
    explained = G.explain_formulas(G.find_formula(tables["formula_cards"], wanted), tables["sections_structured"])
    facts = E.catalog_evidence(manifest).select(F.col("text").alias("catalog_text"))
    return E.verified_answers(
        plans.select("query_id", "question", "question_type"), evidence, explained, facts
    )


def eval_candidates(plans: DataFrame, evidence: DataFrame, relations: DataFrame) -> DataFrame:
    """(case_id, ord, doc_id): titles first, then the evidence documents, then edge ends."""
    titles = plans.select("query_id", F.posexplode("title_hits").alias("ord", "h")).select(
        "query_id", "ord", F.col("h.doc_id").alias("doc_id")
    )
    catalog = plans.filter(F.col("question_type") == "catalog").select(
        "query_id", F.lit(0).alias("ord"), F.lit(E.CATALOG_DOC_ID).alias("doc_id")
    )
    found = evidence.select("query_id", (F.col("rank") + 100).alias("ord"), "doc_id")
    ends = relations.select("query_id", F.explode(F.array("source", "target")).alias("doc_id")).select(
        "query_id", F.lit(1000).alias("ord"), "doc_id"
    )
    every = titles.unionByName(catalog).unionByName(found).unionByName(ends)
    return every.withColumnRenamed("query_id", "case_id")


