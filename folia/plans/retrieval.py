"""Vector retrieval with direct file name hits, over documents and sections.

Embeddings of questions, documents and sections are input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia import profiles as P
from folia.operators.evidence import evidence_hits, title_snippets
from folia.operators.filenames import filename_hits
from folia.operators.fusion import answer_hits, first_seen_hits, merge_hits, rerank, retrieval_history, synthesis_width
from folia.operators.routing import retrieval_strategy
from folia.operators.vectors import search_width, vector_top_k
from folia.sources.shared import stored

HIT_COLUMNS = ("path", "title", "text", "token_count", "source_kind", "section_heading")


def _search_index(
    questions: DataFrame, index: DataFrame, width: Column, max_width: int, keep: Column, threshold: float
) -> DataFrame:
    """Hits of one index: vector candidates and file name hits, merged, reranked, cut to ``keep``.

    ``index(row_id, embedding, path, …)``.  Texts are joined to the few winners only.
    """
    vectors = vector_top_k(
        questions.select("query_id", "embedding"), index, key="row_id", k=max_width, threshold=threshold
    )
    sized = vectors.join(questions.select("query_id", width.alias("w")), "query_id").filter(F.col("rank") <= F.col("w"))
    by_vector = sized.select("query_id", "row_id", F.col("rank").alias("ord"), F.col("score").alias("retrieval_score"))
    named = filename_hits(
        questions.select("query_id", "question"), index.select("row_id", "path"), order="row_id"
    ).select(
        "query_id", "row_id",
        F.lit(max_width) + F.row_number().over(Window.partitionBy("query_id").orderBy("path_rank", "row_id")),
        "retrieval_score",
    ).toDF("query_id", "row_id", "ord", "retrieval_score")
    # Stored, since Spark 4.1 takes a union of two tables dealt by question as dealt so itself, also where an adaptive read
    # of one side moves its rows; a window or a group over the union then sees a question in two pieces.
    hits = stored(by_vector.unionByName(named), "candidates").join(index.select("row_id", *HIT_COLUMNS), "row_id").drop("row_id")
    ranked = rerank(merge_hits(hits), questions)
    limits = questions.select("query_id", keep.alias("keep"))
    return ranked.join(limits, "query_id").filter(F.col("rank") <= F.col("keep")).drop("keep", "ord")


def retrieve(
    questions: DataFrame,
    documents: DataFrame,
    sections: DataFrame,
    *,
    k: int = P.REGULATORY_ZH.top_k,
    threshold: float = P.REGULATORY_ZH.similarity_threshold,
) -> DataFrame:
    """Reranked hits per question by its strategy.

    ``questions(query_id, question, embedding)``.  document: the documents alone; section:
    sections plus the best document; hybrid: three documents plus six sections.  A question
    without section hits falls back to its first k documents.
    """
    asked = questions.withColumn("strategy", retrieval_strategy("question"))
    is_section = F.col("strategy") == "section"
    doc_k, section_k = max(4, k), max(6, 2 * k)
    # Both are read several times below.
    docs = stored(_search_index(
        asked, documents,
        F.when(is_section, search_width(2)).otherwise(search_width(doc_k)), search_width(doc_k),
        F.when(is_section, 2).otherwise(doc_k), threshold,
    ), "document_hits")
    with_sections = asked.filter(F.col("strategy") != "document")
    secs = stored(_search_index(
        with_sections, sections, F.lit(search_width(section_k)), search_width(section_k), F.lit(section_k), threshold
    ), "section_hits")
    strategy = asked.select("query_id", "strategy")
    found = secs.select("query_id").distinct().withColumn("has_sections", F.lit(True))
    sided = docs.join(strategy, "query_id").join(found, "query_id", "left")
    alone = sided.filter(F.col("has_sections").isNull())
    doc_only = alone.filter((F.col("strategy") == "document") | (F.col("rank") <= k)).drop("strategy", "has_sections")
    mixed_docs = sided.filter(F.col("has_sections")).filter(F.col("rank") <= F.when(is_section, 1).otherwise(3))
    mixed_secs = secs.join(strategy, "query_id").filter(is_section | (F.col("rank") <= 6))
    side = Window.partitionBy("query_id").orderBy("side", "rank")
    plain = ("query_id", "rank", "retrieval_score", *HIT_COLUMNS)
    sides = mixed_docs.select(*plain, F.lit(0).alias("side")).unionByName(mixed_secs.select(*plain, F.lit(1).alias("side")))
    combined = stored(sides, "sides").withColumn("ord", F.row_number().over(side)).drop("side", "rank")
    merged = rerank(merge_hits(combined), questions)
    top = F.when(is_section, section_k).otherwise(max(8, 2 * k))
    both = merged.join(strategy, "query_id").filter(F.col("rank") <= top).drop("strategy", "ord")
    return doc_only.select(*both.columns).unionByName(both)


def context_for(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Standard answering without the model: retrieved hits cut to the context budget."""
    return answer_hits(hits.withColumn("ord", F.col("rank")).drop("rank", "rerank_score", "domain_terms_matched"), questions)


def combined_context(
    plans: DataFrame, evidence: DataFrame, scoped_hits: DataFrame, documents: DataFrame, *, k: int = P.REGULATORY_ZH.top_k
) -> DataFrame:
    """Answer context of planned questions: title snippets, structured evidence and vector hits.

    ``scoped_hits(query_id, query_ord, rank, path, …)`` are the retrieval hits of every scoped
    query of a question.
    """
    columns = ("query_id", "source_rank", "within", "retrieval_score", *HIT_COLUMNS)
    snippets = title_snippets(plans, documents).select(
        "query_id", F.lit(0).alias("source_rank"), F.col("ord").alias("within"), "retrieval_score", *HIT_COLUMNS
    )
    structured = evidence_hits(evidence, limit=max(6, 2 * k)).select(
        "query_id", F.lit(1).alias("source_rank"), F.col("ord").alias("within"), "retrieval_score",
        "path", "title", "text", F.lit(None).cast("int").alias("token_count"), "source_kind", "section_heading",
    )
    vector = scoped_hits.select(
        "query_id", (F.col("query_ord") + 2).alias("source_rank"), F.col("rank").alias("within"), "retrieval_score",
        *HIT_COLUMNS,
    )
    order = Window.partitionBy("query_id").orderBy("source_rank", "within")
    every = snippets.select(*columns).unionByName(structured.select(*columns)).unionByName(vector.select(*columns))
    hits = merge_hits(every.withColumn("ord", F.row_number().over(order)).drop("source_rank", "within"))
    return answer_hits(hits, plans.select("query_id", "question"))


def multi_query(
    questions: DataFrame, sub_queries: DataFrame, hits: DataFrame, *, top_k: int = P.REGULATORY_ZH.top_k
) -> tuple[DataFrame, DataFrame]:
    """(final hits, history) of questions asked through several sub-queries.

    ``hits(question_id, query_ord, rank, path, text, retrieval_score, …)``.
    """
    first = first_seen_hits(hits)
    history = retrieval_history(sub_queries, first)
    order = Window.partitionBy("question_id").orderBy("query_ord", "rank")
    pooled = first.withColumn("ord", F.row_number().over(order)).drop("rank").withColumnRenamed("question_id", "query_id")
    return rerank(pooled, questions, top_k=synthesis_width(top_k)), history
