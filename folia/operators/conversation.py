"""Conversations and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import text as T
from folia.functions.markup import repair_latex_artifacts

# --- Fixed values: history bounds and citation forms -------------------------------------
MAX_HISTORY_MESSAGES = 12
MAX_HISTORY_CHARS = 12_000
CITATION = r"(?<!\[)\[(\d+)\](?!\()"
CODE_FENCE = r"```[\s\S]*?```"
RENDERED_MATH = r"\$\$[\s\S]+?\$\$|\\\[[\s\S]+?\\\]|(?<!\\)\$[^$\n]+?(?<!\\)\$|\\\([^\n]+?\\\)"


def question_and_history(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) conversations.

    ``messages(conv_id, turn, role, text)``.  Only non-empty user and assistant turns count.  A
    conversation whose last such turn is not the user's is rejected.  Accepted rows carry the
    question and the last twelve earlier turns, cut to the last 12,000 characters.  The rank
    filter keeps thirteen turns per conversation before any list is built, so a conversation
    of any length stays small.
    """
    said = messages.withColumn("text", T.strip("text")).filter(
        F.col("role").isin("user", "assistant") & (F.col("text") != "")
    )
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = said.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= MAX_HISTORY_MESSAGES + 1)
    earlier = F.array_sort(F.collect_list(F.when(F.col("back") > 1, F.struct("turn", "role", "text"))))
    per_conv = recent.groupBy("conv_id").agg(
        F.max(F.when(F.col("back") == 1, F.col("role"))).alias("last_role"),
        F.max(F.when(F.col("back") == 1, F.col("text"))).alias("question"),
        earlier.alias("earlier"),
    )
    blocks = F.transform(
        "earlier",
        lambda m, i: F.concat(
            F.lit("Turn "), (i + 1).cast("string"), F.lit("\nRole: "), m["role"], F.lit("\nText: "), m["text"]
        ),
    )
    rendered = F.array_join(blocks, "\n\n")
    accepted = per_conv.filter(F.col("last_role") == "user").select(
        "conv_id", "question", F.right(rendered, F.lit(MAX_HISTORY_CHARS)).alias("history")
    )
    kept = accepted.select("conv_id")
    rejected = messages.select("conv_id").distinct().join(kept, "conv_id", "left_anti")
    return accepted, rejected


def citation_numbers(answer) -> Column:
    """Cited numbers outside math, in order of first use; math inside code fences is no math."""
    outside = T.rewrite_outside(T.col(answer), CODE_FENCE, lambda part: F.regexp_replace(part, RENDERED_MATH, " "))
    return F.array_distinct(F.regexp_extract_all(outside, F.lit(CITATION), F.lit(1)))


def link_citations(answer, links: Column) -> Column:
    """``[n]`` becomes ``[n](url)`` outside math; unknown numbers stay; math is repaired.

    ``links`` is ``map<string,string>`` from number to address.
    """

    def link(match: Column) -> Column:
        url = F.try_element_at(links, F.regexp_extract(match, r"(\d+)", 1))
        return F.when(F.coalesce(url, F.lit("")) != "", F.concat(match, F.lit("("), url, F.lit(")"))).otherwise(match)

    def prose(part: Column) -> Column:
        return T.replace_matches(part, CITATION, link)

    def outside_code(part: Column) -> Column:
        return T.rewrite_pieces(part, RENDERED_MATH, prose, repair_latex_artifacts)

    # Citations inside code fences are linked as well; only math is protected.
    linked = T.rewrite_pieces(T.col(answer), CODE_FENCE, outside_code, prose)
    return F.when(T.strip(answer) == "", T.col(answer)).otherwise(linked)


def citation_audit(answers: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """Citations that no source of the answer backs: (key, index)."""
    cited = answers.select(key, F.explode(F.transform(citation_numbers("answer"), lambda n: n.cast("int"))).alias("index"))
    return cited.join(sources.select(key, F.col("index").cast("int").alias("index")), [key, "index"], "left_anti")
