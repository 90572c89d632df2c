"""Catalog, aliases and summaries of a document table.

Everything up to the related documents is a column expression on the document row, so a
catalog build reads the corpus once and shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions import text as T
from folia.functions.frontmatter import front_matter_title, front_matter_value, strip_front_matter
from folia.functions.markup import FENCED_REGION
from folia.operators.cleaning import folder_category

Profile = P.Profile


def with_body(documents: DataFrame, profile: Profile = P.REGULATORY_ZH) -> DataFrame:
    """``documents(path, text)`` to doc_id, path, title, category, header values and body."""
    doc_id = F.col("path")
    return documents.select(
        doc_id.alias("doc_id"),
        F.concat(F.lit(profile.doc_prefix), doc_id).alias("path"),
        F.coalesce(T.blank_to_null(front_matter_title("text")), T.path_stem(doc_id)).alias("title"),
        folder_category(doc_id).alias("category"),
        front_matter_value("text", "source_type").alias("source_type"),
        front_matter_value("text", "publish_date").alias("publish_date"),
        T.strip(strip_front_matter("text")).alias("body"),
    )


def intro_paragraphs(body, cap: int = P.REGULATORY_ZH.paragraph_cap, *, headings_split: bool = True) -> Column:
    """First paragraphs outside fences, tables and headings, each on one line."""
    unified = F.array_join(T.lines(body), "\n")
    outside = F.regexp_replace(unified, FENCED_REGION, "")
    stripped = F.transform(F.split(outside, "\n"), T.strip)
    if not headings_split:
        stripped = F.filter(stripped, lambda line: ~line.startswith("#"))
    breaks = "[|#]" if headings_split else "[|]"
    kept = F.transform(stripped, lambda line: F.when(line.rlike(rf"\A{breaks}"), "").otherwise(line))
    blocks = F.transform(
        F.split(F.array_join(kept, "\n"), "\n\n+"), lambda b: F.replace(F.btrim(b, F.lit("\n")), F.lit("\n"), F.lit(" "))
    )
    return F.slice(F.filter(blocks, lambda b: b != ""), 1, cap)


def is_summary_noise(title_norm: Column, paragraph: Column) -> Column:
    p = T.strip(paragraph)
    form = T.norm_text(p)
    noise = (
        (form == "")
        | (form == title_norm)
        | p.rlike(rf"\A{P.ATTACHMENT_NO}\z")
        | (F.length(p) < 8)
        | p.rlike(P.IMAGE_ONLY)
        | p.rlike(P.LINK_ONLY)
        | p.rlike(P.DOC_NUMBER_ONLY)
        | p.rlike(P.RECIPIENT_LINE)
    )
    return noise | p.rlike(rf"\A(?:{'|'.join(P.SUMMARY_METADATA_LABELS)})[：:]")


def summary_candidates(title: Column, paragraphs: Column) -> Column:
    form = T.norm_text(title)
    return F.filter(paragraphs, lambda p: ~is_summary_noise(form, p))


def summary_short(title: Column, candidates: Column, paragraphs: Column, limit: int) -> Column:
    first = F.coalesce(F.try_element_at(candidates, F.lit(1)), F.try_element_at(paragraphs, F.lit(1)))
    return F.coalesce(T.truncate(first, limit), title)


def summary_structured(title: Column, headings: Column, chosen: Column, part_chars: int) -> Column:
    parts = F.transform(F.slice(chosen, 1, 2), lambda p: T.truncate(p, part_chars))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("标题："), title),
        F.when(F.size(headings) > 0, F.concat(F.lit("重点章节："), F.array_join(F.slice(headings, 1, 4), "；"))),
        F.when(F.size(chosen) > 0, F.concat(F.lit("内容摘要："), F.array_join(parts, " "))),
    )


def focus_points(headings: Column, keywords: Column, cap: int) -> Column:
    stop = F.array(*[F.lit(w) for w in P.FOCUS_STOPWORDS])
    kept = F.filter(F.concat(headings, keywords), lambda v: ~F.array_contains(stop, v))
    return F.slice(F.array_distinct(kept), 1, cap)


def alias_records(title: Column, category: Column, path: Column) -> Column:
    """``array<struct<alias, alias_type>>``, distinct by matching form, in a fixed order."""

    def record(alias: Column, kind: str) -> Column:
        return F.when(alias.isNotNull(), F.struct(alias.alias("alias"), F.lit(kind).alias("alias_type")))

    def numbered(number: Column, template: str) -> Column:
        head, tail = template.split("{}")
        return F.concat(F.lit(head), number, F.lit(tail))

    rule = T.first_match(title, P.RULE_NO, 1)
    attachment = T.first_match(title, P.ATTACHMENT_NO, 1)
    topic = T.first_match(title, P.NOTICE_TOPIC, 1)
    hints = F.create_map(*[F.lit(x) for pair in P.CATEGORY_HINTS.items() for x in pair])
    records = F.array(
        record(title, "title"),
        record(T.path_stem(path), "stem"),
        record(numbered(rule, "规则第{}号"), "rule_number"),
        record(numbered(rule, "第{}号规则"), "rule_number"),
        record(numbered(rule, "偿付能力监管规则第{}号"), "rule_number"),
        record(numbered(rule, "偿二代规则第{}号"), "rule_number"),
        record(numbered(attachment, "附件{}"), "attachment_number"),
        record(numbered(attachment, "附件 {}"), "attachment_number"),
        record(topic, "notice_topic"),
        record(numbered(topic, "关于{}的通知"), "notice_title"),
        record(F.try_element_at(hints, category), "category_hint"),
    )
    return T.distinct_by_norm(F.array_compact(records), lambda r: T.norm_text(r["alias"]))


def build_documents(documents: DataFrame, profile: Profile = P.REGULATORY_ZH) -> DataFrame:
    """One row per document with every catalog and summary column, still carrying the body."""
    base = with_body(documents, profile)
    parts = base.select(
        "*",
        T.headings("body", profile.heading_cap).alias("headings"),
        intro_paragraphs("body", profile.paragraph_cap).alias("paragraphs"),
        alias_records(F.col("title"), F.col("category"), F.col("doc_id")).alias("alias_records"),
    )
    picked = parts.withColumn("candidates", summary_candidates(F.col("title"), F.col("paragraphs"))).withColumn(
        "chosen", F.when(F.size("candidates") > 0, F.col("candidates")).otherwise(F.col("paragraphs"))
    )
    aliases = F.transform("alias_records", lambda r: r["alias"])
    keyed = picked.withColumn("aliases", aliases).withColumn(
        "keywords",
        T.keyword_tokens(
            [F.col("title"), F.col("headings"), F.col("aliases"), F.slice("chosen", 1, 2)], profile.keyword_cap
        ),
    )
    return keyed.select(
        "doc_id", "path", "title", "category", "source_type", "publish_date", "aliases",
        summary_short(F.col("title"), F.col("candidates"), F.col("paragraphs"), profile.summary_chars).alias(
            "summary_short"
        ),
        summary_structured(F.col("title"), F.col("headings"), F.col("chosen"), profile.summary_part_chars).alias(
            "summary_structured"
        ),
        "headings", "keywords",
        focus_points(F.col("headings"), F.col("keywords"), profile.focus_cap).alias("focus_points"),
        "alias_records", "body",
    )


def catalog_table(built: DataFrame) -> DataFrame:
    return built.drop("focus_points", "alias_records", "body")


def alias_table(built: DataFrame) -> DataFrame:
    """One row per alias.

    The outer form keeps the optimiser from pushing a test of the array below the title, where every use of the title
    would derive the whole document again; rows without an alias are dropped after it.
    """
    records = built.select("doc_id", "title", "category", F.explode_outer("alias_records").alias("r"))
    return records.filter(F.col("r").isNotNull()).select(
        F.col("r.alias").alias("alias"),
        T.norm_text("r.alias").alias("normalized_alias"),
        "doc_id", "title", "category",
        F.col("r.alias_type").alias("alias_type"),
    )


def summary_table(built: DataFrame, related: DataFrame) -> DataFrame:
    """Summaries with their related documents, empty list when a document has none."""
    none = F.slice(F.array(F.lit("")), 1, 0)
    return built.join(related, "doc_id", "left").select(
        "doc_id", "title", "category", "summary_short", "summary_structured", "focus_points",
        F.coalesce("related_doc_ids", none).alias("related_doc_ids"),
    )


def related_documents(edges: DataFrame) -> DataFrame:
    """Distinct edge targets per source in first-seen order.

    ``edges(source, target, edge_ord)``.  The first aggregate runs map-side and leaves one row
    per (source, target), so a source with very many edges is reduced before its list is built.
    """
    firsts = edges.groupBy("source", "target").agg(F.min("edge_ord").alias("first_ord"))
    ordered = F.array_sort(F.collect_list(F.struct("first_ord", "target")))
    return firsts.groupBy("source").agg(F.transform(ordered, lambda s: s["target"]).alias("related_doc_ids")).select(
        F.col("source").alias("doc_id"), "related_doc_ids"
    )


def fallback_catalog(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """Catalog derived from manifest entries and their Markdown when no built one exists."""
    profile = P.FALLBACK_CATALOG
    doc_id = F.replace(T.strip("path"), F.lit("\\"), F.lit("/"))
    bodies = documents.select(F.col("path").alias("doc_id"), strip_front_matter("text").alias("body"))

    def filled(name: str, default: Column) -> Column:
        return F.coalesce(T.blank_to_null(T.strip(name)), default).alias(name)

    base = manifest.select(
        doc_id.alias("doc_id"),
        filled("title", T.path_stem(doc_id)),
        filled("category", F.substring_index(F.substring_index(doc_id, "/", -2), "/", 1)),
        filled("source_type", F.lit("")),
        filled("publish_date", F.lit("")),
    ).join(bodies, "doc_id", "left")
    body = F.coalesce("body", F.lit(""))
    parts = base.select(
        "doc_id", "title", "category", "source_type", "publish_date",
        T.headings(body, profile.heading_cap).alias("headings"),
        intro_paragraphs(body, profile.paragraph_cap, headings_split=False).alias("paragraphs"),
        F.transform(alias_records(F.col("title"), F.col("category"), F.col("doc_id")), lambda r: r["alias"]).alias(
            "aliases"
        ),
    )
    paragraphs, headings = F.col("paragraphs"), F.col("headings")
    return parts.select(
        "doc_id",
        F.concat(F.lit(profile.doc_prefix), F.col("doc_id")).alias("path"),
        "title", "category", "source_type", "publish_date", "aliases",
        summary_short(F.col("title"), paragraphs, paragraphs, profile.summary_chars).alias("summary_short"),
        summary_structured(F.col("title"), headings, paragraphs, profile.summary_part_chars).alias(
            "summary_structured"
        ),
        "headings",
        T.keyword_tokens([F.col("title"), headings, F.col("aliases")], profile.keyword_cap).alias("keywords"),
    )
