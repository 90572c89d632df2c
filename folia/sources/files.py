"""File sources: Markdown, HTML, JSON lines, graph and manifest files, file inventory."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from folia.functions.text import col, path_stem, strip

CATALOG_SCHEMA = (
    "doc_id string, path string, title string, category string, source_type string, publish_date string, "
    "aliases array<string>, summary_short string, summary_structured string, headings array<string>, "
    "keywords array<string>"
)
ALIAS_SCHEMA = (
    "alias string, normalized_alias string, doc_id string, title string, category string, alias_type string"
)
SUMMARY_SCHEMA = (
    "doc_id string, title string, category string, summary_short string, summary_structured string, "
    "focus_points array<string>, related_doc_ids array<string>"
)
SECTION_SCHEMA = (
    "section_id string, doc_id string, path string, title string, heading_path array<string>, "
    "section_heading string, article_no string, clause_no string, section_kind string, content_type string, "
    "text string, token_count int, has_formula boolean, has_table boolean, mentions_rules array<string>, "
    "mentions_attachments array<string>, keywords array<string>"
)
FORMULA_SCHEMA = (
    "formula_id string, doc_id string, title string, path string, article_no string, section_heading string, "
    "formula_text string, variables array<string>, variable_hints array<string>, keywords array<string>"
)
NODE_SCHEMA = "id string, type string, title string, category string, path string"
EDGE_SCHEMA = (
    "source string, target string, relation string, label string, evidence_section_id string, "
    "evidence_text_preview string, effective_date string, confidence double"
)
MANIFEST_ENTRY_SCHEMA = (
    "path string, title string, category string, source_type string, source_file string, source_url string, "
    "publish_date string, converted_engine string"
)
EVAL_CASE_SCHEMA = "case_id string, question string, expected_doc string, category string"


def decode_text(content) -> Column:
    """UTF-8, or Latin-1 when the bytes are not valid UTF-8."""
    as_text = col(content).cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(col(content), "ISO-8859-1"))


@F.pandas_udf(StringType())
def _legacy_html_text(payload: pd.Series) -> pd.Series:
    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return raw.decode("gb18030")
        except UnicodeDecodeError:
            return raw.decode("latin-1")

    return payload.map(one)


def decode_html(content) -> Column:
    """UTF-8, then GB18030, then Latin-1; only non-UTF-8 payloads leave the JVM with content."""
    as_text = col(content).cast("string")
    valid = F.is_valid_utf8(as_text)
    return F.coalesce(F.when(valid, as_text), _legacy_html_text(F.when(~valid, col(content))))


def _relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^.*?\\Q" + root.rstrip("/") + "\\E/", "")


def scan_binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Files below ``root`` as (path, length, content); a missing root is an error."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return files.select(_relative(F.col("path"), root).alias("path"), "length", "content")


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Non-empty Markdown files as (path, text)."""
    return (
        scan_binary(spark, root, "*.md")
        .filter(F.col("length") > 0)
        .select("path", decode_text("content").alias("text"))
    )


def scan_html(spark: SparkSession, root: str) -> DataFrame:
    return scan_binary(spark, root, "*.html").select("path", decode_html("content").alias("html"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)`` of every line; numbers count from 1 in each file.

    A file may be read in many splits.  Row numbers ascend within a split, so a count and the least number per split
    place each line; only one row per split is sorted.
    """
    rows = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(placed, ["file", "block"]).select("file", (F.col("row") + F.col("shift")).alias("line_no"), "value")


def scan_json_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """JSON objects, one per line; blank lines and non-objects are skipped.

    Invalid JSON raises with ``file:line`` and the text when ``strict``; otherwise the bad lines
    come back with a filled ``_bad_line`` column.
    """
    raw = numbered_lines(spark, path) if strict else spark.read.text(path)
    filled = raw.filter(strip("value") != "")
    invalid = F.try_parse_json(F.col("value")).isNull()
    if strict:
        message = F.concat(F.lit("Invalid JSON line in "), F.concat_ws(":", "file", "line_no"), F.lit(": "), F.col("value"))
        checked = F.when(invalid, F.raise_error(message).cast("string")).otherwise(F.col("value"))
        bad = []
    else:
        checked = F.when(~invalid, F.col("value"))
        bad = [F.when(invalid, F.col("value")).alias("_bad_line")]
    rows = filled.select(checked.alias("line"), F.from_json(checked, schema).alias("r"), *bad)
    is_object = F.ltrim("line").startswith("{")
    keep = is_object if strict else (is_object | F.col("_bad_line").isNotNull())
    return rows.filter(keep).select("r.*", *(["_bad_line"] if not strict else []))


def scan_relation_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph file; both empty when it is missing or not an object.

    ``edge_ord`` is an edge's place in the file, the order in which edges are traced.
    """
    schema = f"nodes array<struct<{_fields(NODE_SCHEMA)}>>, edges array<struct<{_fields(EDGE_SCHEMA)}>>"
    try:
        graph = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("g")).select("g.*")
    except AnalysisException:
        graph = spark.createDataFrame([], schema)
    edges = graph.select(F.posexplode("edges").alias("edge_ord", "e")).select("e.*", "edge_ord")
    return graph.select(F.inline("nodes")), edges


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries: a list, or an object holding the list under one of three keys."""
    entries = f"array<struct<{_fields(MANIFEST_ENTRY_SCHEMA)}>>"
    text = F.regexp_replace("value", "^\ufeff", "")
    listed = F.from_json(text, entries)
    keyed = F.from_json(text, ", ".join(f"{k} {entries}" for k in ("entries", "documents", "files")))
    filled = [F.when(F.size(keyed[k]) > 0, keyed[k]) for k in ("entries", "documents", "files")]
    chosen = F.when(F.ltrim(text).startswith("["), listed).otherwise(F.coalesce(*filled))
    return spark.read.text(path, wholetext=True).select(F.inline(chosen))


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ", 1) for part in ddl.split(", ")))


# --- Fixed values: conversion engines per source type ------------------------------------
ENGINES = {".pdf": ("opendataloader", "mistral"), ".xlsx": ("local",), ".mhtml": ("html_local",)}


def source_inventory(files: DataFrame, html_meta: DataFrame) -> DataFrame:
    """Conversion job listing from file names and the metadata of extracted articles.

    ``files(path)`` holds the PDF and spreadsheet sources, ``html_meta(path, title, source_url,
    publish_date, content_source, original_relative_path)`` one row per extracted article
    (metadata columns NULL where no metadata was found).
    """
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    blank = F.lit("")
    direct = files.filter(extension.isin(".pdf", ".xlsx")).select(
        F.col("path").alias("input_path"),
        F.col("path").alias("source_path"),
        extension.alias("source_type"),
        path_stem("path").alias("title"),
        *[blank.alias(c) for c in ("source_url", "publish_date", "content_source")],
    )
    original = F.coalesce("original_relative_path", "path")
    articles = html_meta.select(
        F.col("path").alias("input_path"),
        original.alias("source_path"),
        F.lit(".mhtml").alias("source_type"),
        F.coalesce("title", path_stem(original)).alias("title"),
        *[F.coalesce(F.col(c), blank).alias(c) for c in ("source_url", "publish_date", "content_source")],
    )
    engines = F.create_map(*[x for k, v in ENGINES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return direct.unionByName(articles).withColumn("preferred_engines", engines[F.col("source_type")])


def find_by_suffix(documents: DataFrame, suffix: str, *, order: list, limit: int | None = None) -> DataFrame:
    """Documents whose path ends with ``suffix``, ignoring case and slash direction."""
    path = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    found = documents.filter(path.endswith(suffix.replace("\\", "/").lower())).orderBy(*order)
    return found if limit is None else found.limit(limit)
