"""Corpus preparation and the ready-data build."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folia import profiles as P
from folia.functions.frontmatter import drop_bom
from folia.functions.markup import normalize_math_markdown
from folia.operators import catalog as C
from folia.operators import graph as G
from folia.operators import sections as X
from folia.operators.cleaning import clean_body, source_category
from folia.sources.sinks import COUNT_FIELDS, build_manifest, normalized_markdown, write_artifact


def normalize_corpus(raw: DataFrame) -> DataFrame:
    """``raw(path, text, meta)`` to (path, target_path, text) of the clean Markdown corpus."""
    title = F.coalesce(
        F.when(F.col("meta.title") != "", F.col("meta.title")),
        F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", ""),
    )
    body: Column = clean_body(normalize_math_markdown(drop_bom("text")), title)
    category = F.coalesce(F.when(F.col("meta.category") != "", F.col("meta.category")), source_category("path"))
    return normalized_markdown(raw, body, category)


def ready_data(documents: DataFrame, profile: P.Profile = P.REGULATORY_ZH) -> dict[str, DataFrame]:
    """All artifact tables of ``documents(path, text)`` as lazy DataFrames.

    The tables share their scan only logically; a job that stores them should use
    ``build_ready_data``, which reads the stored sections back.
    """
    built = C.build_documents(documents, profile)
    sectioned = X.with_sections(built, profile.section_max_tokens)
    sections = X.structured_sections(sectioned, profile)
    return _derive(built, sections, X.formula_cards(sectioned, profile), profile)


def _derive(built: DataFrame, sections: DataFrame, formulas: DataFrame, profile: P.Profile) -> dict[str, DataFrame]:
    edges = G.resolve_mentions(G.mention_candidates(sections, profile), G.mention_targets(built, profile))
    return {
        "doc_catalog": C.catalog_table(built),
        "title_aliases": C.alias_table(built),
        "doc_summaries": C.summary_table(built, C.related_documents(edges)),
        "sections_structured": sections,
        "formula_cards": formulas,
        "relation_edges": edges,
    }


def load_ready_data(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The artifact tables stored below ``root``.

    JSON files don't hold types, NULL columns or empty tables, so their schemas are read from the ones written beside them.
    """
    names = (*COUNT_FIELDS, "relation_nodes")
    reader = spark.read.format(fmt)
    if fmt == "parquet":
        return {name: reader.load(f"{root.rstrip('/')}/{name}") for name in names}
    listed = spark.read.text(f"{root.rstrip('/')}/_schemas").collect()  # one short row per artifact
    schemas = dict(json.loads(row["value"]) for row in listed)
    return {name: reader.schema(StructType.fromJson(schemas[name])).load(f"{root.rstrip('/')}/{name}") for name in names}


def build_ready_data(
    spark: SparkSession, documents: DataFrame, root: str, profile: P.Profile = P.REGULATORY_ZH, *, fmt: str = "parquet"
) -> DataFrame:
    """Write every artifact below ``root`` and return the build manifest.

    The per-document work, with its one Python pass, runs once and is stored; sections,
    formulas and edges are derived from the stored table.  A lost executor costs the tasks it
    held, never an earlier stage of another artifact.
    """
    built = C.build_documents(documents, profile)
    stored = write_artifact(X.with_sections(built, profile.section_max_tokens).drop("body"), root, "_documents")
    base = spark.read.parquet(stored)
    sections = write_artifact(X.structured_sections(base, profile), root, "sections_structured", fmt=fmt)
    saved_sections = spark.read.format(fmt).schema(X.structured_sections(base, profile).schema).load(sections)
    tables = _derive(base, saved_sections, X.formula_cards(base, profile), profile)
    edges = write_artifact(tables["relation_edges"], root, "relation_edges", fmt=fmt)
    saved_edges = spark.read.format(fmt).schema(tables["relation_edges"].schema).load(edges)
    tables["doc_summaries"] = C.summary_table(base, C.related_documents(saved_edges))
    # The catalog holds the body-free columns only.
    tables["doc_catalog"] = base.drop("focus_points", "alias_records", "sections")
    for name in ("doc_catalog", "title_aliases", "doc_summaries", "formula_cards"):
        write_artifact(tables[name], root, name, fmt=fmt)
    nodes = G.document_nodes(tables["doc_catalog"])
    write_artifact(nodes, root, "relation_nodes", fmt=fmt)
    if fmt != "parquet":
        known = [(json.dumps([name, t.schema.jsonValue()]),) for name, t in (tables | {"relation_nodes": nodes}).items()]
        spark.createDataFrame(known, "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/_schemas")
    saved = {
        name: spark.read.format(fmt).schema(table.schema).load(f"{root}/{name}") for name, table in tables.items()
    }
    manifest = build_manifest(saved, root.rstrip("/").rsplit("/", 1)[-1])
    write_artifact(manifest, root, "build_manifest", fmt=fmt)
    return spark.read.format(fmt).schema(manifest.schema).load(f"{root}/build_manifest")
