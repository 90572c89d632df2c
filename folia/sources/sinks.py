"""Writers: artifact tables, build manifest, corpus manifest, feedback, normalised Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions.frontmatter import parse_front_matter, render_front_matter
from folia.functions.text import canonical_doc_id, path_stem
from folia.operators.vectors import unit_vector
from folia.sources.shared import stored

COUNT_FIELDS = {
    "doc_catalog": "doc_count",
    "title_aliases": "alias_count",
    "doc_summaries": "summary_count",
    "sections_structured": "section_count",
    "formula_cards": "formula_count",
    "relation_edges": "relation_edge_count",
}


def write_artifact(df: DataFrame, root: str, name: str, *, fmt: str = "parquet", partition_by: str | None = None) -> str:
    """Write one artifact table and return its path; JSON output is one object per line."""
    path = f"{root.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)
    return path


def artifact_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with a count per artifact; every table is counted map-side first."""
    counted = [
        t.agg(F.count("*").alias("n")).select(F.lit(COUNT_FIELDS.get(name, name)).alias("field"), "n")
        for name, t in tables.items()
    ]
    long = reduce(DataFrame.unionByName, counted)
    return long.agg(
        *[F.max(F.when(F.col("field") == f, F.col("n"))).alias(f) for f in (COUNT_FIELDS.get(n, n) for n in tables)]
    )


def build_manifest(tables: dict[str, DataFrame], source_root: str) -> DataFrame:
    files = F.array(*[F.lit(name) for name in [*tables, "build_manifest"]])
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return artifact_counts(tables).select(
        stamp.alias("built_at"), F.lit(source_root).alias("source_root"), "*", files.alias("artifact_files")
    )


def corpus_manifest(documents: DataFrame) -> DataFrame:
    """Eight manifest columns from the front matter; names starting with ``_`` are skipped."""
    meta = parse_front_matter("text")
    keys = ("category", "source_type", "source_file", "source_url", "publish_date", "converted_engine")

    def value(key: str, default: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("meta"), F.lit(key)), default).alias(key)

    return (
        documents.filter(~F.substring_index("path", "/", -1).startswith("_"))
        .select("path", meta.alias("meta"))
        .select("path", value("title", path_stem("path")), *[value(k, F.lit("")) for k in keys])
    )


def normalized_markdown(raw: DataFrame, body: Column, category: Column) -> DataFrame:
    """Target path and full text of the normalised corpus.

    ``raw(path, meta)`` with ``meta`` a struct of optional strings.  Files that would land on
    the same target get ``-2``, ``-3`` and so on, in raw path order, past targets that another file has.
    """
    name = F.substring_index("path", "/", -1)
    meta = {k: F.coalesce(F.col(f"meta.{k}"), F.lit("")) for k in P.FRONT_MATTER_KEYS if k != "category"}
    fields = {
        **meta,
        "title": F.coalesce(F.when(F.col("meta.title") != "", F.col("meta.title")), path_stem("path")),
        "category": category,
        "source_type": F.coalesce("meta.source_type", F.regexp_extract(name, r"(\.[^.]+)$", 1)),
        "source_file": F.coalesce("meta.source_file", name),
    }
    target = F.concat_ws("/", category, name)
    turns = number_within(raw.select("path", target.alias("candidate")), "candidate", F.split("path", "/"))
    placed = _free_targets(turns)
    return raw.select("path", render_front_matter(fields, body).alias("text")).join(placed, "path").select(
        "path", "target_path", "text"
    )


def _free_targets(turns: DataFrame) -> DataFrame:
    """``(path, target_path)`` with distinct targets, from ``turns(path, candidate, turn)``.

    Where files of different candidates meet on a numbered target, the first in path order has it, and that number
    is closed to the others' candidate from then on; their files move up by one.  Only names that already end in a
    number can meet, so a few rounds settle a corpus, and each round closes at least one number.
    """
    stem, extension = F.regexp_replace("candidate", r"(\.[^.]+)$", ""), F.regexp_extract("candidate", r"(\.[^.]+)$", 1)
    closed = turns.sparkSession.createDataFrame([], "candidate string, number bigint")
    while True:
        lists = closed.groupBy("candidate").agg(F.array_sort(F.collect_set("number")).alias("closed"))
        none = F.array().cast("array<bigint>")
        moved = F.aggregate(F.coalesce("closed", none), F.col("turn").cast("bigint"), lambda n, c: F.when(c <= n, n + 1).otherwise(n))
        numbered = turns.join(lists, "candidate", "left").withColumn("number", moved)
        target = F.when(F.col("number") == 1, F.col("candidate")).otherwise(F.concat(stem, F.lit("-"), F.col("number").cast("string"), extension))
        placed = stored(numbered.select("path", "candidate", "number", target.alias("target_path")), "targets")
        owners = placed.groupBy("target_path").agg(
            F.count("*").alias("files"), F.min_by("candidate", F.struct(F.split("path", "/"), "path")).alias("owner")
        ).filter("files > 1")
        lost = placed.join(owners, "target_path").filter(F.col("candidate") != F.col("owner")).select("candidate", "number").distinct()
        if lost.isEmpty():
            return placed.select("path", "target_path")
        closed = stored(closed.unionByName(lost), "closed")


def number_within(rows: DataFrame, group: str, order: Column, name: str = "turn") -> DataFrame:
    """Add ``name``: the position of a row in its group, without gathering a group in one task.

    Rows are range-partitioned by (group, order), so a group of any size is spread over several
    ranges.  A row's position is its place in the range plus the group's rows in earlier ranges.
    The ranges are stored, so a recomputed task sees the same ones.
    """
    ranged = rows.withColumn("_order", order).repartitionByRange(group, "_order")
    ranges = stored(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy("_order"))
    return (
        ranges.withColumn("_place", place)
        .join(offsets, [group, "_range"])
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_order", "_range", "_place", "_before")
    )


def write_vectors(vectors: DataFrame, path: str, *, embedding: str = "embedding") -> None:
    """Vector table with every embedding scaled to unit length."""
    vectors.withColumn(embedding, unit_vector(embedding).cast("array<float>")).write.mode("overwrite").parquet(path)


def append_feedback(spark: SparkSession, path: str, *, question: str, expected_doc: str = "", note: str = "") -> None:
    record = spark.createDataFrame([(question, expected_doc, note)], "question string, expected_doc string, note string")
    (
        record.select(
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("created_at"),
            "question",
            canonical_doc_id("expected_doc").alias("expected_doc"),
            "note",
        )
        .write.mode("append")
        .json(path)
    )


def status_report(results: DataFrame) -> DataFrame:
    """Files per status and engine."""
    return results.groupBy("status", "engine").agg(F.count("*").alias("files"))
