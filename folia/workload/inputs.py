"""Tables the workload queries read: the parquet files and what Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia.sources.tables import read_table


def documents(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents")


def questions(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark passages as questions."""
    return spark.read.parquet(f"{root}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def page_fields(spark: SparkSession, root: str) -> DataFrame:
    """Title, language, links and paragraphs of the HTML pages."""
    html = F.col("html")
    paragraph = F.transform(
        F.regexp_extract_all(html, F.lit("(?s)<p>(.*?)</p>"), F.lit(1)),
        lambda p: F.btrim(F.regexp_replace(p, "<[^>]+>", " ")),
    )
    return read_table(spark, root, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"),
        F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html, "(?s)<h1>(.*?)</h1>", 1).alias("h1"),
        F.filter(paragraph, lambda p: p != "").alias("paragraphs"),
        F.regexp_extract_all(html, F.lit('href="/([^"]+)"'), F.lit(1)).alias("links"),
    )


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """The pages as Markdown documents: (path, text) with front matter, two headings and links."""
    links = F.transform("links", lambda a: F.concat(F.lit("[link](/"), a, F.lit(")")))
    text = F.concat(
        F.lit("---\ntitle: "), "title", F.lit("\nsource_type: .html\nsource_url: "), "url",
        F.lit("\npublish_date: \n---\n\n# "), "title", F.lit("\n\n# "), "h1", F.lit("\n\n"),
        F.array_join("paragraphs", "\n\n"), F.lit("\n\n"), F.array_join(links, " "), F.lit("\n"),
    )
    path = F.concat("lang", F.lit("/"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".md"))
    return page_fields(spark, root).select(path.alias("path"), text.alias("text"))


def title_questions(spark: SparkSession, root: str) -> DataFrame:
    """Every page title as a question."""
    return page_fields(spark, root).select(F.col("page_id").alias("query_id"), F.col("title").alias("question"))


def user_turns(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "conversations").filter(F.col("role") == "user")


def order_edges(spark: SparkSession, root: str) -> DataFrame:
    """Customer to nation and supplier to nation links, nation to region links."""
    def edges(table: str, source: str, target: str, relation: str, s: str, t: str) -> DataFrame:
        return read_table(spark, root, table).select(
            F.concat(F.lit(s), F.col(source).cast("string")).alias("source"),
            F.concat(F.lit(t), F.col(target).cast("string")).alias("target"),
            F.lit(relation).alias("relation"),
        )

    both = (
        edges("customer", "c_custkey", "c_nationkey", "mentions_rule", "customer/", "nation/")
        .unionByName(edges("supplier", "s_suppkey", "s_nationkey", "adjusts_rule", "supplier/", "nation/"))
        .unionByName(edges("nation", "n_nationkey", "n_regionkey", "applies_to_rule", "nation/", "region/"))
    )
    return both.withColumn("evidence_section_id", F.concat("source", F.lit("#section-1"))).withColumn(
        "edge_ord", F.concat_ws("|", "source", "target")
    )


def place_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Nations, regions, suppliers and customers as catalog entries."""
    def entries(table: str, key: str, name: str, prefix: str, category: str) -> DataFrame:
        return read_table(spark, root, table).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("doc_id"),
            F.col(name).alias("title"),
            F.lit(category).alias("category"),
        )

    both = (
        entries("nation", "n_nationkey", "n_name", "nation/", "rules")
        .unionByName(entries("region", "r_regionkey", "r_name", "region/", "rules"))
        .unionByName(entries("supplier", "s_suppkey", "s_name", "supplier/", "notices"))
        .unionByName(entries("customer", "c_custkey", "c_name", "customer/", "attachments"))
    )
    return both.withColumn("path", F.concat(F.lit("corpus/"), "doc_id"))


def lexical_hits(spark: SparkSession, root: str, k: int = 10) -> DataFrame:
    """Top documents per benchmark question as a hit table."""
    from folia.operators.lexical import search
    from folia.workload.queries import DOC_SPEC, document_corpus

    found = search(questions(spark, root), document_corpus(spark, root), DOC_SPEC, k)
    texts = documents(spark, root).select("doc_id", "text", "source")
    return found.join(texts, "doc_id").select(
        "query_id", F.col("rank").alias("ord"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        "text", (F.col("score") / 100.0).alias("retrieval_score"), "doc_id",
    )


def last_turns(spark: SparkSession, root: str) -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read_table(spark, root, "conversations").withColumn("back", F.row_number().over(newest)).filter("back = 1")
