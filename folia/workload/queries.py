"""One callable per operator: (spark, directory) to DataFrame.

Arrays are joined to strings so the results compare column by column with plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions import frontmatter as FM
from folia.functions import text as T
from folia.functions.markup import normalize_math_markdown, repair_latex_artifacts
from folia.functions.payload import json_payload, message_text
from folia.operators import catalog as C
from folia.operators import cleaning, conversation, filenames, fusion, graph, quality, routing, sections, vectors
from folia.operators import evidence as E
from folia.operators import html as H
from folia.operators import lexical as L
from folia.operators import titles
from folia.plans import questions as plans
from folia.plans import ready_data as builds
from folia.plans import retrieval
from folia.sources import sinks
from folia.sources.files import scan_json_lines, source_inventory
from folia.sources.shared import new_folder, stored
from folia.sources.tables import read_table
from folia.workload import inputs as I

DOC_SPEC = L.SearchSpec(ties=(("doc_id", True),), exact_boost=90.0, scope_boost=35.0)
SEP = "\x1f"


def _joined(value, name: str) -> Column:
    return F.array_join(value, SEP).alias(name)


def _long(value) -> Column:
    return T.col(value).cast("bigint")


# --- scalar text functions over documents ------------------------------------------------
def validity_report(spark: SparkSession, root: str) -> DataFrame:
    return cleaning.with_validity(I.documents(spark, root)).select("doc_id", "is_valid", "reason")


def validity_counts(spark: SparkSession, root: str) -> DataFrame:
    checked = cleaning.with_validity(I.documents(spark, root))
    results = checked.select(F.when(F.col("is_valid"), "ok").otherwise("rejected").alias("status"), F.col("lang").alias("engine"))
    return sinks.status_report(results)


def normalized_text(spark: SparkSession, root: str) -> DataFrame:
    form = T.norm_text("text")
    return I.documents(spark, root).select("doc_id", F.md5(form).alias("norm_md5"), _long(F.length(form)).alias("norm_chars"))


def text_snippets(spark: SparkSession, root: str) -> DataFrame:
    return I.documents(spark, root).select(
        "doc_id", T.truncate("text", 180).alias("flat"), T.snippet("text", 700).alias("snippet")
    )


def char_gram_counts(spark: SparkSession, root: str) -> DataFrame:
    """Distinct 2/3/4-grams per conversation turn."""
    grams = T.char_grams(T.norm_text("text"))
    return read_table(spark, root, "conversations").select(
        "conv_id", "turn", _long(F.size(grams)).alias("n_grams"), F.md5(F.array_join(F.array_sort(grams), ",")).alias("grams_md5")
    )


def content_terms(spark: SparkSession, root: str) -> DataFrame:
    terms = T.content_terms("text")
    return I.documents(spark, root).select("doc_id", _long(F.size(terms)).alias("n_terms"), F.md5(F.array_join(terms, " ")).alias("terms_md5"))


def keywords_first40(spark: SparkSession, root: str) -> DataFrame:
    return I.documents(spark, root).select("doc_id", _joined(T.keyword_tokens([F.col("text")], 40), "keywords"))


def token_counts(spark: SparkSession, root: str) -> DataFrame:
    return I.documents(spark, root).select("doc_id", _long(T.token_count("text")).alias("n_tokens"))


def embedding_texts(spark: SparkSession, root: str) -> DataFrame:
    docs = C.with_body(I.markdown(spark, root), P.WEB)
    with_headings = docs.withColumn("headings", T.headings("body", None))
    return with_headings.select("doc_id", F.md5(T.embedding_text("path", "title", F.col("headings"), "body", max_tokens=300)).alias("embed_md5"))


def token_windows(spark: SparkSession, root: str) -> DataFrame:
    cut = sections.token_windows(I.documents(spark, root), "doc_id", 200, 40)
    return cut.select("doc_id", _long("window_no").alias("window_no"), "window_text")


def content_types(spark: SparkSession, root: str) -> DataFrame:
    """Formula and table flags, type and leading article of every page as Markdown."""
    text = I.markdown(spark, root).select("path", FM.strip_front_matter("text").alias("body"))
    flagged = text.withColumn("has_formula", T.has_formula("body")).withColumn("has_table", T.has_table("body"))
    return flagged.select(
        "path", "has_formula", "has_table",
        T.content_type("body", F.col("has_formula"), F.col("has_table")).alias("content_type"),
        T.article_no("body").alias("article_no"), T.clause_no("body").alias("clause_no"),
    )


def source_urls(spark: SparkSession, root: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("."), "lang", F.concat(F.col("title"), F.lit(".md")))
    return I.page_fields(spark, root).select("page_id", T.blob_url(path, "https://host.example/blob/main").alias("url"))


def canonical_ids(spark: SparkSession, root: str) -> DataFrame:
    raw = F.concat(F.lit("./corpus/./"), F.col("source"), F.lit("\\"), F.col("doc_id").cast("string"))
    return I.documents(spark, root).select("doc_id", T.canonical_doc_id(raw, "corpus/").alias("canonical_id"))


def json_recovery(spark: SparkSession, root: str) -> DataFrame:
    """JSON found inside free text: event properties wrapped in prose."""
    said = F.concat(F.lit("result: "), F.col("props"), F.lit(" for user "), F.col("user_id").cast("string"))
    return read_table(spark, root, "events").select("event_id", json_payload(said).alias("payload"))


def message_texts(spark: SparkSession, root: str) -> DataFrame:
    part = F.create_map(F.lit("type"), F.lit("text"), F.lit("text"), F.col("text"))
    tool = F.create_map(F.lit("type"), F.lit("tool-call"), F.lit("toolName"), F.col("role"))
    return read_table(spark, root, "conversations").select(
        "conv_id", "turn", message_text(F.array(part, tool)).alias("message")
    )


# --- cleaning ----------------------------------------------------------------------------
def heading_dedupe(spark: SparkSession, root: str) -> DataFrame:
    """Repeated headings: titles and first headings of the pages are the same line."""
    body = FM.strip_front_matter("text")
    return I.markdown(spark, root).select("path", cleaning.dedupe_headings(body).alias("body"))


def leading_title(spark: SparkSession, root: str) -> DataFrame:
    md = I.markdown(spark, root).select("path", FM.front_matter_title("text").alias("title"), FM.strip_front_matter("text").alias("body"))
    return md.select("path", cleaning.dedupe_leading_title("body", "title").alias("body"))


def corpus_manifest(spark: SparkSession, root: str) -> DataFrame:
    return sinks.corpus_manifest(I.markdown(spark, root))


def normalized_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Cleaned Markdown with rendered front matter and collision-free target paths."""
    meta = F.struct(
        F.lit(None).cast("string").alias("title"), F.substring_index("path", "/", 1).alias("category"),
        *[F.lit(None).cast("string").alias(k) for k in P.FRONT_MATTER_KEYS if k not in ("title", "category")],
    )
    raw = I.markdown(spark, root).select("path", FM.strip_front_matter("text").alias("text"), meta.alias("meta"))
    return builds.normalize_corpus(raw).select("path", "target_path", F.md5("text").alias("text_md5"))


def math_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Math repair over the page texts, where entities and dollar runs occur as noise."""
    md = I.markdown(spark, root)
    return md.select("path", normalize_math_markdown(F.col("text")).alias("text"))


def latex_repair(spark: SparkSession, root: str) -> DataFrame:
    raw = F.concat(F.lit("\\mathrm{"), "p_name", F.lit("} {\\text{"), "p_type", F.lit("}} = \\operatorname{ M i n }("), "p_brand", F.lit(")"))
    return read_table(spark, root, "part").select("p_partkey", repair_latex_artifacts(raw).alias("latex"))


def html_title(spark: SparkSession, root: str) -> DataFrame:
    found = H.extract_articles(read_table(spark, root, "pages"), "page_id")
    return found.select("page_id", "title", "publish_date", "content_source")


def html_main_text(spark: SparkSession, root: str) -> DataFrame:
    pages = read_table(spark, root, "pages")
    found = H.extract_articles(pages, "page_id").join(pages.select("page_id", "url"), "page_id")
    document = H.article_document("title", "publish_date", "content_source", "url", "content_html")
    return found.select("page_id", "content_html", document.alias("document"))


def asset_references(spark: SparkSession, root: str) -> DataFrame:
    """Image folders named in Markdown built from the page links."""
    shown = F.transform("links", lambda a: F.concat(F.lit("![x]("), a, F.lit("_images/1.png)")))
    docs = I.page_fields(spark, root).select(F.col("page_id").alias("path"), F.array_join(shown, " ").alias("text"))
    return cleaning.asset_references(docs)


def dangling_assets(spark: SparkSession, root: str) -> DataFrame:
    """Image folders named in Markdown that the folder listing (lower-case names) lacks."""
    shown = F.transform("links", lambda a: F.concat(F.lit("![x]("), a, F.lit("_images/1.png)")))
    fields = I.page_fields(spark, root)
    docs = fields.select(F.col("page_id").alias("path"), F.array_join(shown, " ").alias("text"))
    listed = fields.select(F.col("page_id").alias("path"), F.explode("links").alias("a")).select(
        "path", F.concat(F.lower("a"), F.lit("_images")).alias("asset_dir")
    )
    return cleaning.dangling_assets(docs, listed)


def source_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Conversion jobs of a listing built from parts (sources) and pages (extracted articles)."""
    kind = F.when(F.col("p_size") > 25, ".pdf").otherwise(".xlsx")
    files = read_table(spark, root, "part").select(F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string"), kind).alias("path"))
    pages = I.page_fields(spark, root).select(
        F.concat("lang", F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        "title", F.col("url").alias("source_url"),
        *[F.lit(None).cast("string").alias(c) for c in ("publish_date", "content_source", "original_relative_path")],
    )
    return source_inventory(files, pages).withColumn("preferred_engines", F.array_join("preferred_engines", ","))


# --- catalog -----------------------------------------------------------------------------
def intro_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    body = FM.strip_front_matter("text")
    return I.markdown(spark, root).select("path", _joined(C.intro_paragraphs(body), "paragraphs"))


def catalog_build(spark: SparkSession, root: str) -> DataFrame:
    built = C.build_documents(I.markdown(spark, root), P.WEB)
    return built.select(
        "doc_id", "path", "title", "category", "source_type", "publish_date", "summary_short", "summary_structured",
        _joined("headings", "headings"), _joined("aliases", "aliases"), _joined("keywords", "keywords"),
        _joined("focus_points", "focus_points"),
    )


def title_aliases(spark: SparkSession, root: str) -> DataFrame:
    return C.alias_table(C.build_documents(I.markdown(spark, root), P.WEB))


def catalog_fallback(spark: SparkSession, root: str) -> DataFrame:
    """Catalog derived from a manifest and its Markdown."""
    md = I.markdown(spark, root)
    found = C.fallback_catalog(sinks.corpus_manifest(md), md)
    return found.select("doc_id", "title", "category", "summary_short", _joined("headings", "headings"), _joined("keywords", "keywords"))


# --- sections ----------------------------------------------------------------------------
def line_blocks(spark: SparkSession, root: str) -> DataFrame:
    body = I.markdown(spark, root).select("path", FM.strip_front_matter("text").alias("text"))
    cut = sections.with_blocks(body).select("path", F.posexplode("blocks").alias("block_no", "b"))
    return cut.select(
        "path", _long("block_no").alias("block_no"), F.col("b.kind").alias("kind"), _long("b.level").alias("level"),
        F.col("b.text").alias("text"),
    )


def _sectioned(spark: SparkSession, root: str, max_tokens: int = 1200) -> DataFrame:
    """The sections with the columns that section and formula tables read; summaries and bodies are not derived for them."""
    cut = sections.with_sections(C.build_documents(I.markdown(spark, root), P.WEB), max_tokens)
    return cut.select("doc_id", "path", "title", "category", "publish_date", "aliases", "sections")


def structured_sections(spark: SparkSession, root: str) -> DataFrame:
    cut = sections.structured_sections(_sectioned(spark, root), P.WEB)
    return cut.select(
        "section_id", "doc_id", "section_heading", _joined("heading_path", "heading_path"), "content_type",
        _long("token_count").alias("token_count"), "has_formula", "has_table", _joined("mentions_rules", "mentions_rules"),
        _joined("keywords", "keywords"), "text",
    )


def formula_cards(spark: SparkSession, root: str) -> DataFrame:
    """Math blocks of the pages; dollar runs in the page noise stand for formulas."""
    cards = sections.formula_cards(_sectioned(spark, root), P.WEB)
    return cards.select("formula_id", "doc_id", "section_heading", "formula_text", _joined("variables", "variables"))


def section_embedding_inputs(spark: SparkSession, root: str) -> DataFrame:
    rows = sections.section_rows(_sectioned(spark, root))
    text = T.embedding_text("path", "title", F.col("heading_path"), "text", kind=F.col("section_kind"), max_tokens=P.WEB.section_embed_max_tokens)
    return rows.select("doc_id", _long("section_index").alias("section_index"), _long("token_count").alias("token_count"), F.md5(text).alias("embed_md5"))


# --- graph -------------------------------------------------------------------------------
def _link_edges(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(catalog, edges): a page mentions the page whose title starts with the linked word."""
    built = C.with_body(I.markdown(spark, root), P.WEB)
    whole = built.select(
        "doc_id", "category", "publish_date", F.col("body").alias("text"), F.lit(1).alias("section_idx"),
        F.concat("doc_id", F.lit("#section-1")).alias("section_id"),
        T.mention_labels("body", P.WEB.mention_patterns["rule"], P.WEB.mention_labels["rule"]).alias("mentions_rules"),
    )
    edges = graph.resolve_mentions(graph.mention_candidates(whole, P.WEB), graph.mention_targets(built, P.WEB))
    return built, edges


def mention_edges(spark: SparkSession, root: str) -> DataFrame:
    _, edges = _link_edges(spark, root)
    return edges.select("source", "target", "relation", "label", "evidence_section_id", "evidence_text_preview", "effective_date", "confidence")


def related_ids(spark: SparkSession, root: str) -> DataFrame:
    _, edges = _link_edges(spark, root)
    return C.related_documents(edges).select("doc_id", _joined("related_doc_ids", "related_doc_ids"))


def enriched_edges(spark: SparkSession, root: str) -> DataFrame:
    edges = graph.enrich_edges(I.order_edges(spark, root), I.place_catalog(spark, root), "corpus/")
    return edges.select("source", "target", "relation", "source_title", "target_title", "source_path", "target_path")


def _places(spark: SparkSession, root: str) -> DataFrame:
    """Every nation as a trace question."""
    return read_table(spark, root, "nation").select(
        F.col("n_nationkey").alias("query_id"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("doc_id")
    )


def relations_in_out(spark: SparkSession, root: str) -> DataFrame:
    traced = graph.trace_relations(I.order_edges(spark, root), _places(spark, root), limit=20)
    return traced.select("query_id", "source", "target", "relation", _long("edge_rank").alias("edge_rank"))


def notice_traces(spark: SparkSession, root: str) -> DataFrame:
    traced = graph.trace_notices(I.order_edges(spark, root), _places(spark, root), I.place_catalog(spark, root), limit=20)
    return traced.select("query_id", "source", "target", "relation", _long("edge_rank").alias("edge_rank"))


def adjustment_traces(spark: SparkSession, root: str) -> DataFrame:
    scope = read_table(spark, root, "supplier").select(
        F.col("s_nationkey").alias("query_id"), F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("doc_id")
    )
    traced = graph.trace_adjustments(I.order_edges(spark, root), scope, limit=20)
    return traced.select("query_id", "source", "target", "relation", _long("edge_rank").alias("edge_rank"))


def alias_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Part names, types and brands as questions; the place names as catalog."""
    asked = read_table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.concat(F.lit("about "), "s_name").alias("question")
    )
    catalog = I.place_catalog(spark, root).withColumn("aliases", F.array("title")).withColumn("summary_short", F.col("category"))
    return titles.resolve_documents(asked, catalog, limit=5, prefix="corpus/").select(
        "query_id", _long("rank").alias("rank"), "doc_id", "score"
    )


def formula_explanations(spark: SparkSession, root: str) -> DataFrame:
    sectioned = stored(_sectioned(spark, root), "sectioned")
    cards, cut = sections.formula_cards(sectioned, P.WEB), sections.structured_sections(sectioned, P.WEB)
    told = graph.explain_formulas(graph.find_formula(cards, cards.select("formula_id")), cut)
    evidence = F.transform("variable_explanations", lambda v: F.concat_ws("=", v["variable"], F.array_join(v["evidence"], "|")))
    return told.select("formula_id", "section_id", _joined("variables", "variables"), _joined(evidence, "evidence"), "applicability_evidence")


def formula_section_match(spark: SparkSession, root: str) -> DataFrame:
    sectioned = stored(_sectioned(spark, root), "sectioned")
    return graph.formula_sections(sections.formula_cards(sectioned, P.WEB), sections.structured_sections(sectioned, P.WEB))


# --- ranked retrieval --------------------------------------------------------------------
def document_corpus(spark: SparkSession, root: str) -> DataFrame:
    none = F.slice(F.array(F.lit("")), 1, 0)
    return I.documents(spark, root).select("doc_id", F.col("text").alias("haystack"), none.alias("keywords"))


def lexical_topk(spark: SparkSession, root: str) -> DataFrame:
    """Five best documents for every benchmark passage."""
    found = L.search(I.questions(spark, root), document_corpus(spark, root), DOC_SPEC, 5)
    return found.select("query_id", _long("rank").alias("rank"), "doc_id", "score")


def scoped_search(spark: SparkSession, root: str) -> DataFrame:
    """The same inside the documents labelled as good."""
    good = read_table(spark, root, "labels").filter(F.col("quality") == 1).select("doc_id")
    found = L.search_shared_scope(I.questions(spark, root), document_corpus(spark, root), good, DOC_SPEC, 5)
    return found.select("query_id", _long("rank").alias("rank"), "doc_id", "score")


def keyword_search(spark: SparkSession, root: str) -> DataFrame:
    """Page titles as texts with their words as keywords; whole titles as questions."""
    corpus = I.page_fields(spark, root).select(
        F.col("page_id").alias("doc_id"), F.col("title").alias("haystack"), T.keyword_tokens([F.col("title")], 40).alias("keywords")
    )
    found = L.search(I.title_questions(spark, root), corpus, DOC_SPEC, 5)
    return found.select("query_id", _long("rank").alias("rank"), "doc_id", "score")


def question_scope_search(spark: SparkSession, root: str) -> DataFrame:
    """Conversation questions against the documents of their own scope: equi-joined, pair-scored."""
    asked = I.user_turns(spark, root).groupBy("conv_id").agg(F.max_by("text", "turn").alias("question")).withColumnRenamed("conv_id", "query_id")
    scope = read_table(spark, root, "labels").select(F.col("doc_id").alias("query_id"), "doc_id")
    corpus = document_corpus(spark, root)
    inside = asked.join(scope.select("query_id").distinct(), "query_id", "left_semi")
    found = L.search_in_scope(inside, corpus, scope, DOC_SPEC, 5, ["doc_id"])
    return found.select("query_id", "doc_id", "score", "reason")


def section_search(spark: SparkSession, root: str) -> DataFrame:
    """Whole titles against the structured sections of all pages."""
    cut = stored(sections.structured_sections(_sectioned(spark, root), P.WEB), "sections")
    found = L.search_sections(I.title_questions(spark, root), cut, limit=5)
    return found.select("query_id", _long("rank").alias("rank"), "section_id", "score", "reason")


def formula_search(spark: SparkSession, root: str) -> DataFrame:
    cards = stored(sections.formula_cards(_sectioned(spark, root), P.WEB), "formulas")
    found = L.search_formulas(I.title_questions(spark, root), cards, limit=5)
    return found.select("query_id", _long("rank").alias("rank"), "formula_id", "score", "reason")


def summary_search(spark: SparkSession, root: str) -> DataFrame:
    """Whole titles against the summaries of all pages."""
    built = C.build_documents(I.markdown(spark, root), P.WEB)
    _, edges = _link_edges(spark, root)
    summaries = stored(C.summary_table(built, C.related_documents(edges)), "summaries")
    found = L.search_summaries(I.title_questions(spark, root), summaries, C.catalog_table(built), limit=5)
    return found.select("query_id", _long("rank").alias("rank"), "doc_id", "score", "reason")


def _web_catalog(spark: SparkSession, root: str) -> DataFrame:
    return stored(C.catalog_table(C.build_documents(I.markdown(spark, root), P.WEB)), "catalog")


def title_ladder(spark: SparkSession, root: str) -> DataFrame:
    found = titles.search_titles(I.title_questions(spark, root), _web_catalog(spark, root), limit=5)
    return found.select("query_id", _long("rank").alias("rank"), "doc_id", "title", "score", "reason")


def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    """Five nearest vectors of every vector."""
    table = read_table(spark, root, "embeddings")
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.vector_top_k(asked, table, key="vec_id", k=5, threshold=0.0)
    return found.select("query_id", _long("rank").alias("rank"), "vec_id", F.round("score", 4).alias("score"))


def unit_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Largest component and length of every normalised vector."""
    unit = vectors.unit_vector("embedding")
    return read_table(spark, root, "embeddings").select(
        "vec_id", F.round(F.array_max(unit), 6).alias("largest"), F.round(F.sqrt(vectors.squared_norm(unit)), 6).alias("norm")
    )


def vector_dimensions(spark: SparkSession, root: str) -> DataFrame:
    return vectors.dimension_report(read_table(spark, root, "embeddings"), 64)


def filename_matches(spark: SparkSession, root: str) -> DataFrame:
    """Questions that name files: page paths by title, whole titles as questions."""
    docs = I.page_fields(spark, root).select(
        "page_id", F.concat_ws("/", "lang", F.concat(F.translate("title", "/", "_"), F.lit(".md"))).alias("path")
    )
    found = filenames.filename_hits(I.title_questions(spark, root), docs, order="page_id")
    return found.select("query_id", "path", "page_id", F.round("retrieval_score", 4).alias("retrieval_score"))


def merge_hits(spark: SparkSession, root: str) -> DataFrame:
    """Lexical hits merged with the same hits found a second time at half the score."""
    first = I.lexical_hits(spark, root)
    again = first.withColumn("ord", F.col("ord") + 100).withColumn("retrieval_score", F.col("retrieval_score") / 2)
    merged = fusion.merge_hits(first.unionByName(again))
    return merged.select("query_id", "path", _long("ord").alias("ord"), "retrieval_score")


def reranked_hits(spark: SparkSession, root: str) -> DataFrame:
    found = fusion.rerank(I.lexical_hits(spark, root), I.questions(spark, root), 5)
    return found.select(
        "query_id", _long("rank").alias("rank"), "doc_id", F.round("rerank_score", 6).alias("rerank_score"),
        F.array_join("domain_terms_matched", ",").alias("domain_terms_matched"),
    )


def domain_contexts(spark: SparkSession, root: str) -> DataFrame:
    asked = I.user_turns(spark, root).select("conv_id", "turn", F.col("text").alias("question"))
    found = fusion.domain_context(asked)
    return found.select("conv_id", "turn", "planner_hint", "reflector_hint", F.array_join("priority_terms", ",").alias("priority_terms"))


def _turn_hits(spark: SparkSession, root: str) -> DataFrame:
    """Assistant turns as hits of their conversation, ranked by turn; a long conversation is numbered in ranges."""
    said = read_table(spark, root, "conversations").filter(F.col("role") == "assistant")
    return sinks.number_within(said, "conv_id", F.col("turn"), "turn_no").select(
        F.col("conv_id").alias("query_id"), F.col("turn_no").cast("int").alias("rank"), "turn",
        F.concat(F.lit("conv/"), F.col("turn").cast("string"), F.lit(".md")).alias("path"), "text",
        F.lit(0).alias("token_count"), F.lit("document").alias("source_kind"), F.lit(None).cast("string").alias("section_heading"),
    )


def context_budget(spark: SparkSession, root: str) -> DataFrame:
    kept = fusion.within_budget(_turn_hits(spark, root), F.lit(400), max_hits=F.lit(3))
    return kept.select("query_id", "turn", _long("rank").alias("rank"))


def answer_context(spark: SparkSession, root: str) -> DataFrame:
    """Lexical hits as documents and their lines as sections, cut to small budgets."""
    hits = I.lexical_hits(spark, root, 8).withColumn("token_count", F.lit(0)).withColumn("section_heading", F.lit("line"))
    docs = hits.withColumn("source_kind", F.lit("document"))
    lines = hits.select("*", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line") != "")
    place = (F.col("ord") * 100_000 + F.col("line_no")).cast("int")
    secs = lines.withColumn("source_kind", F.lit("section")).withColumn("text", F.col("line")).withColumn("ord", place).drop("line", "line_no")
    kept = fusion.answer_hits(docs.unionByName(secs), I.questions(spark, root), doc_tokens=3000, section_tokens=500)
    return kept.select("query_id", _long("rank").alias("rank"), "source_kind", "doc_id", F.round("rerank_score", 6).alias("rerank_score"))


def rendered_context(spark: SparkSession, root: str) -> DataFrame:
    """The turns that fit a budget, as one text per conversation."""
    return fusion.render_context(fusion.within_budget(_turn_hits(spark, root), F.lit(400), max_hits=F.lit(3)))


def answer_sources(spark: SparkSession, root: str) -> DataFrame:
    found = fusion.source_list(_turn_hits(spark, root), "https://host.example/blob/main")
    return found.select("query_id", _long("index").alias("index"), "path", "url", "snippet", "heading")


def _sub_query_hits(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(sub-queries, hits): every passage, its first sentence and its lower-case form, with four hits each."""
    asked = I.questions(spark, root)
    listed = fusion.normalize_queries(F.array("question", F.substring_index("question", ".", 1), F.lower("question")))
    subs = asked.select(F.col("query_id").alias("question_id"), F.posexplode(listed).alias("query_ord", "query"))
    keyed = subs.withColumn("query_id", F.concat_ws(":", F.col("question_id").cast("string"), F.col("query_ord").cast("string")))
    found = L.search(keyed.select("query_id", F.col("query").alias("question")), document_corpus(spark, root), DOC_SPEC, 4)
    texts = I.documents(spark, root).select("doc_id", "text")
    hits = found.join(texts, "doc_id").select(
        F.split_part("query_id", F.lit(":"), F.lit(1)).cast("bigint").alias("question_id"),
        F.split_part("query_id", F.lit(":"), F.lit(2)).cast("int").alias("query_ord"),
        "rank", F.col("doc_id").cast("string").alias("path"), "text", (F.col("score") / 100.0).alias("retrieval_score"),
    )
    return subs, hits


def multi_query(spark: SparkSession, root: str) -> DataFrame:
    """New hits per sub-query."""
    subs, hits = _sub_query_hits(spark, root)
    history = fusion.retrieval_history(subs, fusion.first_seen_hits(hits.drop("retrieval_score")))
    return history.select("question_id", _long("query_ord").alias("query_ord"), "query", _long("new_hits").alias("new_hits"), F.array_join("paths", ",").alias("paths"))


def multi_query_hits(spark: SparkSession, root: str) -> DataFrame:
    """The hits that all sub-queries of a question end with: pooled, reranked and cut to the synthesis width."""
    subs, hits = _sub_query_hits(spark, root)
    final, _ = retrieval.multi_query(I.questions(spark, root), subs, stored(hits, "sub_hits"), top_k=4)
    return final.select("query_id", _long("rank").alias("rank"), "path", F.round("rerank_score", 6).alias("rerank_score"))


def json_lines_scan(spark: SparkSession, root: str) -> DataFrame:
    """Conversations written as JSON lines and scanned back."""
    folder = new_folder(spark, "json_lines")
    table = read_table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    table.write.json(folder)
    return scan_json_lines(spark, folder, "conv_id bigint, turn bigint, role string, text string")


def stored_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors written at unit length and read back: dimension, length and largest component."""
    folder = new_folder(spark, "vectors")
    sinks.write_vectors(read_table(spark, root, "embeddings"), folder)
    return spark.read.parquet(folder).select(
        "vec_id", _long(F.size("embedding")).alias("dimension"), F.round(F.sqrt(vectors.squared_norm(F.col("embedding"))), 4).alias("norm"),
        F.round(F.array_max("embedding").cast("double"), 4).alias("largest"),
    )


def hybrid_retrieval(spark: SparkSession, root: str) -> DataFrame:
    """Vector and file name hits over documents and page openings, by question strategy."""
    table = read_table(spark, root, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    docs = I.documents(spark, root).select(
        F.col("doc_id").alias("row_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("lang").alias("title"), "text", F.lit(0).alias("token_count"), F.lit("document").alias("source_kind"),
        F.lit(None).cast("string").alias("section_heading"),
    )
    pages = I.page_fields(spark, root).select(
        F.col("page_id").alias("row_id"), F.concat_ws("/", "lang", "title").alias("path"), "title",
        F.array_join("paragraphs", "\n").alias("text"), F.lit(0).alias("token_count"), F.lit("section").alias("source_kind"),
        F.col("h1").alias("section_heading"),
    )
    # rows without a vector stay: a file name can still hit them
    asked = I.questions(spark, root).join(table, F.col("query_id") == F.col("row_id"), "left").drop("row_id")
    found = retrieval.retrieve(asked, docs.join(table, "row_id", "left"), pages.join(table, "row_id", "left"))
    return found.select("query_id", _long("rank").alias("rank"), "path", "source_kind", F.round("rerank_score", 6).alias("rerank_score"))


# --- routing and conversations -----------------------------------------------------------
def question_routing(spark: SparkSession, root: str) -> DataFrame:
    """Type, strategy, count and follow-up flags and evidence steps of every user turn."""
    kind = routing.question_type("text")
    return I.user_turns(spark, root).select(
        "conv_id", "turn", kind.alias("question_type"), routing.retrieval_strategy("text").alias("strategy"),
        routing.is_catalog_count("text").alias("is_count"), routing.needs_history("text").alias("needs_history"),
        routing.plan_strategy(kind).alias("plan_strategy"), F.array_join(routing.evidence_steps(kind), ",").alias("steps"),
    )


def filename_hints(spark: SparkSession, root: str) -> DataFrame:
    """Numbered references in generated rule questions, one per part."""
    said = F.concat(F.lit("规则第"), F.col("p_size").cast("string"), F.lit("号和附件"), F.col("p_partkey").cast("string"), F.lit("-1的关系"))
    return read_table(spark, root, "part").select(
        "p_partkey", F.array_join(T.filename_hints(said), ",").alias("hints"), routing.question_type(said).alias("question_type"),
        routing.retrieval_strategy(said).alias("strategy"), routing.needs_history(said).alias("needs_history"),
    )


#: One form for every branch of the routing rules; ``{}`` stands for the part's number.  Fixed values of the test input.
ROUTED = (
    "规则第{}号和规则第2号的区别", "监管规则一共有多少号规定？", "最低资本的计算公式是什么", "优化监管标准的通知修订了什么",
    "保险公司是否需要报送", "规则第{}号的主要内容", "附件{}在哪里", "why is it so", "那它的定义呢", "偿付能力充足率的定义",
)
#: One form for every kind of content and numbering.  Fixed values of the test input.
CONTENTS = (
    "第三条 资本为 $$x_{}$$ 。", "第四条 见表\n| a | b |\n| 1 | {} |", "第五条 保险公司的职责。", "其中\n$$\ny_{}\n$$", "| a | {} |\n| c | d |",
    "比例上限为 {}%", "公司应当提交报告", "一般说明", "（一）本款说明 {}", "第{}条",
)


#: One form for every repair of math and for what must stay.  Fixed values of the test input.
MATHS = (
    "a &lt; {}", "x $$a &amp;amp;lt; {}$$", "\\[ a & gt; {} \\]", "$$\nx_{ \\市场 _1 } + y^{\\信用} + {}\n$$", "$$0. 1 4 8 \\%$$ {}",
    "$$x = − 1 . 5$$ {}", "$$f=\\left\\{\\begin{array}{l l} 1 & a \\\\ {} & b\\end{array}\\right.$$", "用 $\\rho_{ij}$ 表示 {}",
    "用 $k_{1} = 0.5$ 表示 {}", "用 $\\frac{a}{b}$ 表示 {}",
)


def _form(forms: tuple[str, ...]) -> Column:
    """The form of a part, by its key, with its number filled in."""
    chosen = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    return F.replace(chosen, F.lit("{}"), F.col("p_size").cast("string"))


def routing_branches(spark: SparkSession, root: str) -> DataFrame:
    """Every routing decision for questions of all kinds, one per part."""
    said = read_table(spark, root, "part").select("p_partkey", _form(ROUTED).alias("said"))
    kind = routing.question_type("said")
    return said.select(
        "p_partkey", kind.alias("question_type"), routing.retrieval_strategy("said").alias("strategy"),
        routing.is_catalog_count("said").alias("is_count"), routing.needs_history("said").alias("needs_history"),
        routing.plan_strategy(kind).alias("plan_strategy"), F.array_join(routing.evidence_steps(kind), ",").alias("steps"),
    )


def content_branches(spark: SparkSession, root: str) -> DataFrame:
    """Flags, type, article and clause of contents of all kinds, one per part."""
    text = read_table(spark, root, "part").select("p_partkey", _form(CONTENTS).alias("body"))
    flagged = text.withColumn("has_formula", T.has_formula("body")).withColumn("has_table", T.has_table("body"))
    return flagged.select(
        "p_partkey", "has_formula", "has_table", T.content_type("body", F.col("has_formula"), F.col("has_table")).alias("content_type"),
        T.article_no("body").alias("article_no"), T.clause_no("body").alias("clause_no"),
    )


def math_branches(spark: SparkSession, root: str) -> DataFrame:
    """Math repair of forms of all kinds, one per part."""
    return read_table(spark, root, "part").select("p_partkey", normalize_math_markdown(_form(MATHS)).alias("text"))


def front_matter_render(spark: SparkSession, root: str) -> DataFrame:
    """Pages rendered with their header."""
    fields = {"title": F.col("title"), "category": F.col("lang"), "source_url": F.col("url")}
    body = F.array_join("paragraphs", "\n\n")
    return I.page_fields(spark, root).select("page_id", F.md5(FM.render_front_matter(fields, body)).alias("text_md5"))


def history_window(spark: SparkSession, root: str) -> DataFrame:
    accepted, _ = conversation.question_and_history(read_table(spark, root, "conversations"))
    return accepted


def rejected_conversations(spark: SparkSession, root: str) -> DataFrame:
    _, rejected = conversation.question_and_history(read_table(spark, root, "conversations"))
    return rejected


def scope_resolution(spark: SparkSession, root: str) -> DataFrame:
    asked = I.title_questions(spark, root).withColumn("question_type", routing.question_type("question"))
    hits = titles.search_titles(asked.select("query_id", "question"), _web_catalog(spark, root), limit=5)
    scope = routing.resolve_scope(asked, hits)
    return scope.select("query_id", F.array_join("exact_scope_doc_ids", ",").alias("exact"), F.array_join("scoped_doc_ids", ",").alias("scoped"))


def _web_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    folder = new_folder(spark, "ready_data")
    builds.build_ready_data(spark, I.markdown(spark, root), folder, P.WEB)
    return builds.load_ready_data(spark, folder)


def routing_record(spark: SparkSession, root: str) -> DataFrame:
    record = plans.plan(I.title_questions(spark, root), _web_tables(spark, root))
    return record.select(
        "query_id", "question_type", "retrieval_strategy", _joined("evidence_plan.steps", "steps"),
        _joined("scoped_doc_ids", "scoped_doc_ids"), _joined("scoped_queries", "scoped_queries"), _joined("recommended_paths", "recommended_paths"),
    )


def verified_answers(spark: SparkSession, root: str) -> DataFrame:
    tables = _web_tables(spark, root)
    record = plans.plan(I.title_questions(spark, root), tables)
    manifest = sinks.corpus_manifest(I.markdown(spark, root))
    cited = (F.col("citation.id").alias("cited_id"), F.col("citation.path").alias("cited_path"))
    return plans.answer(record, tables, manifest).select("query_id", "answered_from", "answer", *cited)


def citation_audit(spark: SparkSession, root: str) -> DataFrame:
    """Answers that cite every turn number up to their own, sources for user turns only."""
    turns = read_table(spark, root, "conversations")
    answers = turns.filter(F.col("role") == "assistant").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), "conv_id",
        F.concat(F.col("text"), F.lit(" ["), F.col("turn").cast("string"), F.lit("] $x_{[9]}$ [0]")).alias("answer"),
    )
    sources = answers.join(turns.filter(F.col("role") == "user").select("conv_id", F.col("turn").alias("index")), "conv_id")
    return conversation.citation_audit(answers, sources).select("answer_id", _long("index").alias("index"))


def linked_citations(spark: SparkSession, root: str) -> DataFrame:
    """Every assistant turn closing with a known, an unknown and an in-math citation."""
    turns = read_table(spark, root, "conversations").filter(F.col("role") == "assistant")
    answer = F.concat(F.col("text"), F.lit(" [1] [2] $x_{[1]}$ [1](u)"))
    links = F.create_map(F.lit("1"), F.concat(F.lit("https://host.example/"), F.col("conv_id").cast("string")))
    return turns.select("conv_id", "turn", conversation.link_citations(answer, links).alias("answer"))


def _part_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Manifest entries from parts: category by type, titles with rule numbers for some."""
    number = F.col("p_partkey").cast("string")
    rule = F.col("p_type") == "ECONOMY"
    title = F.when(F.col("p_size") > 5, F.concat(F.lit("规则第"), number, F.lit("号："), "p_name")).otherwise(F.col("p_name"))
    return read_table(spark, root, "part").select(
        F.concat(F.lit("rules/"), number, F.lit(".md")).alias("path"), title.alias("title"),
        F.when(rule, "rules").otherwise("notices").alias("category"),
    )


def catalog_count(spark: SparkSession, root: str) -> DataFrame:
    asked = read_table(spark, root, "nation").select(
        F.col("n_nationkey").alias("query_id"), F.concat(F.col("n_name"), F.lit(" 监管规则一共有多少号规定？")).alias("question")
    )
    return E.catalog_count_answers(asked, _part_manifest(spark, root), language="zh").select("query_id", "answer", "text")


def catalog_evidence(spark: SparkSession, root: str) -> DataFrame:
    return E.catalog_evidence(_part_manifest(spark, root)).select("text", "score")


# --- quality and evaluation --------------------------------------------------------------
def artifact_counts(spark: SparkSession, root: str) -> DataFrame:
    names = ("documents", "benchmark", "labels", "pages", "conversations", "embeddings")
    return sinks.artifact_counts({n: spark.read.parquet(f"{root}/{n}.parquet") for n in names})


def field_validation(spark: SparkSession, root: str) -> DataFrame:
    """Missing fields of a catalog that has no alias column and NULL titles for odd sizes."""
    parts = read_table(spark, root, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("doc_id"), F.col("p_name").alias("path"),
        F.when(F.col("p_size") > 10, F.col("p_name")).alias("title"), F.col("p_type").alias("category"), F.col("p_brand").alias("summary_short"),
    )
    report = quality.missing_fields(parts, "doc_catalog", quality.REQUIRED_FIELDS["doc_catalog"], ["doc_id"])
    return report.select("artifact", "missing", _long("rows").alias("rows"), F.regexp_extract("first_key", "[0-9]+", 0).alias("first_key"))


def index_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Index fields the document table lacks."""
    docs = I.documents(spark, root).select("doc_id", F.col("n_chars").alias("token_count"))
    report = quality.index_metadata_report(docs)
    return report.select("artifact", "missing", _long("rows").alias("rows"))


def eval_hit_rate(spark: SparkSession, root: str) -> DataFrame:
    """Pass rate by language: is the page among the title hits of its own title."""
    fields = I.page_fields(spark, root)
    doc_id = F.concat("lang", F.lit("/"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".md"))
    cases = fields.select(F.col("page_id").alias("case_id"), F.col("title").alias("question"), doc_id.alias("expected_doc"), F.col("lang").alias("category"))
    hits = titles.search_titles(cases.select(F.col("case_id").alias("query_id"), "question"), _web_catalog(spark, root), limit=5)
    results = quality.evaluate_retrieval(cases, hits.select(F.col("query_id").alias("case_id"), F.col("rank").alias("ord"), "doc_id"))
    rates = quality.pass_rate(results, "category")
    return rates.select("category", *[_long(c).alias(c) for c in ("case_count", "passed", "failed")], "pass_rate")


def hit_previews(spark: SparkSession, root: str) -> DataFrame:
    hits = _turn_hits(spark, root).withColumn("retrieval_score", F.lit(1.0))
    return quality.hit_previews(hits, 2).select("query_id", _long("rank").alias("rank"), "path", "text_preview")


QUERIES = {
    f.__name__: f
    for f in (
        lexical_topk, scoped_search, keyword_search, question_scope_search, summary_search, section_search, formula_search,
        title_ladder, alias_resolution, vector_topk, unit_vectors, vector_dimensions, filename_matches, merge_hits,
        reranked_hits, domain_contexts, context_budget, answer_context, rendered_context, answer_sources, multi_query, multi_query_hits, hybrid_retrieval, json_lines_scan,
        stored_vectors,
        validity_report, validity_counts, normalized_text, text_snippets, char_gram_counts, content_terms, keywords_first40,
        token_counts, token_windows, embedding_texts, content_types, source_urls, canonical_ids, json_recovery, message_texts,
        heading_dedupe, leading_title, corpus_manifest, normalized_corpus, math_markdown, latex_repair, html_title,
        html_main_text, asset_references, dangling_assets, source_jobs, intro_paragraphs, catalog_build, title_aliases,
        catalog_fallback, line_blocks, structured_sections, formula_cards, section_embedding_inputs, mention_edges, related_ids,
        enriched_edges, relations_in_out, notice_traces, adjustment_traces, formula_explanations, formula_section_match,
        question_routing, routing_branches, content_branches, math_branches, front_matter_render, filename_hints, history_window, rejected_conversations, scope_resolution, routing_record,
        verified_answers, citation_audit, linked_citations, catalog_count, catalog_evidence, artifact_counts, field_validation,
        index_metadata, eval_hit_rate, hit_previews,
    )
}
