"""Relation edges between documents, tracing, entity resolution and formula explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions import text as T
from folia.functions.formulas import formula_variables

KIND_RANK = {"rule": 0, "attachment": 1}


def document_order(doc_id) -> Column:
    """Sort key of the reading order: paths compare component by component."""
    return F.split(T.col(doc_id), "/")


def semantic_relation(category: Column, kind: str, text: Column, profile: P.Profile = P.REGULATORY_ZH) -> Column:
    """Typed relation a mention stands for, judged by the wording around it."""
    if kind == "attachment":
        return (
            F.when(category == "rules", "requires_attachment")
            .when(category == "notices", "applies_to_rule")
            .otherwise("mentions_attachment")
        )
    joined = F.replace(text, F.lit(" "), F.lit(""))
    from_notice = (
        F.when(T.has_any(joined, profile.adjust_markers), "adjusts_rule")
        .when(T.has_any(joined, profile.extend_markers), "extends_transition")
        .when(T.has_any(joined, profile.clarify_markers), "clarifies_formula")
        .otherwise("applies_to_rule")
    )
    elsewhere = F.when(T.has_any(joined, profile.apply_markers), "applies_to_rule").otherwise("mentions_rule")
    return F.when(category == "notices", from_notice).otherwise(elsewhere)


def relation_confidence(relation: Column) -> Column:
    return F.when(relation.isin(*P.SEMANTIC_RELATIONS), F.lit(0.72)).otherwise(F.lit(0.55))


def mention_targets(catalog: DataFrame, profile: P.Profile = P.REGULATORY_ZH) -> DataFrame:
    """(target_kind, target_number) to the last document in reading order that bears the number."""
    numbers = [
        F.struct(F.lit(kind).alias("target_kind"), T.first_match("title", pattern, 1).alias("target_number"))
        for kind, pattern in (profile.title_patterns or profile.mention_patterns).items()
    ]
    return (
        catalog.select("doc_id", F.inline(F.array(*numbers)))
        .filter(F.col("target_number").isNotNull())
        .groupBy("target_kind", "target_number")
        .agg(F.max_by("doc_id", document_order("doc_id")).alias("target"))
    )


def mention_candidates(sections: DataFrame, profile: P.Profile = P.REGULATORY_ZH) -> DataFrame:
    """One small row per mention; wording is judged here so no text travels with it."""

    def of_kind(kind: str, labels: str) -> Column:
        head, tail = profile.mention_labels[kind].split("{}")
        fallback = "mentions_rule" if kind == "rule" else "mentions_attachment"
        relation = semantic_relation(F.col("category"), kind, F.col("text"), profile)
        return F.transform(
            labels,
            lambda label, pos: F.struct(
                F.lit(kind).alias("target_kind"),
                label.alias("label"),
                F.substr(
                    label, F.lit(len(head) + 1), F.length(label) - F.lit(len(head) + len(tail))
                ).alias("target_number"),
                F.array_distinct(F.array(F.lit(fallback), relation)).alias("relations"),
                F.lit(KIND_RANK[kind]).alias("kind_rank"),
                pos.alias("pos"),
            ),
        )

    columns = {"rule": "mentions_rules", "attachment": "mentions_attachments"}
    both = F.concat(*[of_kind(kind, columns[kind]) for kind in profile.mention_patterns])
    return sections.select(
        F.col("doc_id").alias("source"),
        "section_idx",
        F.col("section_id").alias("evidence_section_id"),
        T.truncate("text", profile.edge_preview_chars).alias("evidence_text_preview"),
        F.col("publish_date").alias("effective_date"),
        F.inline(both),
    )


def resolve_mentions(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Typed, de-duplicated edges; unresolved mentions and self links are dropped.

    ``targets`` holds one row per number, so the join never multiplies.  A number that a third
    of the corpus mentions makes a hot key on the candidate side only, which the adaptive skew
    join splits.  Candidates and targets are plain equi-join sides; a small target table is
    broadcast by the optimiser from its real size.
    """
    resolved = candidates.join(targets, ["target_kind", "target_number"]).filter(F.col("source") != F.col("target"))
    typed = resolved.select(
        "source", "target", "evidence_section_id", "label", "evidence_text_preview", "effective_date",
        F.posexplode("relations").alias("relation_rank", "relation"),
        "section_idx", "kind_rank", "pos",
    )
    order = F.struct(
        document_order("source").alias("doc"), "section_idx", "kind_rank", "pos", "relation_rank"
    )
    first = typed.groupBy("source", "target", "relation", "evidence_section_id").agg(
        F.min(F.struct(order.alias("edge_ord"), "label", "evidence_text_preview", "effective_date")).alias("e")
    )
    return first.select(
        "source", "target", "relation",
        F.col("e.label").alias("label"),
        "evidence_section_id",
        F.col("e.evidence_text_preview").alias("evidence_text_preview"),
        F.col("e.effective_date").alias("effective_date"),
        relation_confidence(F.col("relation")).alias("confidence"),
        F.col("e.edge_ord").alias("edge_ord"),
    )


def document_nodes(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.col("doc_id").alias("id"), F.lit("document").alias("type"), "title", "category", "path")


def enrich_edges(edges: DataFrame, catalog: DataFrame, prefix: str = P.REGULATORY_ZH.doc_prefix) -> DataFrame:
    """Title and path of both ends; an unknown end gets an empty title and a default path."""
    for end in ("source", "target"):
        side = catalog.select(
            F.col("doc_id").alias(end), F.col("title").alias(f"{end}_title"), F.col("path").alias(f"{end}_path")
        )
        edges = (
            edges.join(side, end, "left")
            .withColumn(f"{end}_title", F.coalesce(f"{end}_title", F.lit("")))
            .withColumn(f"{end}_path", F.coalesce(f"{end}_path", F.concat(F.lit(prefix), F.col(end))))
        )
    return edges


def _first_edges(matched: DataFrame, limit: int | None, query: str) -> DataFrame:
    if limit is None:
        return matched
    order = F.row_number().over(Window.partitionBy(query).orderBy("edge_ord", "source", "target", "relation"))
    return matched.withColumn("edge_rank", order).filter(F.col("edge_rank") <= limit)


def trace_relations(
    edges: DataFrame,
    scope: DataFrame,
    *,
    direction: str = "both",
    relation: str | None = None,
    limit: int | None = 20,
    query: str = "query_id",
) -> DataFrame:
    """Edges that touch the documents in ``scope(query_id, doc_id)``, in edge order.

    ``both`` is a union of two equi-joins, so no OR condition forces a nested loop; an edge
    inside the scope is kept once.
    """
    wanted = edges if relation is None else edges.filter(F.col("relation") == relation)
    ends = {"out": ["source"], "in": ["target"], "both": ["source", "target"]}[direction]
    keys = scope.select(query, "doc_id").distinct()
    parts = [
        wanted.join(keys.withColumnRenamed("doc_id", end), end).select(query, *edges.columns) for end in ends
    ]
    matched = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Scope may hold several ends of one edge; the copies are identical rows.
    unique = matched.dropDuplicates([query, "source", "target", "relation", "evidence_section_id"])
    return _first_edges(unique, limit, query)


def trace_in_scope_order(
    edges: DataFrame, scope: DataFrame, *, limit: int, leg: int = 10, query: str = "query_id"
) -> DataFrame:
    """First ``limit`` edges of each question in the order of its ``scope(query_id, doc_id, scope_ord)``.

    A scoped document gives its outgoing edges and then its incoming ones, ``leg`` (or ``limit``, if larger) of
    each in edge order; the list is cut after that.  An edge between two scoped documents is listed at its first place.
    """
    keep = max(leg, limit)
    legs = []
    for number, end in enumerate(("source", "target")):
        found = edges.join(scope.select(query, F.col("doc_id").alias(end), "scope_ord"), end).withColumn("leg", F.lit(number))
        order = Window.partitionBy(query, "scope_ord").orderBy("edge_ord", "source", "target", "relation")
        legs.append(found.withColumn("leg_rank", F.row_number().over(order)).filter(F.col("leg_rank") <= keep))
    place = F.struct("scope_ord", "leg", "leg_rank")
    edge = [query, "source", "target", "relation", "evidence_section_id"]
    listed = legs[0].unionByName(legs[1])
    first = listed.withColumn("n", F.row_number().over(Window.partitionBy(*edge).orderBy(place))).filter("n = 1")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(place))
    return first.withColumn("edge_rank", rank).filter(F.col("edge_rank") <= limit).select(query, *edges.columns, "edge_rank")


def trace_notices(
    edges: DataFrame, scope: DataFrame, catalog: DataFrame, *, limit: int | None = 20, query: str = "query_id"
) -> DataFrame:
    """Edges from notices into the scoped rules."""
    notices = catalog.filter(F.col("category") == "notices").select(F.col("doc_id").alias("source"))
    into = trace_relations(edges, scope, direction="in", limit=None, query=query)
    return _first_edges(into.join(notices, "source", "left_semi"), limit, query)


def trace_adjustments(edges: DataFrame, scope: DataFrame, *, limit: int | None = 20, query: str = "query_id") -> DataFrame:
    """Typed edges issued by the scoped notices."""
    typed = edges.filter(F.col("relation").isin(*P.SEMANTIC_RELATIONS, "mentions_rule"))
    return trace_relations(typed, scope, direction="out", limit=limit, query=query)


# --- formulas ----------------------------------------------------------------------------
def find_formula(formulas: DataFrame, ids: DataFrame) -> DataFrame:
    """Formula cards of ``ids(formula_id)`` with freshly cleaned variables."""
    return formulas.join(ids.distinct(), "formula_id", "left_semi").withColumn(
        "variables", formula_variables("formula_text")
    )


def formula_sections(formulas: DataFrame, sections: DataFrame) -> DataFrame:
    """Best section per formula: same article, else same heading with math, else text, else first.

    The first two rules and the last are equi-joins against one row per key, so a document with
    very many sections does not multiply its formulas; formulas that both rules miss meet the
    sections of their document by the first characters of their text, all of them where it is short.
    """
    spot = F.min(F.struct("section_idx", "section_id"))
    by_article = sections.filter(F.col("article_no") != "").groupBy("doc_id", "article_no").agg(spot.alias("a"))
    by_heading = (
        sections.filter((F.col("section_heading") != "") & F.col("has_formula"))
        .groupBy("doc_id", "section_heading")
        .agg(spot.alias("h"))
    )
    keyed = (
        formulas.select("formula_id", "doc_id", "article_no", "section_heading", "formula_text")
        .join(by_article, ["doc_id", "article_no"], "left")
        .join(by_heading, ["doc_id", "section_heading"], "left")
        .withColumn("spot", F.coalesce("a.section_id", "h.section_id"))
    )
    head = F.left(T.norm_text("formula_text"), F.lit(80))
    missed = keyed.filter(F.col("spot").isNull() & (head != "")).select("formula_id", "doc_id", head.alias("head"))
    by_text = _sections_with_head(missed, sections).groupBy("formula_id").agg(spot.alias("t"))
    first = sections.groupBy("doc_id").agg(spot.alias("f"))
    return (
        keyed.select("formula_id", "doc_id", "spot")
        .join(by_text, "formula_id", "left")
        .join(first, "doc_id")
        .select("formula_id", F.coalesce("spot", "t.section_id", "f.section_id").alias("section_id"))
    )


#: Formulas and sections meet on the first characters of the formula, up to this many.
HEAD_GRAM = 12


def _sections_with_head(missed: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows of ``missed(formula_id, doc_id, head)`` with the sections of their document that contain the head.

    The length of the shared run follows the head: a head of fewer than twelve characters is its own run, a longer one
    gives its first twelve.  A section gives its distinct runs of those lengths only that heads of its document have,
    and meets the heads that it shares one with; containment is checked after.
    """
    heads = missed.withColumn("size", F.least(F.length("head"), F.lit(HEAD_GRAM))).withColumn("run", F.left("head", "size"))
    sizes = heads.groupBy("doc_id").agg(F.collect_set("size").alias("sizes"))
    texts = sections.join(sizes, "doc_id").withColumn("norm", T.norm_text("text")).withColumn("size", F.explode("sizes"))
    last = F.length("norm") - F.col("size") + 1
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("norm"), i, F.col("size")))
    keyed = texts.filter(last >= 1).select("doc_id", "size", "section_idx", "section_id", "norm", F.explode(F.array_distinct(runs)).alias("run"))
    met = heads.join(keyed, ["doc_id", "size", "run"])
    return met.filter(F.contains("norm", "head")).select(*missed.columns, "section_idx", "section_id", "norm")


def explain_formulas(formulas: DataFrame, sections: DataFrame, *, lines_per_variable: int = 2) -> DataFrame:
    """Variables of each formula with the lines of its section that name them."""
    chosen = formula_sections(formulas, sections)
    text = F.coalesce("section_text", F.lit(""))

    def naming(rows: Column, forms: Column) -> Column:
        return F.filter(rows, lambda r: F.exists(forms, lambda v: F.contains(r["norm"], v)))

    def evidence(variable: Column, rows: Column) -> Column:
        spellings = F.array(variable, F.replace(variable, F.lit("_"), F.lit("")), F.substring_index(variable, "_", 1))
        forms = F.filter(F.transform(spellings, T.norm_text), lambda v: v != "")
        named = T.let(forms, lambda f: naming(rows, f))
        return F.transform(F.slice(named, 1, lines_per_variable), lambda r: T.truncate(r["line"], 180))

    shown = F.filter(F.transform(T.lines(text), lambda r: F.btrim(r, F.lit(" -\t"))), lambda r: r != "")
    formed = F.transform(shown, lambda r: F.struct(r.alias("line"), T.norm_text(r).alias("norm")))

    def explain(rows: Column) -> Column:
        return F.transform(
            "variables", lambda v: F.struct(v.alias("variable"), evidence(v, rows).alias("evidence"))
        )

    cleaned = formulas.withColumn("variables", formula_variables("formula_text"))
    return (
        cleaned.join(chosen, "formula_id", "left")
        .join(sections.select("section_id", F.col("text").alias("section_text")), "section_id", "left")
        .select(
            "formula_id", "doc_id", "title", "path", "article_no", "section_heading", "formula_text", "variables",
            T.let(formed, explain).alias("variable_explanations"),
            F.when(text != "", T.truncate(text, 700)).otherwise("").alias("applicability_evidence"),
            "section_id",
        )
    )
