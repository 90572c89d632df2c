"""A quick selection of the SQL comparisons; ``oracle_check.py`` runs all of them."""

import os

import pytest
from oracle_check import compare, connect

from folia.workload.oracles import ORACLES
from folia.workload.queries import QUERIES

ROOT = "/root/testdata/sf0.001"
QUICK = (
    "lexical_topk", "vector_topk", "filename_matches", "context_budget", "token_windows", "heading_dedupe",
    "catalog_build", "line_blocks", "related_ids", "relations_in_out", "history_window", "citation_audit", "catalog_count",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(ROOT)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, ROOT, QUERIES[name], ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


BRANCHES = {
    "routing_branches": {
        "question_type": {"comparison", "catalog", "formula", "version", "compliance", "summary", "locate", "analysis"},
        "strategy": {"document", "section", "hybrid"},
        "is_count": {True, False},
        "needs_history": {True, False},
    },
    "content_branches": {
        "content_type": {"article_formula", "article_table", "article", "formula", "table", "threshold", "obligation", "semantic"},
        "clause_no": {None, "（一）"},
    },
}


@pytest.mark.parametrize("name", BRANCHES)
def test_every_branch_occurs_and_equals_sql(spark, db, name):
    assert compare(spark, db, ROOT, QUERIES[name], ORACLES[name]) is None
    for column, values in BRANCHES[name].items():
        assert {r[0] for r in db.execute(f"SELECT DISTINCT {column} FROM ({ORACLES[name]})").fetchall()} == values


@pytest.mark.parametrize("name", ["html_title", "structured_sections", "section_embedding_inputs"])
def test_open_references_and_long_sentences(spark, tmp_path, name):
    """Titles that end inside a reference, and a sentence over the token budget between short ones."""
    import duckdb

    long = "Word " * 700
    bodies = {"A &amp;&amp": "One. Two.", "B&am": "Short one. " + long + "end. Short two.", "C &quot;x": long + "end", "D &lt;&gt;": "Tail. " + long}
    rows = [(i, f"http://h.example/en/{i}", f"<title>{t}</title><h1>H{i}</h1><p>{b}</p>") for i, (t, b) in enumerate(bodies.items())]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert compare(spark, db, str(tmp_path), QUERIES[name], ORACLES[name]) is None


def test_title_keeps_an_open_reference(spark):
    from folia.operators.html import extract_articles

    pages = spark.createDataFrame([(1, "<title>B&am</title>"), (2, "<title>C&amp</title>"), (3, "<title>&eacute;</title>")], "page_id int, html string")
    assert {r["page_id"]: r["title"] for r in extract_articles(pages, "page_id").collect()} == {1: "B&am", 2: "C&", 3: "é"}
