"""Every operator and stage over odd rows: NULLs, empty and very long texts, ties, repeats, no rows, clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from folia.llm import html_marginals, line_crf, line_templates, order_minhash, packing, pii, sharding, toxicity, weak_quality, winnowing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
PLAIN = "Quiet rivers carry silt toward the sea, and the delta grows a little every year while fishers mend nets. " * 4
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a", 60),
    (2, None, "en", None, None),
    (None, "a text without an id but with words enough to count", None, "a", 5),
    (3, "", None, "a", 0),
    (4, " \n\t ", "en", "a", 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (7, "!!! ### 1.2.3.4 éé \U0001f600 a@b.co +1 (417) 555-3020\x00z", "fr", "b", 50),
    (8, PLAIN, "en", "c", 1),
    (8, PLAIN, "en", "c", 1),
    (8, "the same id with another text", "en", "c", 1),
]
CLASHING = "class_id node component leaf mark hash h1 h2 key keys label row size shard slot grp bin law place step cell kept score".split()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.withColumns({c: F.lit("x") for c in CLASHING}).withColumn("labelled_id", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (8, 1, 0), (None, 1, 1), (5, None, None), (7, 0, 1), (7, 0, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "theta iota kappa"), (2, None), (None, "alpha beta"), (3, ""), (4, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (4, "no such words")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def op6(d, labels, items):
    return packing.best_fit(d)


OPERATORS = {
    "sharding": lambda d, labels, items: sharding.shard(d, 5),
    "pii": lambda d, labels, items: pii.find_personal_data(d),
    "weak_quality": lambda d, labels, items: weak_quality.score(d, weak_quality.train(d)),
    "near": lambda d, labels, items: order_minhash.near_duplicates(d),
    "toxicity": lambda d, labels, items: toxicity.score(d, toxicity.train(d, labels)),
    "line_crf": lambda d, labels, items: line_crf.quality(d, line_crf.train(d, labels)),
    "lines": lambda d, labels, items: line_templates.line_counts(d),
    "winnowing": lambda d, labels, items: winnowing.decontaminate(d, items),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(name, odd, clashing, none, labels, items):
    run = OPERATORS[name]
    expected = sorted([r[0] for r in ROWS], key=str)
    found = run(odd, labels, items)
    rows = found.collect()
    assert sorted([r["doc_id"] for r in rows], key=str) == expected
    assert sorted(map(str, run(clashing, labels, items).collect())) == sorted(map(str, rows))
    empty = run(none, labels, items)
    assert empty.collect() == [] and empty.dtypes == found.dtypes


@pytest.mark.parametrize("name", ["toxicity", "line_crf", "winnowing"])
def test_empty_side_tables(name, odd, labels, items):
    found = OPERATORS[name](odd, labels.limit(0), items.limit(0)).collect()
    assert len(found) == len(ROWS)
    if name == "winnowing":
        assert not any(r["contaminated"] for r in found)
    if name == "toxicity":
        assert all(r["score"] == 0 and r["predicted"] == 0 for r in found)


def test_packing_odd_rows(odd, clashing, none):
    rows = packing.best_fit(odd).collect()
    words = sum(len((r[1] or "").split()) for r in ROWS)
    assert sum(r["length"] for r in rows) == words
    assert {r["bin"] for r in rows if r["length"] == 0} == {None}
    assert sorted(map(str, packing.best_fit(clashing).select("doc_id", "piece", "length").collect())) == sorted(
        map(str, packing.best_fit(odd).select("doc_id", "piece", "length").collect())
    )
    assert packing.best_fit(none).collect() == []


def test_pages_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>no end"), (3, "u", "<article><p>a &amp; b" * 3), (4, "u", "<" * 5000), (4, "u", "<div " * 3000), (5, "u", "plain")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    found = html_marginals.extract(pages, html_marginals.train(pages)).collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["text"] for r in found if r["page_id"] in (1, 2)} == {""}
    assert [r["text"] for r in found if r["page_id"] == 5] == ["plain"]
    bare = {
        "plain text": "plain text", "plain <b>bold</b> text<p>para": "plain bold text\npara", "<nav><a href=x>Home</a></nav>bare words": "bare words",
        "<html><body><article><p>Good content here, long enough.</p></html>stray text": "Good content here, long enough.\nstray text", " \n <!-- none --> ": "",
    }
    model = html_marginals.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert {source: html_marginals.main_text(source, model) for source in bare} == bare
    empty = pages.limit(0)
    assert html_marginals.extract(empty, html_marginals.train(empty)).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_over_odd_rows(k, spark, odd, clashing, none, labels, items, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (odd, clashing, none):
        found = stage(spark, docs, str(tmp_path))
        rows = found.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns and found.dtypes == docs.dtypes
            assert len(rows) <= len(ROWS)
    assert rows == []


def test_defined_results_of_near_copies(odd):
    found = {(r["doc_id"], r["class_id"], r["class_size"]) for r in order_minhash.near_duplicates(odd).collect()}
    assert (5, 5, 2) in found and (6, 5, 2) in found and (2, 2, 1) in found and (8, 8, 2) in found and (8, 8, 1) in found
    kept = order_minhash.one_of_each_class(odd).collect()
    assert sorted([r["doc_id"] for r in kept], key=str) == sorted([1, 2, None, 3, 4, 5, 7, 8, 8], key=str)
