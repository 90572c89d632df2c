"""The registered queries, and the whole pipeline against its stages one by one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
import corpus_pipeline
from oracle_check import compare, connect

ROOT = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_sql_equivalents(spark):
    from folia.llm.queries import ORACLES, QUERIES

    db = connect(ROOT)
    for name, sql in ORACLES.items():
        assert compare(spark, db, ROOT, QUERIES[name], sql) is None


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage got and returned."""
    docs, found = spark.read.parquet(f"{ROOT}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, ROOT).cache()
        found.append((docs, after))
        docs = after
    return found


def test_stages_keep_columns_and_rows_are_their_inputs(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns
        ids = [r["doc_id"] for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in before.collect()}


def test_decisions_take_effect(spark, steps):
    from folia.llm import order_minhash, winnowing

    _, deduped = steps[2]
    assert all(r["class_size"] == 1 for r in order_minhash.near_duplicates(deduped).collect())
    _, clean = steps[3]
    benchmark = spark.read.parquet(f"{ROOT}/benchmark.parquet")
    assert not any(r["contaminated"] for r in winnowing.decontaminate(clean, benchmark).collect())
    assert clean.count() > 0


def test_run_applies_all_stages(spark, steps):
    packed = corpus_pipeline.run(spark, ROOT)
    key = ("doc_id", "piece", "start", "length")
    assert sorted(map(tuple, packed.select(*key).collect())) == sorted(map(tuple, steps[-1][1].select(*key).collect()))
