"""Cases that once gave wrong, lost or failing results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folia.functions.payload import _balanced
from folia.functions.text import focus_terms, headings
from folia.operators import evidence as E
from folia.operators import graph, vectors
from folia.plans import ready_data as builds
from folia.sources import files, shared, sinks


def _placed(spark, paths):
    raw = spark.createDataFrame([(p,) for p in paths], "path string")
    turns = sinks.number_within(
        raw.select("path", F.concat(F.lit("rules/"), F.substring_index("path", "/", -1)).alias("candidate")), "candidate", F.split("path", "/")
    )
    return {r["path"]: r["target_path"] for r in sinks._free_targets(turns).collect()}


def _one_by_one(paths):
    """Each file in path order takes the first free name."""
    taken, placed = set(), {}
    for path in sorted(paths, key=lambda p: p.split("/")):
        stem, _, extension = path.rsplit("/", 1)[-1].rpartition(".")
        n, target = 1, f"rules/{stem}.{extension}"
        while target in taken:
            n += 1
            target = f"rules/{stem}-{n}.{extension}"
        taken.add(target)
        placed[path] = target
    return placed


@pytest.mark.parametrize(
    "paths",
    [
        ["x/a.md", "y/a.md", "z/a-2.md"],
        ["a/a-2.md", "x/a.md", "y/a.md", "z/a.md"],
        ["p/a.md", "q/a.md", "r/a-2.md", "s/a-2.md", "t/a-3.md", "u/a.md"],
    ],
)
def test_no_two_documents_on_one_target(spark, paths):
    placed = _placed(spark, paths)
    assert len(set(placed.values())) == len(paths)
    assert placed == _one_by_one(paths)


def test_many_colliding_targets_stay_distinct(spark):
    rng = random.Random(4)
    paths = [f"d{i:03d}/{rng.choice(('a', 'a-2', 'a-3', 'a-2-2', 'b'))}.md" for i in range(60)]
    placed = _placed(spark, paths)
    assert len(placed) == len(set(placed.values())) == len(paths)


def test_relations_follow_the_scope(spark):
    edges = [("n1", "r1", "m", "s", 0), ("n2", "r1", "m", "s", 1), ("r1", "x", "m", "s", 2), ("r2", "r1", "m", "s", 3), ("r2", "y", "m", "s", 4)]
    table = spark.createDataFrame(edges, "source string, target string, relation string, evidence_section_id string, edge_ord int")
    scope = spark.createDataFrame([(1, 0, "r2"), (1, 1, "r1")], "query_id int, scope_ord int, doc_id string")

    def listed(limit):
        rows = graph.trace_in_scope_order(table, scope, limit=limit).orderBy("edge_rank").collect()
        return [(r["source"], r["target"]) for r in rows]

    # outgoing edges of the first document, then its incoming ones, then the next document's; cut at the end
    assert listed(9) == [("r2", "r1"), ("r2", "y"), ("r1", "x"), ("n1", "r1"), ("n2", "r1")]
    assert listed(3) == [("r2", "r1"), ("r2", "y"), ("r1", "x")]


def test_scanned_graph_can_be_traced(spark, tmp_path):
    edges = [{"source": "b", "target": "a", "relation": "z"}, {"source": "a", "target": "b", "relation": "y"}]
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [{"id": "a"}], "edges": edges}))
    _, scanned = files.scan_relation_graph(spark, str(tmp_path / "graph.json"))
    scope = spark.createDataFrame([(1, "a")], "query_id int, doc_id string")
    found = graph.trace_relations(scanned, scope).orderBy("edge_rank").collect()
    assert [r["source"] for r in found] == ["b", "a"]
    _, missing = files.scan_relation_graph(spark, str(tmp_path / "none.json"))
    assert graph.trace_relations(missing, scope).collect() == []


def test_json_artifacts_keep_their_schemas(spark, tmp_path):
    docs = spark.createDataFrame([("notices/a.md", "# A\n\nplain text of the notice.\n")], "path string, text string")
    for fmt in ("parquet", "json"):
        builds.build_ready_data(spark, docs, f"{tmp_path}/{fmt}", fmt=fmt)
    binary, text = (builds.load_ready_data(spark, f"{tmp_path}/{f}", f) for f in ("parquet", "json"))
    for name, table in binary.items():
        assert sorted(text[name].dtypes) == sorted(table.dtypes), name
        assert sorted(map(str, text[name].select(table.columns).collect())) == sorted(map(str, table.collect())), name


def test_ragged_and_null_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0, 0.0]), (4, None), (5, []), (6, [None, 1.0])]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = table.withColumnRenamed("vec_id", "query_id")
    found = vectors.vector_top_k(asked, table, key="vec_id", k=2, threshold=0.5).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in found) == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_cells_rule_out_vectors_and_lose_none(spark, monkeypatch, block_rows):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(12, 8))
    points = np.vstack([h + 0.15 * rng.normal(size=(40, 8)) for h in heads] + [heads[:3], heads[:3], np.zeros((2, 8)), -heads[:2]])
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, [1.0, 2.0]), (901, [2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = table.withColumnRenamed("vec_id", "query_id")
    unit = points / np.where(np.linalg.norm(points, axis=1) > 0, np.linalg.norm(points, axis=1), 1)[:, None]
    cosine = np.round(unit @ unit.T, 12)
    for threshold in (None, 0.9):
        got = {}
        for r in vectors.vector_top_k(asked, table, key="vec_id", k=4, threshold=threshold).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], pytest.approx(r["score"], abs=1e-11)))
        for q in range(len(points)):
            order = np.lexsort((np.arange(len(points)), -cosine[q]))[:4]
            assert got.get(q, []) == [(int(v), cosine[q, v]) for v in order if threshold is None or cosine[q, v] >= threshold]
        assert [v for v, _ in got[900]] == ([900, 901] if threshold is None else [900])
    report = vectors.comparison_report(asked, table, key="vec_id", k=4).first()
    assert report["all_pairs"] == len(points) ** 2 + 4 and report["compared"] < 0.6 * report["all_pairs"]


def test_queries_travel_once_to_a_region_and_copies_go_by_key(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    points = np.round(np.vstack([rng.normal(size=(400, 16)), np.tile(rng.normal(size=16), (60, 1))]), 6)
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id int, embedding array<double>")
    best, visits, _ = vectors._search(table.withColumnRenamed("vec_id", "query_id"), table, "vec_id", 3, None, "embedding")
    # once to the nearest cells and once to the others, however many cells there are
    assert visits.count() <= 2 * len(points)
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    cosine, found = np.round(unit @ unit.T, 12), {}
    for r in best.collect():
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    for q in range(len(points)):
        order = np.lexsort((np.arange(len(points)), -cosine[q]))[:3]
        assert [v for _, v in sorted(found[q])[:3]] == order.tolist()


def test_aliases_are_derived_once(spark):
    from folia import profiles as P
    from folia.operators import catalog as C

    docs = spark.createDataFrame([("en/a.md", "---\ntitle: One\n---\n\n# One\n"), ("en/--.md", "plain")], "path string, text string")
    found = C.alias_table(C.build_documents(docs, P.WEB))
    assert sorted((r["doc_id"], r["alias"]) for r in found.collect()) == [("en/a.md", "One"), ("en/a.md", "a")]
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]
    assert "Filter" not in below


def test_sections_are_cut_in_slices(spark, monkeypatch):
    from folia.operators import sections

    monkeypatch.setattr(sections, "SLICE_DOCUMENTS", 2)
    texts = ["# A\n\nfirst body text\n\n# B\n\nsecond body text", None, "", "plain body text", "# C\n\nthird body text"]
    docs = spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(texts)], "doc_id int, title string, body string").coalesce(1)
    got = {r["doc_id"]: [(list(s["heading_path"]), s["body"]) for s in r["sections"]] for r in sections.with_sections(docs, 100).collect()}
    assert got == {i: [(list(h), b) for h, b in sections.document_sections(f"t{i}", t or "", 100)] for i, t in enumerate(texts)}
    assert [len(got[i]) for i in range(5)] == [2, 0, 0, 1, 1]


def test_formula_queries_derive_no_summaries(spark):
    from folia.workload import queries

    cut = queries._sectioned(spark, "/root/testdata/sf0.001")
    assert not {"body", "keywords", "summary_short", "summary_structured", "focus_points"} & set(cut.columns)


def test_scoped_questions_leave_the_corpus_alone(spark, monkeypatch):
    from folia.operators import lexical as L

    def refuse(*_):
        raise AssertionError("the corpus is ranked for no question")

    monkeypatch.setattr(L, "ranked", refuse)
    spec = L.SearchSpec(ties=(("doc_id", True),), exact_boost=90.0, scope_boost=35.0)
    asked = spark.createDataFrame([(1, "blue whale")], "query_id bigint, question string")
    corpus = spark.createDataFrame([(7, "a blue whale", []), (8, "other", [])], "doc_id bigint, haystack string, keywords array<string>")
    scope = spark.createDataFrame([(1, 7)], "query_id bigint, doc_id bigint")
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in L.search_in_scope(asked, corpus, scope, spec, 5, ["doc_id"]).collect()] == [(1, 7, 185.0)]


def test_caps_are_gone(spark):
    title = "t：" + "：".join(f"part{i}" for i in range(30))
    many = "\n".join(f"# h{i}" for i in range(1500))
    row = spark.createDataFrame([(title, many)], "title string, body string").select(
        F.size(focus_terms("title")).alias("terms"), F.size(headings("body", None)).alias("headings")
    ).first()
    assert (row["terms"], row["headings"]) == (30, 1500)
    manifest = spark.createDataFrame([("a", "规则第12345678901号", "rules"), ("b", "规则第2号", "rules")], "path string, title string, category string")
    facts = E.numbered_rules(manifest).first()
    assert (int(facts["first_no"]), int(facts["last_no"])) == (2, 12345678901)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('a {"b": [1, "]}"]} c', '{"b": [1, "]}"]}'),
        ("[1} ] {2}", "[1} ]"),
        ('{ "x [1]" [2]', "[1]"),
        ('{"a [1]"', "[1]"),
        ("}{", None),
        ("{" * 20_000, None),
        ('{"q": "\\"}"} rest', '{"q": "\\"}"}'),
    ],
)
def test_first_balanced_part(text, found):
    assert _balanced(text) == found


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_json_errors_name_file_and_line_across_splits(spark, tmp_path):
    lines = [json.dumps({"a": i, "pad": "x" * (i % 90)}) if i % 7 else "" for i in range(3000)]
    (tmp_path / "good.jsonl").write_text("\n".join(lines))
    lines[2221] = '{"a": 1,'
    (tmp_path / "bad.jsonl").write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = files.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        for r in rows.collect():
            i = r["line_no"] - 1
            assert r["value"] == (lines[i] if "bad" in r["file"] or i != 2221 else json.dumps({"a": i, "pad": "x" * (i % 90)}))
        assert files.scan_json_lines(spark, str(tmp_path / "good.jsonl"), "a int").count() == sum(1 for i in range(3000) if i % 7)
        with pytest.raises(Exception, match=r"bad\.jsonl:2222"):
            files.scan_json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_short_formulas_meet_the_sections_that_hold_them(spark):
    texts = ["nothing here", "where R = a + b holds", "x=1", "", "a long formula alpha + beta * gamma / delta stands here"]
    sections = spark.createDataFrame(
        [(f"d#{i}", "d", i, "", f"h{i}", False, t) for i, t in enumerate(texts)],
        "section_id string, doc_id string, section_idx int, article_no string, section_heading string, has_formula boolean, text string",
    )
    asked = {"f1": "x=1", "f2": "R = a", "f3": "alpha + beta * gamma / delta", "f4": "q", "f5": ""}
    formulas = spark.createDataFrame(
        [(k, "d", "", "", v) for k, v in asked.items()],
        "formula_id string, doc_id string, article_no string, section_heading string, formula_text string",
    )
    found = {r["formula_id"]: r["section_id"] for r in graph.formula_sections(formulas, sections).collect()}
    assert found == {"f1": "d#2", "f2": "d#1", "f3": "d#4", "f4": "d#0", "f5": "d#0"}
