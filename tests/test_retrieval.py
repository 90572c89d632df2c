import pytest
from pyspark.sql import functions as F

from folia.operators import fusion, vectors
from folia.operators.filenames import filename_hits
from folia.operators.containment import contained_pairs
from folia.operators.lexical import SECTION_SPEC, Bonus, SearchSpec, search, search_in_scope, search_sections
from folia.operators.titles import resolve_documents, search_titles
from folia.plans.retrieval import retrieve

HITS = "query_id int, ord int, path string, text string, token_count int, source_kind string, retrieval_score double"


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, start=1)), "query_id int, question string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- lexical -----------------------------------------------------------------------------
def brute_score(query, text, keywords, boost):
    import re

    def norm(x):
        return re.sub(r"[^0-9A-Za-z一-鿿]+", "", x).lower()

    def grams(x):
        return {x[i : i + n] for n in (2, 3, 4) for i in range(len(x) - n + 1)}

    q, h = norm(query), norm(text)
    if not q or not h:
        return 0.0
    score = boost if q in h else 0.0
    if grams(q):
        score += 60.0 * len(grams(q) & grams(h)) / len(grams(q))
    hits = [k for k in keywords if norm(k) and norm(k) in q][:5]
    return score + min(40.0, 8.0 * len(hits))


@pytest.mark.parametrize("sent, hot", [(1_000_000, 200_000), (0, 200_000), (0, 3)])
def test_search_matches_brute_force(spark, monkeypatch, sent, hot):
    """With the questions sent to the texts, met on the token, and met on tokens that are dealt over parts."""
    import random

    from folia.operators import containment

    monkeypatch.setattr(containment, "SENT_TOKENS", sent)
    monkeypatch.setattr(containment, "HOT_TEXTS", hot)
    rng = random.Random(7)
    words = ["资本", "规则", "risk", "a", "附件1", "最低", "x y", "model"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 6))), rng.sample(words, 3)) for i in range(60)]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3)))) for i in range(12)]
    corpus = spark.createDataFrame(texts, "doc_id int, haystack string, keywords array<string>").repartition(3)
    spec = SearchSpec(ties=(("doc_id", True),), exact_boost=90.0)
    q = spark.createDataFrame(asked, "query_id int, question string")
    want = {}
    for qid, text in asked:
        scored = sorted(((-round(brute_score(text, h, k, 90.0), 4), d) for d, h, k in texts))
        want[qid] = [(d, -s) for s, d in scored if s][:4]
    got = {}
    for r in search(q, corpus, spec, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert got == {k: v for k, v in want.items() if v}


def test_bonuses_alone_bring_texts(spark):
    """Texts that share no gram with the question rank by their bonuses, ties by key, and never more than k."""
    spec = SearchSpec(
        ties=(("doc_id", True),), exact_boost=90.0,
        bonuses=(Bonus("kind", "q_kind", 30.0, "kind"), Bonus("number", "q_number", 20.0, "number")),
    )
    rows = [(i, "zzz" if i % 5 else "abcdef", i % 3 == 0 or None, str(i % 4), []) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id int, haystack string, kind boolean, number string, keywords array<string>")
    asked = spark.createDataFrame(
        [(1, "abcdefg", True, "1"), (2, "qqqq", True, None), (3, "qqqq", None, "2"), (4, "qqqq", None, None), (5, "", True, "3")],
        "query_id int, question string, q_kind boolean, q_number string",
    )
    for k in (2, 7, 100):
        got = {}
        for r in search(asked, corpus, spec, k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        want = {}
        for q in asked.collect():
            scored = []
            for d, text, kind, number, _ in rows:
                score = brute_score(q["question"], text, [], 90.0) + 30.0 * bool(kind and q["q_kind"]) + 20.0 * (number == q["q_number"])
                scored.append((-round(score, 4), d))
            if found := [(d, -s) for s, d in sorted(scored) if s][:k]:
                want[q["query_id"]] = found
        assert got == want


def test_contained_pairs(spark):
    needles = ["a", "ab", "abc", "abcd", "bcdef", "资本规则", "", "zz", "abcabcabc", "😀x"]
    hays = ["", "abcdef", "xxabcabcabcx", "最低资本规则", "z", "y😀xy", "a" * 300]
    found = contained_pairs(
        spark.createDataFrame([(n,) for n in needles * 2], "needle string"), spark.createDataFrame(list(enumerate(hays)), "key int, hay string")
    )
    assert sorted(map(tuple, found.collect())) == sorted((n, i) for n in needles if n for i, h in enumerate(hays) if n in h)


SECTIONS = [
    ("d#section-1", "d", 1, "第一条", "最低资本 概述", 10, False),
    ("d#section-2", "d", 2, "第二条", "最低资本 公式 $$x$$", 20, True),
    ("e#section-1", "e", 1, None, "最低资本 公式 $$x$$", 5, True),
]


def section_table(spark):
    base = spark.createDataFrame(
        SECTIONS, "section_id string, doc_id string, section_idx int, article_no string, text string, token_count int, has_formula boolean"
    )
    none = F.slice(F.array(F.lit("")), 1, 0)
    return base.select(
        "*", F.lit("T").alias("title"), F.lit("h").alias("section_heading"), F.lit(None).cast("string").alias("clause_no"),
        F.lit("semantic").alias("content_type"), none.alias("keywords"), none.alias("mentions_rules"), none.alias("mentions_attachments"),
    )


def test_section_bonuses_and_ties(spark):
    asked = questions(spark, "第二条最低资本公式", "最低资本公式")
    got = search_sections(asked, section_table(spark), limit=3).orderBy("query_id", "rank")
    by_query = {}
    for r in got.collect():
        by_query.setdefault(r["query_id"], []).append((r["section_id"], r["reason"]))
    assert by_query[1][0][0] == "d#section-2" and "条文编号命中" in by_query[1][0][1]
    # Equal scores: both hold formulas, the shorter one first.
    assert [s for s, _ in by_query[2]] == ["e#section-1", "d#section-2", "d#section-1"]
    assert "公式型 section" in by_query[2][0][1]


def test_scope_limits_and_falls_back(spark):
    from folia.operators.lexical import section_corpus

    asked = questions(spark, "最低资本公式", "最低资本公式")
    scope = spark.createDataFrame([(1, "d")], "query_id int, doc_id string")
    got = search_in_scope(asked, section_corpus(section_table(spark)), scope, SECTION_SPEC, 5, ["section_id"])
    found = {q: sorted(r["section_id"] for r in got.collect() if r["query_id"] == q) for q in (1, 2)}
    assert found == {1: ["d#section-1", "d#section-2"], 2: ["d#section-1", "d#section-2", "e#section-1"]}
    free, scoped = (
        got.filter((F.col("query_id") == q) & (F.col("section_id") == "d#section-2")).first()["score"] for q in (2, 1)
    )
    assert scoped == pytest.approx(free + 45.0)


# --- titles ------------------------------------------------------------------------------
CATALOG = [
    ("rules/a.md", "保险公司偿付能力监管规则第2号：最低资本", "rules", ["保险公司偿付能力监管规则第2号：最低资本", "规则第2号", "监管规则"], ["最低资本"]),
    ("rules/b.md", "保险公司偿付能力监管规则第12号：风险管理", "rules", ["保险公司偿付能力监管规则第12号：风险管理", "规则第12号", "监管规则"], ["风险管理"]),
    ("attachments/c.md", "附件4：压力测试", "attachments", ["附件4：压力测试", "附件4", "附件"], ["压力测试", "情景"]),
]


def catalog(spark):
    return spark.createDataFrame(
        CATALOG, "doc_id string, title string, category string, aliases array<string>, keywords array<string>"
    ).withColumns({"path": F.concat(F.lit("kb/"), F.col("doc_id")), "summary_short": F.lit("概要")})


@pytest.mark.parametrize(
    "question, doc, score, reason",
    [
        ("规则第2号讲什么", "rules/a.md", 220.0, "规则编号命中：第2号"),
        ("附件4是什么", "attachments/c.md", 220.0, "附件编号命中：附件4"),
        ("最低资本由什么组成", "rules/a.md", 90.0, "标题主题命中：最低资本"),
        ("偿付能力监管规则第12", "rules/b.md", 150.0, "标题包含查询"),
        ("有哪些情景", "attachments/c.md", 10.0, "标题关键词相关"),
    ],
)
def test_title_ladder(spark, question, doc, score, reason):
    best = search_titles(questions(spark, question), catalog(spark)).filter("rank = 1").first()
    assert (best["doc_id"], best["score"], best["reason"]) == (doc, score, reason)


def test_generic_alias_gives_nothing(spark):
    assert search_titles(questions(spark, "监管规则"), catalog(spark)).filter("reason like '%别名%'").count() == 0
    assert search_titles(questions(spark, "？？"), catalog(spark)).count() == 0


def test_resolution(spark):
    got = resolve_documents(questions(spark, "./rules/b.md", "规则第2号", "附件4：压力测试", ""), catalog(spark), limit=1)
    assert {r["query_id"]: (r["doc_id"], r["score"]) for r in got.collect()} == {
        1: ("rules/b.md", None),
        2: ("rules/a.md", 200.0),
        3: ("attachments/c.md", 200.0),
    }


def test_resolution_meets_equal_texts_and_questions_once(spark, monkeypatch):
    """Copies of entries and of questions are searched once and still all stand in the result, the first ids first."""
    from folia.operators import lexical

    names = ["supplier 17", "supplier 18", "customer 17", "peru"]
    entries = spark.createDataFrame(
        [(f"{n}/{i:02d}", n, [n], "places") for n in names for i in range(12)], "doc_id string, title string, aliases array<string>, summary_short string"
    )
    asked = [(i, ("about supplier 17", "About  Supplier 17!", "peru", "er 17")[i % 4]) for i in range(40)]
    met, ranked = [], lexical.ranked

    def counted(texts, asked, *rest):
        met.append((texts.count(), asked.count()))
        return ranked(texts, asked, *rest)

    monkeypatch.setattr(lexical, "ranked", counted)
    got = resolve_documents(spark.createDataFrame(asked, "query_id int, question string"), entries, limit=5).collect()
    assert met == [(4, 3)]
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert sorted(found) == list(range(40))
    first = {0: ("supplier 17", 120.0), 1: ("supplier 17", 120.0), 2: ("peru", 200.0)}
    for i in range(40):
        if i % 4 in first:
            name, score = first[i % 4]
            assert found[i] == [(f"{name}/{j:02d}", score) for j in range(5)]
        else:
            # inside two names: equal scores go by id over both
            assert found[i] == [(f"customer 17/{j:02d}", 140.0) for j in range(5)]


def test_names_inside_match_brute_force(spark):
    import random

    from folia.operators.containment import names_inside

    rng = random.Random(11)
    names = ["".join(rng.choices("ab规😀", k=rng.randint(0, 7))) for _ in range(60)]
    hays = ["".join(rng.choices("ab规😀", k=rng.randint(0, 25))) for _ in range(40)]
    hays = list(enumerate(hays)) + [(40, None)]
    got = names_inside(spark.createDataFrame([(n,) for n in names], "needle string"), spark.createDataFrame(hays, "key int, hay string")).collect()
    wanted = {(n, k) for n in names if n for k, hay in hays if hay and n in hay}
    assert sorted((r["needle"], r["key"]) for r in got) == sorted(wanted)


# --- vectors and file names --------------------------------------------------------------
def test_vector_top_k(spark):
    table = spark.createDataFrame(
        [(1, [3.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [1.0]), (5, None), (6, [2.0, 2.0])],
        "vec_id int, embedding array<float>",
    )
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id int, embedding array<float>")
    got = vectors.vector_top_k(asked, table, key="vec_id", k=3, threshold=0.1).orderBy("rank")
    assert rows(got, "vec_id", "rank") == [(1, 1), (2, 2), (6, 3)]
    assert got.first()["score"] == pytest.approx(1.0)
    report = {r["usable"]: r["vectors"] for r in vectors.dimension_report(table, 2).collect()}
    assert report == {True: 4, False: 2}


def test_common_runs_match_brute_force(spark):
    import random

    from folia.operators.filenames import common_runs

    rng = random.Random(5)
    texts = ["".join(rng.choices("ab规", k=rng.randint(0, 14))) for _ in range(40)]
    stems = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, s_norm string")
    found = {(r["path"], r["query_id"]): r["length"] for r in common_runs(stems, spark.createDataFrame(list(enumerate(texts)), "query_id int, q_norm string")).collect()}

    def brute(a, b):
        return max((j - i for i in range(len(a)) for j in range(i + 4, len(a) + 1) if a[i:j] in b), default=0)

    assert found == {(f"p{i}", q): n for i, a in enumerate(texts) for q, b in enumerate(texts) if (n := brute(a, b))}


def test_filename_hits(spark):
    docs = spark.createDataFrame(
        [(1, "r/规则第2号：最低资本.md"), (2, "r/规则第2号：最低资本.md"), (3, "r/规则第2号：最低资本.md"), (4, "r/规则第3号：最低资本.md"), (5, "r/说明.md")],
        "row_id int, path string",
    )
    got = filename_hits(questions(spark, "规则第2号里最低资本"), docs, order="row_id").orderBy("row_id")
    # The other number is excluded; hints 规则第2号 counts once; the longest shared run is 最低资本.
    assert rows(got, "row_id", "retrieval_score") == [(1, pytest.approx(2.05)), (2, pytest.approx(2.05))]


# --- fusion ------------------------------------------------------------------------------
def test_merge_keeps_first_row_and_best_score(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a", "t", 5, "document", 0.2), (1, 2, "a", "t", 9, "section", 0.7), (1, 3, "b", "t", 1, None, 0.1)], HITS
    )
    got = {r["path"]: (r["token_count"], r["retrieval_score"]) for r in fusion.merge_hits(hits).collect()}
    assert got == {"a": (5, 0.7), "b": (1, 0.1)}


def test_rerank_prefers_domain_terms(spark):
    hits = spark.createDataFrame(
        [(1, 1, "x.md", "generic text", 1, None, 0.85), (1, 2, "risk.md", "insurance risk governance controls", 1, None, 0.80)], HITS
    )
    got = fusion.rerank(hits, questions(spark, "insurance risk governance")).orderBy("rank")
    assert rows(got, "path") == [("risk.md",), ("x.md",)]
    assert got.first()["domain_terms_matched"] == ["controls", "governance", "insurance", "risk"]
    alone = fusion.rerank(hits.limit(1), questions(spark, "insurance"))
    assert alone.first()["rerank_score"] is None


@pytest.mark.parametrize("tokens, budget, cap, want", [
    ([60, 50, 30], 100, None, [1, 3]),
    ([150], 100, None, [1]),
    ([10, 10, 10, 10], 100, 2, [1, 2]),
    ([40, 40, 40, 20, 20, 1], 100, None, [1, 2, 4]),
    ([100, 1], 100, None, [1]),
])
def test_budget(spark, tokens, budget, cap, want):
    hits = spark.createDataFrame([(1, i, "t", n) for i, n in enumerate(tokens, 1)], "query_id int, rank int, text string, token_count int")
    kept = fusion.within_budget(hits, F.lit(budget), max_hits=None if cap is None else F.lit(cap))
    assert sorted(r["rank"] for r in kept.collect()) == want


def test_answer_hits_mixed_and_alone(spark):
    data = [(1, i, f"d{i}", f"text {i}", 10, "document", 1.0 - i / 100) for i in range(1, 6)]
    data += [(1, 10 + i, f"s{i}", f"part {i}", 10, "section", 0.9 - i / 100) for i in range(1, 9)]
    data += [(2, i, f"d{i}", f"text {i}", 60, "document", 1.0 - i / 100) for i in range(1, 6)]
    hits = spark.createDataFrame(data, HITS)
    got = fusion.answer_hits(hits, questions(spark, "q one", "q two"), doc_tokens=130, section_tokens=1000)
    found = {q: sorted(r["path"] for r in got.collect() if r["query_id"] == q) for q in (1, 2)}
    assert found == {1: ["d1", "d2", "d3", "s1", "s2", "s3", "s4", "s5", "s6"], 2: ["d1", "d2"]}
    assert sorted(r["rank"] for r in got.filter("query_id = 1").collect()) == list(range(1, 10))


def test_render_and_sources(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b.md", "B", "document", None), (1, 5, "a.md", " A ", "section", "第一章")],
        "query_id int, rank int, path string, text string, source_kind string, section_heading string",
    )
    assert fusion.render_context(hits).first()["context"] == "[1] b.md\nB\n\n[2] a.md | 第一章\n A "
    got = fusion.source_list(hits, "https://h").orderBy("index")
    assert rows(got, "index", "url", "snippet", "heading") == [(1, "https://h/b.md", "B", "b.md"), (2, "https://h/a.md", "A", "a.md | 第一章")]


def test_sub_queries(spark):
    df = spark.createDataFrame([([" - A b ", "a B", "", "c", "d", "e", "f"],)], "q array<string>")
    assert df.select(fusion.normalize_queries(df.q)).first()[0] == ["A b", "c", "d", "e"]
    hits = spark.createDataFrame(
        [(1, 0, 1, "a", "t"), (1, 0, 2, "b", "t"), (1, 1, 1, "b", "t"), (1, 2, 1, "c", "t")],
        "question_id int, query_ord int, rank int, path string, text string",
    )
    subs = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z")], "question_id int, query_ord int, query string")
    history = fusion.retrieval_history(subs, fusion.first_seen_hits(hits)).orderBy("query_ord")
    assert rows(history, "new_hits", "paths") == [(2, ["a", "b"]), (0, []), (1, ["c"])]


def test_retrieve_by_strategy(spark):
    import random

    rng = random.Random(3)

    def index(kind, n):
        return spark.createDataFrame(
            [(i, [rng.random(), rng.random()], f"{kind}/{i}.md", "T", f"{kind} text {i}", 5, kind, f"h{i}") for i in range(n)],
            "row_id int, embedding array<double>, path string, title string, text string, token_count int, source_kind string, section_heading string",
        )

    asked = spark.createDataFrame(
        [(1, "主要内容是什么", [1.0, 0.2]), (2, "取值多少", [1.0, 0.2]), (3, "两者的关系", [1.0, 0.2])],
        "query_id int, question string, embedding array<double>",
    )
    documents, sections = index("document", 30), index("section", 40)
    got = retrieve(asked, documents, sections).collect()
    counts = {q: [sum(r["query_id"] == q and r["source_kind"] == kind for r in got) for kind in ("document", "section")] for q in (1, 2, 3)}
    assert counts[1] == [4, 0]
    assert sum(counts[2]) == 8 and counts[2][0] <= 1
    assert sum(counts[3]) == 8 and counts[3][0] <= 3 and counts[3][1] <= 6
    none = retrieve(asked, documents, sections.limit(0)).groupBy("query_id").count()
    assert {r["query_id"]: r["count"] for r in none.collect()} == {1: 4, 2: 2, 3: 4}


def test_retrieval_groups_no_union(spark, monkeypatch):
    """No window or group over a union relies on how its two sides are dealt, which adaptive reads change one by one."""
    from folia.plans import retrieval

    rows = [(i, [1.0, i / 50], f"a/{i}.md", "T", f"text {i}", 5, "document", "h") for i in range(20)]
    index = spark.createDataFrame(
        rows, "row_id int, embedding array<double>, path string, title string, text string, token_count int, source_kind string, section_heading string"
    )
    asked = spark.createDataFrame([(1, "取值多少", [1.0, 0.2]), (2, "两者的关系", [1.0, 0.2])], "query_id int, question string, embedding array<double>")
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in held}
    met, merge = [], retrieval.merge_hits

    def watched(hits):
        met.append(hits._jdf.queryExecution().executedPlan().toString())
        return merge(hits)

    monkeypatch.setattr(retrieval, "merge_hits", watched)
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        retrieve(asked, index, index)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(met) == 3
    for plan in met:
        assert "Union" not in plan


def test_blocks_keep_ties_and_batches(spark, monkeypatch):
    """Many blocks, several batches of questions, equal texts and repeated questions give the ranking of one block."""
    import numpy as np

    from folia.operators import blocks

    texts = [(i, "abcd efgh"[: 3 + i % 7], ["gh"] * (i % 3)) for i in range(120)]
    corpus = spark.createDataFrame(texts, "doc_id int, haystack string, keywords array<string>")
    asked = spark.createDataFrame([(i, ("abcdefgh", "efg", "h", "")[i % 4]) for i in range(40)], "query_id int, question string")
    spec = SearchSpec(ties=(("doc_id", False),), exact_boost=90.0)
    want = {}
    for q in asked.collect():
        scored = sorted((-round(brute_score(q["question"], h, k, 90.0), 4), -d) for d, h, k in texts)
        want[q["query_id"]] = [(-d, -s) for s, d in scored if s][:5]
    for size in (16_384, 7):
        monkeypatch.setattr(blocks, "BLOCK_TEXTS", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if size > 7 else 3)
        try:
            got = {}
            for r in search(asked, corpus, spec, 5).orderBy("query_id", "rank").collect():
                got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {k: v for k, v in want.items() if v}
    assert blocks.rounded(np.array([0.00625, 1.5, 0.46875])).tolist() == [0.0062, 1.5, 0.4688]


def test_pairs_of_a_search_are_not_rows(spark):
    """No join on tokens: the rows that a search shuffles grow with questions and blocks, not with the pairs that share a token."""
    corpus = spark.range(400).selectExpr("id AS doc_id", "'the same words' AS haystack", "array('same') AS keywords")
    asked = spark.range(300).selectExpr("id AS query_id", "concat('the same words ', id) AS question")
    found = search(asked, corpus, SearchSpec(ties=(("doc_id", True),), exact_boost=90.0), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode(tokens" not in plan
    assert found.count() == 600


def test_title_ladder_with_repeated_titles_and_questions(spark, monkeypatch):
    """Many equal titles and questions: the first entries by title and id, rungs before shared keywords, whatever the blocks."""
    from folia.operators import blocks

    rows = [(f"d{i:03d}", "alpha：beta words" if i % 2 else "gamma words", ["alpha：beta words"] if i % 4 == 1 else [], ["words", "words2"][: 1 + i % 2]) for i in range(60)]
    entries = spark.createDataFrame([(d, t, "c", a, k) for d, t, a, k in rows], "doc_id string, title string, category string, aliases array<string>, keywords array<string>")
    entries = entries.withColumns({"path": F.col("doc_id"), "summary_short": F.lit("s")})
    asked = questions(spark, *["words words2", "alpha：beta words", "gamma words", "beta", "？", "nothing"] * 5)
    for size in (16_384, 5):
        monkeypatch.setattr(blocks, "BLOCK_TEXTS", size)
        got = {}
        for r in search_titles(asked, entries, limit=2).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        want = [
            [("d001", 20.0), ("d003", 20.0)], [("d001", 200.0), ("d003", 200.0)], [("d000", 200.0), ("d002", 200.0)],
            [("d001", 150.0), ("d003", 150.0)], None, None,
        ]
        assert got == {i + 1: w for i in range(30) if (w := want[i % 6])}
    assert "MapInArrow" in search_titles(asked, entries)._jdf.queryExecution().optimizedPlan().toString()


def test_filename_hits_match_brute_force(spark, monkeypatch):
    """Repeated questions and stems in several blocks; short stems and questions, and common runs that repeat in a stem."""
    import random

    from folia.operators import blocks

    rng = random.Random(5)
    stems = sorted({"".join(rng.choices("ab", k=rng.randint(1, 14))) for _ in range(60)})
    texts = ["".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(20)] * 2
    docs = spark.createDataFrame([(i, f"x/{s}.md") for i, s in enumerate(stems)], "row_id int, path string")
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")

    def length(s, q):
        runs = [n for n in range(1, len(s) + 1) for i in range(len(s) - n + 1) if s[i : i + n] in q]
        longest = max(runs, default=0)
        return longest if longest >= 4 or longest and longest in (len(s), len(q)) else 0

    monkeypatch.setattr(blocks, "BLOCK_TEXTS", 9)
    got = {}
    for r in filename_hits(asked, docs, order="row_id").orderBy("query_id", "path_rank").collect():
        got.setdefault(r["query_id"], []).append((r["row_id"], r["retrieval_score"]))
    want = {}
    for q, text in enumerate(texts):
        scored = sorted((-length(s, text), i) for i, s in enumerate(stems))[:3]
        if found := [(i, 1.5 - n / 100.0) for n, i in scored if n]:
            want[q] = found
    assert got == {q: [(i, pytest.approx(s)) for i, s in v] for q, v in want.items()}


def below_broadcasts(df):
    """The plan's nodes whose rows would go through the driver."""
    found, limit = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if limit is not None and depth > limit:
            found.append(line)
        else:
            limit = depth if "BroadcastExchange" in line else None
    return "\n".join(found)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_exploded_rows_are_not_broadcast(spark, monkeypatch, sent):
    from folia.operators import containment
    from folia.operators.containment import names_inside, with_anchor
    from folia.sources.shared import stored

    monkeypatch.setattr(containment, "SENT_ROWS", sent)
    text = F.concat(F.lit("alpha beta "), F.col("id").cast("string"))
    hays = stored(spark.range(50).select(F.col("id").alias("key"), text.alias("hay")), "hays")
    needles = stored(hays.select(F.col("hay").alias("needle")), "needles")
    for plan in (with_anchor(needles), contained_pairs(needles, hays), names_inside(needles, hays)):
        assert "Generate" not in below_broadcasts(plan)
    assert contained_pairs(needles, hays).count() == names_inside(needles, hays).count() == 50 + 40


def test_hits_of_blocks_are_not_broadcast(spark):
    from folia.sources.shared import stored

    text = F.concat(F.lit("alpha beta "), F.col("id").cast("string"))
    asked = spark.range(20).select(F.col("id").alias("query_id"), text.alias("question"))
    corpus = spark.range(50).select(F.col("id").alias("doc_id"), text.alias("haystack"), F.array(F.lit("alpha")).alias("keywords"))
    assert "MapInArrow" not in below_broadcasts(search(asked, stored(corpus, "corpus"), SearchSpec(ties=(("doc_id", True),), exact_boost=90.0), 5))
    entries = corpus.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("haystack").alias("path"), F.col("haystack").alias("title"), F.lit("a").alias("category"),
        F.lit("s").alias("summary_short"), F.array("haystack").alias("aliases"), "keywords",
    )
    assert "MapInArrow" not in below_broadcasts(search_titles(asked, stored(entries, "entries")))


def test_catalog_ids_are_not_broadcast(spark):
    from folia.sources.shared import stored

    name = F.concat(F.lit("place "), F.col("id").cast("string"))
    places = spark.range(50).select(
        F.concat(F.lit("c/"), F.col("id").cast("string")).alias("doc_id"), name.alias("title"), F.array(name).alias("aliases"), F.lit("s").alias("summary_short")
    )
    asked = stored(spark.range(60).select(F.col("id").alias("query_id"), F.concat(F.lit("c/"), F.col("id").cast("string")).alias("question")), "asked_ids")
    found = resolve_documents(asked, stored(places, "places"), prefix="x/")
    assert "places-" not in below_broadcasts(found)
    assert sorted(rows(found.filter("score IS NULL"), "query_id", "doc_id")) == [(i, f"c/{i}") for i in range(50)]


def test_question_grams_are_not_broadcast(spark):
    from folia.sources.shared import stored

    asked = stored(spark.range(20).select(F.col("id").alias("query_id"), F.concat(F.lit("alpha beta "), F.col("id").cast("string")).alias("question")), "asked")
    scope = stored(spark.range(10).select(F.col("id").alias("query_id"), F.lit("d").alias("doc_id")), "scope")
    cut = stored(section_table(spark), "sections")
    for found in (search_sections(asked, cut, limit=3), search_sections(asked, cut, limit=3, scope=scope)):
        assert "q_grams" not in below_broadcasts(found)
