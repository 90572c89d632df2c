import json

import pytest
from pyspark.sql import functions as F

from folia import profiles as P
from folia.operators import catalog as C
from folia.operators import cleaning, conversation, graph, quality, routing, sections
from folia.operators import evidence as E
from folia.operators import html as H
from folia.plans import questions as plans
from folia.plans import ready_data as builds
from folia.sources import files, sinks

RULE = """---
title: "规则第2号：最低资本"
source_type: .pdf
publish_date:\x20
---

# 规则第2号：最低资本

附件4

本规则规范保险公司最低资本的计量方法。

## 第一章 总则

第一条 最低资本按照附件4的情景计量，不得低于下限。

## 第二章 计量

第二条 市场风险最低资本计算公式如下：

$$
\\mathrm{MC} = \\sqrt{x_1 \\times \\rho}
$$

其中 x_1 为风险暴露。

| 项目 | 值 |
| --- | --- |
| a | 1 |
"""
ATTACHMENT = "# 附件4：压力测试情景\n\n本附件规定压力测试的必测情景，参见规则第2号和规则第9号。\n"
NOTICE = """---
title: 关于优化监管标准的通知
publish_date: 2023-09-10
---

![img](a.png)

金规〔2023〕5号

各保险公司：

为优化监管标准，对规则第2号的要求作出调整，现通知如下。
"""


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        [("rules/规则第2号：最低资本.md", RULE), ("attachments/附件4：压力测试情景.md", ATTACHMENT), ("notices/通知.md", NOTICE)],
        "path string, text string",
    )


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ready"))
    manifest = builds.build_ready_data(spark, corpus, root)
    return builds.load_ready_data(spark, root), manifest


def test_manifest_counts(stored):
    tables, manifest = stored
    row = manifest.first()
    assert (row["doc_count"], row["summary_count"]) == (3, 3)
    assert row["section_count"] == tables["sections_structured"].count()
    assert (row["formula_count"], row["relation_edge_count"]) == (1, tables["relation_edges"].count())


def test_catalog(stored):
    got = {r["doc_id"].split("/")[0]: r for r in stored[0]["doc_catalog"].collect()}
    rule, notice = got["rules"], got["notices"]
    assert rule["summary_short"] == "本规则规范保险公司最低资本的计量方法。"
    assert rule["publish_date"] == "" and rule["source_type"] == ".pdf"
    assert rule["headings"] == ["规则第2号：最低资本", "第一章 总则", "第二章 计量"]
    assert rule["path"] == "Knowledge_Base_MarkDown/rules/规则第2号：最低资本.md"
    assert notice["summary_short"].startswith("为优化监管标准")
    assert notice["publish_date"] == "2023-09-10"
    assert rule["summary_structured"].splitlines()[1] == "重点章节：规则第2号：最低资本；第一章 总则；第二章 计量"


def test_aliases(stored):
    got = {(r["alias"], r["alias_type"]) for r in stored[0]["title_aliases"].collect()}
    assert {("规则第2号", "rule_number"), ("第2号规则", "rule_number"), ("监管规则", "category_hint")} <= got
    assert {("附件4", "attachment_number"), ("优化监管标准", "notice_topic"), ("通知", "stem")} <= got
    assert ("附件 4", "attachment_number") not in got and ("通知", "category_hint") not in got


def test_sections(stored):
    got = {r["section_id"]: r for r in stored[0]["sections_structured"].collect() if r["doc_id"].startswith("rules")}
    second = got["rules/规则第2号：最低资本.md#section-2"]
    assert second["heading_path"] == ["规则第2号：最低资本", "第一章 总则"]
    assert (second["article_no"], second["content_type"]) == ("第一条", "article")
    assert second["mentions_attachments"] == ["附件4"] and second["mentions_rules"] == []
    third = got["rules/规则第2号：最低资本.md#section-3"]
    assert third["has_formula"] and third["has_table"] and third["content_type"] == "article_formula"


def test_formula_card_and_explanation(stored):
    tables = stored[0]
    card = tables["formula_cards"].first()
    assert card["formula_id"] == "rules/规则第2号：最低资本.md#formula-1"
    assert card["variables"] == ["MC", "x_1", "x", "rho"] and card["article_no"] == "第二条"
    told = graph.explain_formulas(tables["formula_cards"], tables["sections_structured"]).first()
    assert told["section_id"].endswith("#section-3")
    evidence = {v["variable"]: v["evidence"] for v in told["variable_explanations"]}
    assert "其中 x_1 为风险暴露。" in evidence["x_1"]


def test_edges_and_related(stored):
    tables = stored[0]
    got = {(r["source"].split("/")[0], r["target"].split("/")[0], r["relation"]): r["confidence"] for r in tables["relation_edges"].collect()}
    assert got == {
        ("rules", "attachments", "mentions_attachment"): 0.55,
        ("rules", "attachments", "requires_attachment"): 0.72,
        ("attachments", "rules", "mentions_rule"): 0.55,
        ("notices", "rules", "mentions_rule"): 0.55,
        ("notices", "rules", "adjusts_rule"): 0.72,
    }
    related = {r["doc_id"].split("/")[0]: [d.split("/")[0] for d in r["related_doc_ids"]] for r in tables["doc_summaries"].collect()}
    assert related == {"rules": ["attachments"], "attachments": ["rules"], "notices": ["rules"]}


def test_traces(spark, stored):
    tables = stored[0]
    scope = spark.createDataFrame([(1, "rules/规则第2号：最低资本.md")], "query_id int, doc_id string")
    into = graph.trace_relations(tables["relation_edges"], scope, direction="in")
    assert {r["source"].split("/")[0] for r in into.collect()} == {"attachments", "notices"}
    notices = graph.trace_notices(tables["relation_edges"], scope, tables["doc_catalog"])
    assert {r["relation"] for r in notices.collect()} == {"mentions_rule", "adjusts_rule"}
    issued = spark.createDataFrame([(1, "notices/通知.md")], "query_id int, doc_id string")
    assert graph.trace_adjustments(tables["relation_edges"], issued, limit=1).count() == 1
    enriched = graph.enrich_edges(into, tables["doc_catalog"]).first()
    assert enriched["target_title"] == "规则第2号：最低资本"


def test_plan_and_answers(spark, stored):
    tables = stored[0]
    asked = spark.createDataFrame(
        [
            (1, "规则第2号里最低资本的计算公式是什么？"),
            (2, "监管规则一共有多少号规定？"),
            (3, "优化监管标准的通知调整了哪些规则？"),
            (4, "附件4是什么"),
        ],
        "query_id int, question string",
    )
    plan = plans.plan(asked, tables)
    got = {r["query_id"]: r for r in plan.collect()}
    assert [got[i]["question_type"] for i in (1, 2, 3, 4)] == ["formula", "catalog", "version", "locate"]
    assert got[1]["exact_scope_doc_ids"] == ["rules/规则第2号：最低资本.md"]
    assert got[2]["retrieval_strategy"] == "catalog-direct" and got[2]["scoped_queries"] == ["监管规则一共有多少号规定？"]
    assert got[1]["evidence_plan"]["steps"] == ["titles", "sections", "formulas"]
    manifest = spark.createDataFrame([("a.md", "规则第2号", "rules")], "path string, title string, category string")
    answers = {r["query_id"]: r for r in plans.answer(plan, tables, manifest).collect()}
    assert answers[1]["answered_from"] == "formula" and "MC、x_1" in answers[1]["answer"]
    assert answers[2]["answer"] == "根据目录元数据，manifest 共收录 1 份 rules 类文件，可用于回答监管规则数量问题。 [1]"
    assert answers[4]["answered_from"] == "section"
    cited = {i: answers[i]["citation"]["source_kind"] for i in (1, 2, 4)}
    assert cited == {1: "formula", 2: "catalog", 4: "section"} and answers[2]["citation"]["id"] == "manifest.json"
    evidence, relations = plans.collect_evidence(plan, tables)
    assert {r["query_id"] for r in relations.collect()} >= {3}
    cases = asked.select(
        F.col("query_id").alias("case_id"), "question", F.lit("./rules/规则第2号：最低资本.md").alias("expected_doc"), F.lit("c").alias("category")
    )
    results = quality.evaluate_retrieval(cases, plans.eval_candidates(plan, evidence, relations))
    ok = {r["case_id"]: r["ok"] for r in results.collect()}
    assert ok[1] and not ok[2] and ok[3]
    assert quality.pass_rate(results).first()["case_count"] == 4
    assert E.citations(evidence).filter("query_id = 1").count() >= 3
    assert E.evidence_hits(evidence).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 8


def test_validation(spark, stored):
    tables, manifest = stored
    reports = quality.validate({k: v for k, v in tables.items() if k != "relation_nodes"}, manifest)
    assert reports["absent"].count() == reports["counts"].count() == reports["warnings"].count() == 0
    assert {r["missing"] for r in reports["missing"].collect()} == set()
    wrong = manifest.withColumn("doc_count", F.lit(9))
    bad = quality.count_mismatches({"doc_catalog": tables["doc_catalog"]}, wrong).first()
    assert (bad["field"], bad["expected"], bad["actual"]) == ("doc_count", 9, 3)
    noisy = spark.createDataFrame([("f#1", ["times", "x"])], "formula_id string, variables array<string>")
    assert quality.noisy_variables(noisy).first()["noisy"] == ["times"]


# --- sections ----------------------------------------------------------------------------
def test_blocks():
    text = "# T\np1\np2\n\n| a |\n| b |\np3\n$$\nx\n\ny\n$$\n```py\n# no\n\n```\ntail"
    assert [(k, n, b) for k, n, b in sections.text_blocks(text)] == [
        ("heading", 1, "T"), ("paragraph", 0, "p1\np2"), ("table", 0, "| a |\n| b |"), ("paragraph", 0, "p3"),
        ("math", 0, "$$\nx\n\ny\n$$"), ("fence", 0, "```py\n# no\n\n```"), ("paragraph", 0, "tail"),
    ]


def test_heading_path_is_positional():
    text = "### 丙\n这是足够长的一段正文内容\n## 乙\n这是足够长的另一段正文内容"
    assert [p for p, _ in sections.document_sections("T", text, 1200)] == [["丙"], ["丙", "乙"]]


def test_section_packing_and_budget():
    words = " ".join(f"w{i}" for i in range(30))
    text = "\n\n".join([words] * 5 + ["short"])
    out = [b for _, b in sections.document_sections("T", text, 130)]
    assert all(sections._tokens(b) <= 130 for b in out)
    assert "".join(out).replace("\n", "").replace(" ", "") == (words * 5 + "short").replace(" ", "")
    long = "这是一句话。 " * 60
    pieces = sections.split_to_budget(long, 50)
    assert all(sections._tokens(p) <= 50 for p in pieces) and len(pieces) > 1
    assert sections.split_to_budget("x" * 5 + "," * 20, 7)[0] == "xxxxx" + "," * 6


@pytest.mark.parametrize("n, expected", [(100, [20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 20, 19, 4]), (0, []), (3, [5])])
def test_token_windows(spark, n, expected):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = sections.token_windows(df, "id", 20, 5).orderBy("window_no").collect()
    from folia.operators.sections import TOKEN

    assert [len(TOKEN.findall(r["window_text"])) for r in got] == expected


# --- cleaning, HTML ----------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, title, expected",
    [
        ("# T\n\n# T\n\nbody", "T", "# T\n\nbody"),
        ("# T\n\n\nT\n\nbody\n", "T", "# T\n\n\nbody"),
        ("_Note: x\n\n# T\nT\nbody", "T", "_Note: x\n\n# T\nbody"),
        ("# T\n# U\nbody", "T", "# T\n# U\nbody"),
        ("## A\n\n## A\n\n## A\nx\n## A", "T", "## A\nx\n## A"),
        ("# T\nT", "T", "# T"),
        ("plain\ntext", "plain", "plain\ntext"),
    ],
)
def test_clean_body(evaluate, text, title, expected):
    assert evaluate(lambda F: cleaning.clean_body("x", "t"), x=text, t=title) == expected


@pytest.mark.parametrize(
    "text, ok, reason",
    [("valid content here", True, ""), ("", False, "empty"), (" \n ", False, "empty"), ("ab", False, "too short"), ("\x00\x01\x02\x03" * 5 + "abc", False, "corrupted")],
)
def test_validity(spark, text, ok, reason):
    row = cleaning.with_validity(spark.createDataFrame([(text,)], "text string")).first()
    assert row["is_valid"] == ok and row["reason"].startswith(reason)


PAGE = """<html><head><title>站点</title><meta name="ArticleTitle" content="标题 &amp; 二"><meta name="PubDate" content="2024-01-02"></head>
<body><div id="top">nav</div><div class="x" id="wenzhang-content"><p data-a="1&2">A &lt; B<script>no()</script></p><br/></div><div>foot</div></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>x</p>"), (3, "<article><p>y<br></article> tail")], "id int, html string")
    got = {r["id"]: r for r in H.with_title_fallback(H.extract_articles(pages, "id"), F.lit("a/stem.html")).collect()}
    assert got[1]["title"] == "标题 & 二" and got[1]["publish_date"] == "2024-01-02"
    assert got[1]["content_html"] == '<div class="x" id="wenzhang-content"><p data-a="1&amp;2">A &lt; B</p><br /></div>'
    assert got[2]["content_html"] == P.HTML_NO_CONTENT and got[2]["title"] == "stem"
    # The void tag keeps the capture open: everything to the end belongs to it.
    assert got[3]["content_html"] == "<article><p>y<br></article> tail"
    document = H.extract_articles(pages, "id").filter("id = 1").select(
        H.article_document("title", "publish_date", "content_source", F.lit("http://h?a=1&b"), "content_html").alias("d")
    ).first()["d"]
    assert "<h1>标题 &amp; 二</h1>\n<p><strong>发布日期：</strong>2024-01-02</p>\n<p><strong>原始链接：</strong>" in document


# --- sources and sinks -------------------------------------------------------------------
def test_file_sources(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a b.md").write_text("正文", encoding="utf-8")
    (tmp_path / "rules" / "empty.md").write_text("")
    (tmp_path / "latin.md").write_bytes("é".encode("latin-1"))
    got = {r["path"]: r["text"] for r in files.scan_markdown(spark, str(tmp_path)).collect()}
    assert got == {"rules/a b.md": "正文", "latin.md": "é"}
    (tmp_path / "g.html").write_bytes("<p>规则</p>".encode("gb18030"))
    assert files.scan_html(spark, str(tmp_path)).first()["html"] == "<p>规则</p>"
    with pytest.raises(Exception):
        files.scan_markdown(spark, str(tmp_path / "none")).count()


def test_json_sources(spark, tmp_path):
    lines = tmp_path / "cases.jsonl"
    lines.write_text('{"case_id": "a", "question": "q"}\n\n[1]\n', encoding="utf-8")
    assert files.scan_json_lines(spark, str(lines), files.EVAL_CASE_SCHEMA).count() == 1
    lines.write_text('{"case_id": "a"}\n{bad\n', encoding="utf-8")
    with pytest.raises(Exception, match="Invalid JSON line"):
        files.scan_json_lines(spark, str(lines), files.EVAL_CASE_SCHEMA).collect()
    loose = files.scan_json_lines(spark, str(lines), files.EVAL_CASE_SCHEMA, strict=False)
    assert [r["_bad_line"] for r in loose.filter("_bad_line is not null").collect()] == ["{bad"]
    graph_file = tmp_path / "g.json"
    graph_file.write_text(json.dumps({"nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "b", "confidence": 0.5}]}))
    nodes, edges = files.scan_relation_graph(spark, str(graph_file))
    assert nodes.count() == 1 and edges.first()["confidence"] == 0.5
    nodes, edges = files.scan_relation_graph(spark, str(tmp_path / "missing.json"))
    assert nodes.count() == edges.count() == 0
    entry = {"path": "a.md", "title": "T"}
    for i, payload in enumerate(([entry], {"entries": [], "files": [entry]})):
        (tmp_path / f"m{i}.json").write_text("﻿" + json.dumps(payload), encoding="utf-8")
        assert files.scan_manifest(spark, str(tmp_path / f"m{i}.json")).first()["title"] == "T"


def test_sinks(spark, tmp_path):
    sinks.append_feedback(spark, str(tmp_path / "fb"), question="q", expected_doc="./rules\\a.md")
    sinks.append_feedback(spark, str(tmp_path / "fb"), question="r")
    assert {r["expected_doc"] for r in spark.read.json(str(tmp_path / "fb")).collect()} == {"rules/a.md", ""}
    table = spark.createDataFrame([(1, [3.0, 4.0])], "id int, embedding array<float>")
    sinks.write_vectors(table, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first()["embedding"] == pytest.approx([0.6, 0.8])


def test_normalized_corpus(spark):
    meta = "struct<" + ",".join(f"{k}:string" for k in P.FRONT_MATTER_KEYS) + ">"
    empty = (None,) * len(P.FRONT_MATTER_KEYS)
    raw = spark.createDataFrame(
        [("偿二代二期-规则/x/a.md", "﻿# a\n\n# a\n\n$$x &lt; y$$\n", empty), ("偿二代二期-规则/y/a.md", "b", empty), ("z/n.md", "n", empty)],
        f"path string, text string, meta {meta}",
    )
    got = {r["path"]: r for r in builds.normalize_corpus(raw).collect()}
    assert [got[p]["target_path"] for p in sorted(got)] == ["notices/n.md", "rules/a.md", "rules/a-2.md"]
    text = got["偿二代二期-规则/x/a.md"]["text"]
    assert text.startswith("---\ntitle: a\ncategory: rules\nsource_type: .md\nsource_file: a.md\n") and text.endswith("---\n\n# a\n\n$$x < y$$\n")


def test_inventory_and_manifest(spark, corpus):
    listing = spark.createDataFrame([("a/b.pdf",), ("c.xlsx",), ("d.txt",)], "path string")
    meta = spark.createDataFrame(
        [("e.html", None, None, None, None, "orig/e.mhtml")],
        "path string, title string, source_url string, publish_date string, content_source string, original_relative_path string",
    )
    got = {r["source_path"]: (r["source_type"], r["title"], r["preferred_engines"]) for r in files.source_inventory(listing, meta).collect()}
    assert got == {
        "a/b.pdf": (".pdf", "b", ["opendataloader", "mistral"]),
        "c.xlsx": (".xlsx", "c", ["local"]),
        "orig/e.mhtml": (".mhtml", "e", ["html_local"]),
    }
    manifest = {r["path"].split("/")[0]: r for r in sinks.corpus_manifest(corpus).collect()}
    assert manifest["rules"]["title"] == "规则第2号：最低资本" and manifest["attachments"]["title"] == "附件4：压力测试情景"
    fallback = {r["doc_id"].split("/")[0]: r for r in C.fallback_catalog(sinks.corpus_manifest(corpus), corpus).collect()}
    assert fallback["rules"]["category"] == "rules" and fallback["rules"]["keywords"][0] == "规则第2号"
    assert files.find_by_suffix(corpus, "通知.MD", order=["path"], limit=1).count() == 1


# --- routing and conversations -----------------------------------------------------------
@pytest.mark.parametrize(
    "question, kind, strategy, follow",
    [
        ("规则第1号和规则第2号的区别", "comparison", "hybrid", False),
        ("监管规则一共有多少号规定？", "catalog", "hybrid", False),
        ("公式是什么", "formula", "section", False),
        ("它的主要内容是什么", "summary", "document", True),
        ("应当报送哪些材料", "compliance", "hybrid", False),
        ("过渡期多长", "version", "hybrid", False),
        ("附件3-1在哪", "locate", "hybrid", False),
        ("What about that rule", "analysis", "hybrid", True),
        ("规则第2号里 this 系数", "formula", "section", False),
        ("那规则第2号呢", "locate", "hybrid", True),
        ("edit withit", "analysis", "hybrid", False),
    ],
)
def test_routing(evaluate, question, kind, strategy, follow):
    assert evaluate(lambda F: routing.question_type("x"), x=question) == kind
    assert evaluate(lambda F: routing.retrieval_strategy("x"), x=question) == strategy
    assert evaluate(lambda F: routing.needs_history("x"), x=question) == follow


def test_catalog_answers(spark):
    manifest = spark.createDataFrame(
        [("r/20.md", "规则第20号", "rules"), ("r/1.md", "规则第1号", "rules"), ("r/2.md", "规则第2号", "rules"), ("r/x.md", "其他", "rules")],
        "path string, title string, category string",
    )
    asked = spark.createDataFrame([(1, "监管规则一共有多少项？"), (2, "通知有多少"), (3, "规则是什么")], "query_id int, question string")
    got = E.catalog_count_answers(asked, manifest).collect()
    assert [r["query_id"] for r in got] == [1]
    assert "include 3 numbered rule files, running from Rule 1 to Rule 20." in got[0]["answer"]
    assert got[0]["text"].splitlines()[-1] == "- 规则第20号 (r/20.md)"


def test_history(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(31)]
    turns += [(2, 0, "user", "hi"), (2, 1, "assistant", "x"), (3, 0, "system", "s"), (3, 1, "user", " only "), (4, 0, "system", "s")]
    accepted, rejected = conversation.question_and_history(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"))
    got = {r["conv_id"]: r for r in accepted.collect()}
    assert sorted(got) == [1, 3] and {r["conv_id"] for r in rejected.collect()} == {2, 4}
    assert got[1]["question"] == "m30" and got[1]["history"].startswith("Turn 1\nRole: user\nText: m18\n\nTurn 2")
    assert got[3]["question"] == "only" and got[3]["history"] == ""


def test_citations(spark):
    links = F.create_map(F.lit("1"), F.lit("u1"))
    text = "见[1]和[2] $$x_{[1]}{a}$$ ```[1]``` [[1]] [1](k)"
    df = spark.createDataFrame([(1, text)], "answer_id int, answer string")
    assert df.select(conversation.link_citations("answer", links)).first()[0] == "见[1](u1)和[2] $$x_{[1]}{a}$$ ```[1](u1)``` [[1]] [1](k)"
    sources = spark.createDataFrame([(1, 1)], "answer_id int, index int")
    assert [r["index"] for r in conversation.citation_audit(df, sources).collect()] == [2]


def test_numbering_spreads_a_hot_group(spark):
    rows = [(f"d{i:03d}/a.md", "x" if i % 3 else "y") for i in range(120)]
    df = spark.createDataFrame(rows, "path string, candidate string").repartition(5)
    got = sinks.number_within(df, "candidate", F.split("path", "/")).collect()
    for group in ("x", "y"):
        mine = sorted((r["path"], r["turn"]) for r in got if r["candidate"] == group)
        assert [t for _, t in mine] == list(range(1, len(mine) + 1))
