import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folia import profiles as P
from folia.functions import text as T
from folia.functions.formulas import formula_variables


@pytest.mark.parametrize(
    "raw, expected",
    [("规则 第2号：A-b_9é", "规则第2号ab9"), ("", ""), ("...", "")],
)
def test_norm_text(evaluate, raw, expected):
    assert evaluate(lambda F: T.norm_text("x"), x=raw) == expected


def test_truncate_and_snippet(evaluate):
    assert evaluate(lambda F: T.truncate("x", 5), x="  ab \n cd  ef ") == "ab cd..."
    assert evaluate(lambda F: T.truncate("x", 4), x="ab   cd") == "ab c..."
    assert evaluate(lambda F: T.truncate("x", 20), x="ab\u3000\ncd") == "ab cd"
    assert evaluate(lambda F: T.snippet("x", 4), x=" ab\n cd ") == "ab..."


def test_canonical_doc_id(evaluate):
    prefix = P.REGULATORY_ZH.doc_prefix
    assert evaluate(lambda F: T.canonical_doc_id("x"), x=f" ./{prefix}./rules\\a.md ") == "rules/a.md"


def test_grams_are_distinct(evaluate):
    assert sorted(evaluate(lambda F: T.char_grams(T.norm_text("x")), x="AbAb")) == ["ab", "aba", "abab", "ba", "bab"]
    assert evaluate(lambda F: T.char_grams(T.norm_text("x")), x="a") == []


def test_content_terms(evaluate):
    got = evaluate(lambda F: T.content_terms("x"), x="What is the état-x of 规则条文, Risk² an ab model_1")
    assert got == ["état-x", "规则条文", "risk²", "model_1"]


def test_keyword_tokens_cap_and_order(evaluate):
    got = evaluate(lambda F: T.keyword_tokens([F.col("x"), F.col("y")], 3), x="ab c ab-de", y="fg hi")
    assert got == ["ab", "de", "fg"]


def test_token_count_and_first_tokens(evaluate):
    text = "ab  cd_1\n规则é!"
    assert evaluate(lambda F: T.token_count("x"), x=text) == 8 - 1 + 1
    assert evaluate(lambda F: T.first_tokens(F.col("x"), 3), x=text) == "ab  cd_1"


def test_embedding_text(evaluate):
    got = evaluate(
        lambda F: T.embedding_text(
            F.lit("p.md"), F.lit("T"), F.array(F.lit("a  b"), F.lit("c")), F.col("x"), kind=F.lit("semantic"), max_tokens=99
        ),
        x=" body ",
    )
    assert got == "Path: p.md\nTitle: T\nHeadings: a b | c\nSection type: semantic\n\nbody"


@pytest.mark.parametrize(
    "text, article, clause",
    [("第十二条 保险公司", "第十二条", None), ("（三）内容", None, "（三）"), ("见第1条", None, None)],
)
def test_article_and_clause(evaluate, text, article, clause):
    assert evaluate(lambda F: T.article_no("x"), x=text) == article
    assert evaluate(lambda F: T.clause_no("x"), x=text) == clause


def test_mentions(evaluate):
    got = evaluate(lambda F: T.mention_labels("x", P.ATTACHMENT_NO, "附件{}"), x="附件3-1、附件4、附件3-1")
    assert got == ["附件3-1", "附件4"]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("第一条 x $$a$$", "article_formula"),
        ("第一条\n|a|b|", "article_table"),
        ("第一条 x", "article"),
        ("```math\na\n```", "formula"),
        ("前\n | a | \n后", "table"),
        ("比例为 5", "threshold"),
        ("比例不得超过", "obligation"),
        ("其他", "semantic"),
    ],
)
def test_content_type(evaluate, text, kind):
    assert evaluate(lambda F: T.content_type("x", T.has_formula("x"), T.has_table("x")), x=text) == kind


def test_headings_and_focus_terms(evaluate):
    assert evaluate(lambda F: T.headings("x", 2), x="# A  b \ntext\n####### no\n## C\n### D") == ["A b", "C"]
    assert evaluate(lambda F: T.focus_terms("x"), x="规则第2号：最低资本:x") == ["最低资本"]
    assert evaluate(lambda F: T.focus_terms("x"), x="只有一段") == []


def test_distinct_by_norm(evaluate):
    got = evaluate(lambda F: T.distinct_by_norm(F.split("x", ",")), x="附件 1,附件1,!,B,b")
    assert got == ["附件 1", "B"]


def test_replace_matches(evaluate):
    got = evaluate(lambda F: T.replace_matches(F.col("x"), r"\d+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))), x="1a22")
    assert got == "<1>a<22>"


def test_blob_url(evaluate):
    got = evaluate(lambda F: T.blob_url("x", "https://host/blob/main"), x="./rules\\规则 1~.md")
    assert got == "https://host/blob/main/rules/%E8%A7%84%E5%88%99%201~.md"


def test_path_stem(evaluate):
    assert evaluate(lambda F: T.path_stem("x"), x="a.b/规则.第2号.md") == "规则.第2号"
    assert evaluate(lambda F: T.path_stem("x"), x="a/.hidden") == ".hidden"


@pytest.mark.parametrize(
    "formula, expected",
    [
        (r"$$\mathrm{MC} = \sqrt{x_1^2 + \rho \times y}$$", ["MC", "x_1", "x", "rho", "y"]),
        (r"$$\mathrm{EX}_{t} \text{市场} \text{Rf} 12$$", ["EX_t", "EX", "Rf", "t"]),
        ("```math\nM = K\n```", ["K"]),
    ],
)
def test_formula_variables(evaluate, formula, expected):
    assert evaluate(lambda F: formula_variables("x"), x=formula) == expected


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aé规 \t\n\u00a0\u3000-_1!", max_size=30))
def test_text_functions_match_python(evaluate, text):
    import re

    assert evaluate(lambda F: T.collapse("x"), x=text) == " ".join(text.split())
    assert evaluate(lambda F: T.lines("x"), x=text) == text.splitlines()
    assert evaluate(lambda F: T.token_count("x"), x=text) == len(
        re.findall(r"\s+|[\u4e00-\u9fff]|[A-Za-z0-9_]+|[^\s]", text)
    )
