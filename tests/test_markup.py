import pytest

from folia.functions import frontmatter as M
from folia.functions.markup import normalize_math_markdown, repair_latex_artifacts
from folia.functions.payload import json_payload, message_text


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("a &lt; b", "a &lt; b"),
        ("x $$a &lt; b$$", "x $$a < b$$"),
        ("x $$a &amp;amp;lt; b$$", "x $$a < b$$"),
        ("\\[ a & gt; b \\]", "\\[ a > b \\]"),
        ("$$\nx_{ \\市场 _1 } + y^{\\信用}\n$$", "$$\nx_{\\text{市场}_1} + y^{\\text{信用}}\n$$"),
        ("$$0. 1 4 8 \\%$$", "$$0.148\\%$$"),
        ("$$x = − 1 . 5$$", "$$x = -1.5$$"),
        ("$$x = 1 . 5$$", "$$x =1.5$$"),
        (
            "$$f=\\left\\{\\begin{array}{l l} 1 & a \\\\ 2 & b\\end{array}\\right.$$",
            "```math\nf=\\begin{cases}\n1 & a \\\\\n2 & b\n\\end{cases}\n```",
        ),
        ("用 $\\rho_{ij}$ 表示", "用 `ρ_ij` 表示"),
        ("用 $k_{1} = 0.5$ 表示", "用 `k_1 = 0.5` 表示"),
        ("用 $\\mathrm{RF}_{\\text{市场}}$ 表示", "用 `RF_市场` 表示"),
        ("用 $\\frac{a}{b}$ 表示", "用 $\\frac{a}{b}$ 表示"),
        ("$a_1$", "$a_1$"),
        ("| $a_1$ | b |", "| $a_1$ | b |"),
        ("```\n见 $a_1$ 文\n```\n见 $a_1$ 文", "```\n见 $a_1$ 文\n```\n见 `a_1` 文"),
    ],
)
def test_normalize_math(evaluate, raw, expected):
    assert evaluate(lambda F: normalize_math_markdown(F.col("x")), x=raw) == expected


def test_latex_artifacts(evaluate):
    raw = "\\mathrm{MC}{\\text{损失}} = \\operatorname { M i n}(x) + \\operatorname{M a x} \\left { y"
    assert evaluate(lambda F: repair_latex_artifacts(F.col("x")), x=raw) == (
        "\\mathrm{MC}_{\\text{损失}} = \\min(x) + \\max \\left\\{ y"
    )


HEADER = '\ufeff---\ntitle: "规则: \\"一\\""\nkey: a\nkey: b\nempty: \n---\n\n# 正文\n'


def test_front_matter(evaluate):
    got = evaluate(lambda F: M.parse_front_matter("x"), x=HEADER)
    assert got == {"title": '规则: "一"', "key": "b", "empty": ""}
    assert evaluate(lambda F: M.parse_front_matter("x"), x="no header") == {}
    assert evaluate(lambda F: M.strip_front_matter("x"), x=HEADER) == "# 正文\n"
    assert evaluate(lambda F: M.strip_front_matter("x"), x="plain") == "plain"
    assert evaluate(lambda F: M.front_matter_title("x"), x="plain") is None
    assert evaluate(lambda F: M.front_matter_title("x"), x="---\ntitle: 'A b'\n---\nx") == "A b"
    assert evaluate(lambda F: M.front_matter_value("x", "empty"), x=HEADER) == ""
    assert evaluate(lambda F: M.front_matter_value("x", "key"), x=HEADER) == "a"


def test_render_round_trip(evaluate):
    def build(F):
        return M.render_front_matter({"title": F.lit('a: "b" \\ c'), "category": F.lit("rules")}, F.col("x"))

    text = evaluate(build, x="  body \n")
    assert text.splitlines()[:3] == ["---", 'title: "a: \\"b\\" \\\\ c"', "category: rules"]
    assert text.endswith("converted_at: \n---\n\nbody\n")
    assert evaluate(lambda F: M.parse_front_matter("x"), x=text)["title"] == 'a: "b" \\ c'


@pytest.mark.parametrize(
    "text, expected",
    [
        ('go ```json\n{"a": [1, "}"]}\n``` end', '{"a": [1, "}"]}'),
        ('text {"q": "规则"} tail', '{"q": "规则"}'),
        ('say "x" then [1, 2]', "[1, 2]"),
        ("no json {", None),
        ("", None),
    ],
)
def test_json_payload(evaluate, text, expected):
    assert evaluate(lambda F: json_payload("x"), x=text) == expected


def test_message_text(spark):
    parts = [
        {"type": "text", "text": " hi "},
        {"type": "reasoning", "text": ""},
        {"type": "tool-call", "toolName": "search"},
        {"type": "source", "title": "", "url": "u"},
        {"type": "image", "text": "no"},
    ]
    df = spark.createDataFrame([(parts,)], "parts array<map<string,string>>")
    assert df.select(message_text(df.parts)).first()[0] == "hi\n[tool:search]\nu"
