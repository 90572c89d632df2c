"""Repair of math markup and inline math in Markdown.

Only the HTML entity table lives in Python; every other rewrite is a chain of JVM regex
replacements applied to the math segments of a text through ``replace_matches``.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folia import profiles as P
from folia.functions.text import let, lines, replace_matches, rewrite_outside, strip

S = f"[{P.WS}]"

# --- Fixed values: what counts as math, and the broken forms that are repaired -----------
MATH_SEGMENT = (
    rf"(?isd)(?:```(?:math|latex){S}*[\r\n]+.*?[\r\n]*```|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)"
    r"|(?<!\$)\$(?!\$).*?(?<!\\)\$)"
)
CJK = r"\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
BROKEN_SCRIPT_WITH_INDEX = rf"([_^]){S}*\{{{S}*\\([{CJK}]+){S}*_([A-Za-z0-9]+){S}*\}}"
BROKEN_SCRIPT = rf"([_^]){S}*\{{{S}*\\([{CJK}]+){S}*\}}"
LEFT_ARRAY = (
    rf"(?s)\\left\\\{{{S}*\\begin\{{array\}}\{{[lcr{P.WS}]+\}}{S}*(.*?){S}*\\end\{{array\}}{S}*\\right\."
)
CASES = r"(?s)\A(.*?)\\begin\{cases\}(.*?)\\end\{cases\}(.*)\z"
FRAGMENTED_DECIMAL = rf"(?<!\d)[+\-−]?{S}*\d+{S}*\.{S}*\d(?:{S}*\d)*(?!\d)"
LOOSE_PERCENT = rf"([+\-−]?\d+(?:\.\d+)?){S}+\\%"
INLINE_MATH = r"(?d)(?<!\$)\$(?!\$)(.*?)(?<!\\)\$"
FENCED_REGION = r"(?msd)^[^\n\S]*```[^\n]*(?:\n.*?^[^\n\S]*```[^\n]*|.*\z)"
INLINE_BLOCKERS = (
    r"\frac", r"\sqrt", r"\sum", r"\times", r"\left", r"\right", r"\begin", r"\end", r"\min", r"\max",
    r"\operatorname", r"\in", r"\le", r"\ge", r"\dots", r"\cdot", "<", ">",
)
GREEK_LETTERS = {
    r"\rho": "ρ", r"\beta": "β", r"\Delta": "Δ", r"\alpha": "α", r"\gamma": "γ", r"\mu": "μ", r"\pi": "π",
    r"\sigma": "σ", r"\tau": "τ",
}
SYMBOL = rf"[A-Za-z0-9{CJK}α-ωΑ-ΩΔρβγμνπστυφχψω_,]+(?:\^[A-Za-z0-9{CJK}*]+)?"
PLAIN_INLINE = (
    rf"\A(?:{SYMBOL}|{SYMBOL}{S}*={S}*[-+−]?\d+(?:\.\d+)?(?:{S}*%?)?|{SYMBOL}{S}*-{S}*{SYMBOL})\z"
)


@F.pandas_udf(ArrayType(StringType()))
def _unescape_all(segments: pd.Series) -> pd.Series:
    def settle(text: str) -> str:
        for _ in range(3):
            text = html.unescape(text)
        return text

    return segments.map(lambda found: None if found is None else [settle(s) for s in found])


def merge_fragmented_numbers(segment: Column) -> Column:
    joined = replace_matches(
        segment, FRAGMENTED_DECIMAL, lambda m: F.replace(F.regexp_replace(m, f"{S}+", ""), F.lit("−"), F.lit("-"))
    )
    return F.regexp_replace(joined, LOOSE_PERCENT, r"$1\\%")


def repair_cjk_scripts(segment: Column) -> Column:
    with_index = F.regexp_replace(segment, BROKEN_SCRIPT_WITH_INDEX, r"$1{\\text{$2}_$3}")
    return F.regexp_replace(with_index, BROKEN_SCRIPT, r"$1{\\text{$2}}")


def arrays_to_cases(segment: Column) -> Column:
    return F.regexp_replace(segment, LEFT_ARRAY, r"\\begin{cases} $1 \\end{cases}")


def cases_to_fence(segment: Column) -> Column:
    """Display math with a ``cases`` block becomes a fenced block, one case per line."""
    fence = let(strip(F.substr(segment, F.lit(3), F.greatest(F.length(segment) - 4, F.lit(0)))), _fenced_cases)
    is_display = segment.startswith("$$") & segment.endswith("$$") & segment.contains(r"\begin{cases}")
    return F.when(is_display, fence).otherwise(segment)


def _fenced_cases(body: Column) -> Column:
    before = F.regexp_extract(body, CASES, 1)
    inner = strip(F.regexp_extract(body, CASES, 2))
    after = F.regexp_replace(F.regexp_extract(body, CASES, 3), rf"\A{S}+", "")
    rows = F.filter(F.transform(F.split(inner, rf"{S}*\\\\{S}*"), strip), lambda r: r != "")
    rendered = F.concat_ws(
        "\n",
        F.concat(before, F.lit(r"\begin{cases}")),
        F.when(F.size(rows) > 0, F.array_join(rows, " \\\\\n")),
        F.concat(F.lit(r"\end{cases}"), F.when(after != "", F.concat(F.lit(" "), after)).otherwise("")),
    )
    return F.concat(F.lit("```math\n"), F.when(body.rlike(CASES), rendered).otherwise(body), F.lit("\n```"))


def _repair_segment(segment: Column) -> Column:
    fixed = arrays_to_cases(repair_cjk_scripts(segment))
    fixed = F.replace(fixed, F.lit("\xa0"), F.lit(" "))
    return let(merge_fragmented_numbers(fixed), cases_to_fence)


def _decode_entities(segment: Column) -> Column:
    for name, char in (("lt", "<"), ("gt", ">"), ("amp", "&")):
        segment = F.regexp_replace(segment, f"(?i)&{S}*{name};", char)
    return segment


def normalize_math(value: Column) -> Column:
    """Decode entities and repair broken markup inside math; prose is untouched."""
    between = F.split(value, MATH_SEGMENT)
    found = F.regexp_extract_all(value, F.lit(MATH_SEGMENT), F.lit(0))
    decoded = _unescape_all(F.transform(found, _decode_entities))
    repaired = F.transform(decoded, _repair_segment)
    return F.array_join(F.zip_with(between, repaired, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")


def _plain_form(body: Column) -> Column:
    """Plain rendering of a simple formula, NULL when it is not simple."""
    text = F.replace(F.replace(strip(body), F.lit("\xa0"), F.lit(" ")), F.lit(r"\%"), F.lit("%"))
    for command, letter in GREEK_LETTERS.items():
        text = F.replace(text, F.lit(command), F.lit(letter))

    def unwrap(t: Column) -> Column:
        t = F.regexp_replace(t, rf"\\(?:mathrm|mathbf|mathit|text){S}*\{{([^{{}}]*)\}}", "$1")
        t = F.regexp_replace(t, rf"([_^]){S}*\{{([^{{}}]+)\}}", "$1$2")
        return F.regexp_replace(t, r"\{([^{}]+)\}", "$1")

    # Each round removes at least one brace pair, so as many rounds as braces reach the fixed point.
    def unwrap_all(t: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.length(t) - F.length(F.replace(t, F.lit("{"), F.lit(""))))
        return F.aggregate(rounds, t, lambda acc, _: unwrap(acc))

    text = let(text, unwrap_all)
    text = F.regexp_replace(text, r"\\([A-Za-z]+)", "$1")
    text = F.regexp_replace(text, rf"{S}*([_^,]){S}*", "$1")
    text = strip(F.regexp_replace(F.regexp_replace(text, rf"{S}*={S}*", " = "), f"{S}+", " "))
    blocked = F.lit(False)
    for token in INLINE_BLOCKERS:
        blocked = blocked | body.contains(token)
    simple = ~blocked & (strip(body) != "")
    return F.when(simple, let(text, lambda t: F.when(t.rlike(PLAIN_INLINE), t)))


def _plain_reference(match: Column) -> Column:
    body = F.substr(match, F.lit(2), F.length(match) - 2)
    plain = _plain_form(body)
    return F.coalesce(F.concat(F.lit("`"), plain, F.lit("`")), match)


def plainify_inline_math(value: Column) -> Column:
    """Simple inline math becomes a code span; fences, tables, display and math-only lines stay."""

    def one_line(line: Column) -> Column:
        only_math = line.contains("$") & (strip(F.regexp_replace(line, INLINE_MATH, "")) == "")
        keep = line.contains("$$") | strip(line).startswith("|") | only_math
        return F.when(keep | ~line.contains("$"), line).otherwise(replace_matches(line, INLINE_MATH, _plain_reference))

    def outside(part: Column) -> Column:
        return F.array_join(F.transform(F.split(part, "\n"), one_line), "\n")

    unified = F.array_join(lines(value), "\n")
    return rewrite_outside(unified, FENCED_REGION, outside)


def normalize_math_markdown(value: Column) -> Column:
    return plainify_inline_math(normalize_math(value))


# --- Fixed values: OCR artefacts in generated LaTeX --------------------------------------
def repair_latex_artifacts(math_text: Column) -> Column:
    fixed = F.regexp_replace(
        math_text,
        r"(\\(?:mathrm|mathbf|mathit|operatorname)\s*\{[^{}]+\})\s*\{\s*(\\text\s*\{[^{}]+\})\s*\}",
        "$1_{$2}",
    )
    for spaced, command in (("M\\s*i\\s*n", "min"), ("M\\s*a\\s*x", "max"), ("S\\s*u\\s*m", "sum")):
        fixed = F.regexp_replace(fixed, rf"\\operatorname\s*\{{\s*{spaced}\s*\}}", rf"\\{command}")
    return F.regexp_replace(fixed, r"\\left\s*\{", r"\\left\\{")
