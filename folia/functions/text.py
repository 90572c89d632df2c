"""Scalar text functions, all JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia import profiles as P


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def alternatives(words: Iterable[str]) -> str:
    """Regex that matches any of the plain words."""
    return "|".join("\\Q" + w + "\\E" for w in words)


def has_any(value: Column, words: Iterable[str]) -> Column:
    return value.rlike(alternatives(words))


def strip(value) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.btrim(col(value), F.lit(P.WS_CHARS))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def collapse(value) -> Column:
    return strip(F.regexp_replace(col(value), f"[{P.WS}]+", " "))


def lines(value) -> Column:
    """Array of lines; any line end counts, a closing line end adds no empty line."""
    def drop_last_empty(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return let(F.split(col(value), P.LINE_END), drop_last_empty)


def norm_text(value) -> Column:
    """Matching form: ASCII alphanumerics and CJK only, lower case.

    The runs to keep are joined; replacing the others takes ten times as long on whole documents.
    """
    return F.lower(F.array_join(F.regexp_extract_all(col(value), F.lit(P.MATCH_CHARS), F.lit(0)), ""))


def truncate(value, limit: int) -> Column:
    def cut(flat: Column) -> Column:
        return F.concat(F.rtrim(F.left(flat, F.lit(limit))), F.lit("..."))

    return let(collapse(value), lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(cut(flat)))


def snippet(value, limit: int = 700) -> Column:
    """Like ``truncate`` but keeps the inner white space."""
    text = strip(value)
    cut = F.regexp_replace(F.left(text, F.lit(limit)), f"[{P.WS}]+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def canonical_doc_id(value, prefix: str = P.REGULATORY_ZH.doc_prefix) -> Column:
    slashed = strip(F.replace(col(value), F.lit("\\"), F.lit("/")))
    heads = "|".join(["\\./"] + ([f"\\Q{prefix}\\E"] if prefix else []))
    return F.regexp_replace(slashed, f"^(?:{heads})+", "")


def path_stem(path) -> Column:
    name = F.substring_index(col(path), "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def char_grams(normalized: Column, sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Distinct character n-grams of an already normalised string."""

    def of_size(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(chars) - (n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))
        return F.when(F.size(chars) >= n, grams).otherwise(F.slice(chars, 1, 0))

    chars = F.split(normalized, "")
    return F.array_distinct(let(chars, lambda c: F.concat(*[of_size(c, n) for n in sizes])))


def _words(value) -> Column:
    # Runs are maximal, so asking for three characters leaves out the shorter words.
    return F.regexp_extract_all(F.lower(col(value)), F.lit(P.TERM), F.lit(0))


def _stopwords() -> Column:
    return F.array(*[F.lit(w) for w in P.STOPWORDS])


def content_terms(value) -> Column:
    """Lower-case words longer than two characters and not stop words, in text order."""
    return F.filter(_words(value), lambda w: ~F.array_contains(_stopwords(), w))


def distinct_terms(value) -> Column:
    """Content terms without repetition; the hash-based set difference suits long texts."""
    return F.array_except(_words(value), _stopwords())


def keyword_tokens(values: Iterable[Column], cap: int = P.REGULATORY_ZH.keyword_cap) -> Column:
    """Distinct keyword runs over several texts (arrays of texts allowed joined by newline), first ``cap``."""
    joined = F.concat_ws("\n", *values)
    return F.slice(F.array_distinct(F.regexp_extract_all(joined, F.lit(P.KEYWORD_TOKEN), F.lit(0))), 1, cap)


def tokens(value) -> Column:
    return F.regexp_extract_all(col(value), F.lit(P.TOKEN), F.lit(0))


def token_count(value) -> Column:
    return F.regexp_count(col(value), F.lit(P.TOKEN))


def first_tokens(value: Column, limit: int) -> Column:
    return F.array_join(F.slice(tokens(value), 1, limit), "")


def embedding_text(path, title, headings: Column, text, *, kind: Column | None = None, max_tokens: int) -> Column:
    """Text to embed: path/title/headings preface, the body, cut to ``max_tokens`` tokens."""
    clean = F.transform(F.filter(headings, lambda h: h != ""), collapse)
    preface = F.concat_ws(
        "\n",
        F.concat(F.lit("Path: "), col(path)),
        F.concat(F.lit("Title: "), blank_to_null(col(title))),
        F.when(F.size(headings) > 0, F.concat(F.lit("Headings: "), F.array_join(clean, " | "))),
        *([F.concat(F.lit("Section type: "), blank_to_null(kind))] if kind is not None else []),
    )
    return first_tokens(F.concat(preface, F.lit("\n\n"), strip(text)), max_tokens)


def first_match(value, pattern: str, group: int = 0) -> Column:
    """First regex match, NULL when there is none."""
    return F.when(col(value).rlike(pattern), F.regexp_extract(col(value), pattern, group))


def article_no(value) -> Column:
    return first_match(value, P.ARTICLE_AT_START)


def clause_no(value) -> Column:
    return first_match(value, P.CLAUSE_AT_START)


def mention_numbers(value, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(value), F.lit(pattern), F.lit(1)))


def mention_labels(value, pattern: str, template: str) -> Column:
    head, tail = template.split("{}")
    return F.transform(mention_numbers(value, pattern), lambda n: F.concat(F.lit(head), n, F.lit(tail)))


def has_formula(value) -> Column:
    return col(value).rlike(P.MATH_BLOCK)


def has_table(value) -> Column:
    return col(value).rlike(P.TABLE_LINE)


def content_type(value, formula: Column, table: Column) -> Column:
    text = col(value)
    return (
        F.when(
            strip(text).rlike(P.ARTICLE_AT_START),
            F.when(formula, "article_formula").when(table, "article_table").otherwise("article"),
        )
        .when(formula, "formula")
        .when(table, "table")
        .when(has_any(text, P.THRESHOLD_MARKERS) & text.rlike(r"\p{Nd}"), "threshold")
        .when(has_any(text, P.OBLIGATION_MARKERS), "obligation")
        .otherwise("semantic")
    )


def headings(value, cap: int | None = P.REGULATORY_ZH.heading_cap) -> Column:
    found = F.transform(F.regexp_extract_all(col(value), F.lit(P.HEADING), F.lit(2)), collapse)
    filled = F.filter(found, lambda h: h != "")
    return filled if cap is None else F.slice(filled, 1, cap)


def filename_hints(value) -> Column:
    return F.regexp_extract_all(col(value), F.lit(P.FILENAME_HINT), F.lit(1))


def focus_terms(title) -> Column:
    """Segments after the first colon of a title, two characters or longer."""
    segments = F.filter(F.transform(F.split(col(title), "[：:]"), strip), lambda s: s != "")
    return F.filter(segments, lambda s, i: (i > 0) & (F.length(s) >= 2))


def distinct_by_norm(values: Column, norm_of: Callable[[Column], Column] = norm_text) -> Column:
    """Keep the first value per normalised form, drop values whose form is empty; order kept."""
    pairs = F.transform(values, lambda v: F.struct(v.alias("value"), norm_of(v).alias("norm")))

    def first_of_each(found: Column) -> Column:
        norms = F.transform(found, lambda p: p["norm"])

        def is_first(p: Column, i: Column) -> Column:
            return (p["norm"] != "") & (F.array_position(norms, p["norm"]) == (i + 1).cast("long"))

        return F.transform(F.filter(found, is_first), lambda p: p["value"])

    return let(pairs, first_of_each)


def replace_matches(value: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` with ``rewrite(match)``; the rest is untouched."""
    return rewrite_pieces(value, pattern, lambda between: between, rewrite)


def rewrite_outside(value: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Rewrite the text between the matches of ``pattern``; the matches are untouched."""
    return rewrite_pieces(value, pattern, rewrite, lambda match: match)


def rewrite_pieces(value: Column, pattern: str, outside: Callable, inside: Callable) -> Column:
    """Rewrite the matches of ``pattern`` with ``inside`` and the text between them with ``outside``."""

    def join(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.zip_with(
            F.split(text, pattern),
            found,
            lambda b, m: F.when(m.isNull(), outside(b)).otherwise(F.concat(outside(b), inside(m))),
        )

    return F.array_join(let(value, join), "")


def blob_url(path, base_url: str) -> Column:
    """Percent-encoded address of a stored file below ``base_url``."""
    slashed = F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^[./]+", "")
    encoded = F.url_encode(slashed)
    for was, now in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(was), F.lit(now))
    return F.concat(F.lit(base_url.rstrip("/") + "/"), encoded)
