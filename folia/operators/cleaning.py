"""Row-wise cleaning of a document table; nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions.text import col, let, lines, strip

BLANK = r"[\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
INK = f"[^{P.WS}]"
REPEATED_HEADING = (
    rf"(?md)^({BLANK}*(#{{1,6}}){BLANK}+({INK}(?:[^\n]*{INK})?){BLANK}*)"
    rf"(?:\n(?:{BLANK}*\n)*{BLANK}*\2{BLANK}+\3{BLANK}*(?=\n|\z))+"
)
LEADING_TITLE = (
    rf"(?d)\A((?:{BLANK}*(?:_Note:[^\n]*)?\n)*{BLANK}*#{BLANK}+({INK}(?:[^\n]*{INK})?){BLANK}*\n(?:{BLANK}*\n)*)"
    rf"([^\n]*{INK}[^\n]*)(?:\n|\z)"
)
NON_PRINTABLE = rf"[\p{{C}}&&[^{P.WS}]]"
ASSET_FOLDER = r"\(([^)]+?_images)/[^)]+\)"


def source_category(path) -> Column:
    """Category of a raw source from its top folder."""
    top = F.substring_index(col(path), "/", 1)
    known = F.create_map(*[F.lit(x) for pair in P.SOURCE_FOLDERS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, top), F.lit("notices"))


def folder_category(path) -> Column:
    """Category of a normalised document: its first path component."""
    return F.substring_index(col(path), "/", 1)


def dedupe_headings(text) -> Column:
    """Drop a heading that repeats the heading before it with only blank lines between."""
    unified = F.array_join(lines(text), "\n")
    return F.regexp_replace(unified, REPEATED_HEADING, "$1")


def dedupe_leading_title(text, title) -> Column:
    """Drop the second title line of a text that opens with its title twice."""
    return let(col(text), lambda body: _drop_second_title(body, strip(title)))


def _drop_second_title(body: Column, wanted: Column) -> Column:
    head = F.regexp_extract(body, LEADING_TITLE, 1)
    first = strip(F.regexp_extract(body, LEADING_TITLE, 2))
    second = strip(F.regexp_extract(body, LEADING_TITLE, 3))
    again = (second == wanted) | (strip(F.regexp_extract(second, rf"\A#{BLANK}+(.*)\z", 1)) == wanted)
    rest = F.regexp_replace(body, LEADING_TITLE, "")
    rest = F.when(strip(rest) == "", "").otherwise(F.regexp_replace(rest, rf"\A(?:{BLANK}*\n)+", ""))
    joined = F.when(rest == "", F.left(head, F.length(head) - 1)).otherwise(F.concat(head, rest))
    return F.when((first == wanted) & (wanted != "") & again, joined).otherwise(body)


def clean_body(text, title) -> Column:
    return dedupe_leading_title(dedupe_headings(text), title)


def with_validity(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``is_valid`` and ``reason``: empty, too short, or less than 80 % printable."""
    content = F.coalesce(F.col(text), F.lit(""))
    body = strip(content)
    printable = F.length(F.regexp_replace(content, NON_PRINTABLE, "")) / F.length(content)
    reason = (
        F.when(body == "", "empty or only whitespace")
        .when(F.length(body) < 10, "too short (less than 10 characters)")
        .when(
            printable < 0.8,
            F.concat(F.lit("corrupted or binary (only "), F.format_string("%.1f", printable * 100), F.lit("% printable)")),
        )
        .otherwise("")
    )
    return documents.withColumn("reason", reason).withColumn("is_valid", F.col("reason") == "")


def asset_references(documents: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """One row per (document, image folder) referenced in its Markdown."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(ASSET_FOLDER), F.lit(1)))
    return documents.select(key, F.explode(found).alias("asset_dir"))


def dangling_assets(documents: DataFrame, assets: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """References whose folder is not in ``assets(path, asset_dir)``."""
    return asset_references(documents, key, text).join(assets, [key, "asset_dir"], "left_anti")
