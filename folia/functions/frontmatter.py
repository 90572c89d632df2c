"""Front matter: parse, strip, look up and render the ``---`` header of a Markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folia import profiles as P
from folia.functions.text import blank_to_null, col, let, lines, strip

BOM = "\ufeff"
HEADER = rf"(?sd)\A---[{P.WS}]*\r?\n.*?\r?\n---[{P.WS}]*\r?\n?"


def drop_bom(value) -> Column:
    return F.regexp_replace(col(value), f"^{BOM}+", "")


def _unquote(value: Column) -> Column:
    """Decode a JSON-quoted scalar; anything else is returned as it is."""
    decoded = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string").getField("v")
    quoted = (F.length(value) >= 2) & value.startswith('"') & value.endswith('"')
    return F.when(quoted, F.coalesce(decoded, value)).otherwise(value)


def parse_front_matter(value) -> Column:
    """Header as ``map<string,string>``; the last of several equal keys wins."""
    text = drop_bom(value)

    def before_close(rest: Column) -> Column:
        close = F.array_position(rest, F.lit("---"))
        return F.when(close > 0, F.slice(rest, F.lit(1), (close - 1).cast("int"))).otherwise(rest)

    body = let(F.transform(F.slice(lines(text), 2, 1_000_000_000), strip), before_close)
    pairs = F.reverse(
        F.transform(
            F.filter(body, lambda line: line.contains(":")),
            lambda line: F.struct(
                strip(F.substring_index(line, ":", 1)).alias("key"),
                _unquote(strip(F.regexp_replace(line, r"(?s)\A[^:]*:", ""))).alias("value"),
            ),
        )
    )

    def last_of_each(found: Column) -> Column:
        keys = F.transform(found, lambda p: p["key"])
        return F.filter(found, lambda p, i: F.array_position(keys, p["key"]) == (i + 1).cast("long"))

    # Without a header no line is an entry.
    entries = F.filter(let(pairs, last_of_each), lambda _: text.startswith("---\n"))
    return F.map_from_entries(entries)


def header_of(value) -> Column:
    """Raw header text, NULL when the text has none."""
    return blank_to_null(F.regexp_extract(drop_bom(value), HEADER, 0))


def front_matter_title(value) -> Column:
    """Title in the header with outer quotes removed; NULL without header or title line."""
    found = blank_to_null(F.regexp_extract(header_of(value), rf"(?md)^title:[{P.WS}]*(.+?)[{P.WS}]*$", 1))
    return F.btrim(F.btrim(strip(found), F.lit('"')), F.lit("'"))


def strip_front_matter(value) -> Column:
    text = drop_bom(value)
    body = F.regexp_replace(F.regexp_replace(text, HEADER, ""), rf"\A[{P.WS}]+", "")
    return F.when(text.rlike(HEADER), body).otherwise(text)


def front_matter_value(value, key: str) -> Column:
    """First ``key: value`` line anywhere in the text, unquoted; empty when absent."""
    found = F.regexp_extract(col(value), rf"(?md)^\Q{key}\E:[ \t]*(.*?)[{P.WS}]*$", 1)
    return F.btrim(F.btrim(strip(found), F.lit('"')), F.lit("'"))


def yaml_scalar(value) -> Column:
    text = F.coalesce(col(value).cast("string"), F.lit(""))
    quoted = F.to_json(F.struct(text.alias("v")))
    needs_quotes = text.rlike(r'[:#\n"]') | text.startswith(" ") | text.endswith(" ")
    return F.when(needs_quotes, F.substr(quoted, F.lit(6), F.length(quoted) - 6)).otherwise(text)


def render_front_matter(fields: dict[str, Column], body: Column) -> Column:
    """Header in the fixed key order followed by the trimmed body."""
    rows = [F.concat(F.lit(f"{key}: "), yaml_scalar(fields.get(key, F.lit("")))) for key in P.FRONT_MATTER_KEYS]
    return F.concat_ws("\n", F.lit("---"), *rows, F.lit("---"), F.lit(""), strip(body), F.lit(""))
