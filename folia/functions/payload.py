"""JSON recovery from free text, and message parts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folia import profiles as P
from folia.functions.text import col, strip


def payload_candidates(value) -> Column:
    """Fenced blocks first, then the whole text; trimmed, empty ones dropped."""
    text = strip(value)
    fenced = F.regexp_extract_all(text, F.lit(rf"(?is)```(?:json)?[{P.WS}]*(.*?)```"), F.lit(1))
    return F.filter(F.transform(F.concat(fenced, F.array(text)), strip), lambda c: c != "")


#: A string (open at the end of the text or not) or a bracket; other characters never matter.
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|[{}\[\]]', re.S)
_OPENER = re.compile(r"[{\[]")
_OPENS = {"}": "{", "]": "["}


def _brackets(text: str, start: int) -> tuple[dict[int, int], set[int]]:
    """Read from ``start``: where each bracket of either kind closes, and all brackets that opened."""
    waiting: dict[str, list[int]] = {"{": [], "[": []}
    closed, opened = {}, set()
    for token in _TOKEN.finditer(text, start):
        sign = token[0]
        if sign in waiting:
            waiting[sign].append(token.start())
            opened.add(token.start())
        elif sign in _OPENS and waiting[_OPENS[sign]]:
            closed[waiting[_OPENS[sign]].pop()] = token.end()
    return closed, opened


def _balanced(text: str) -> str | None:
    """The first substring from a brace or bracket to where its own kind is balanced.

    One reading settles every bracket that it sees outside strings; only a bracket inside what was read as a
    string starts another reading.
    """
    ends: dict[int, int] = {}
    settled: set[int] = set()
    for opener in _OPENER.finditer(text):
        at = opener.start()
        if at not in settled:
            closed, opened = _brackets(text, at)
            ends |= {k: v for k, v in closed.items() if k not in settled}
            settled |= opened
        if at in ends:
            return text[at : ends[at]]
    return None


def _loads(text: str | None):
    try:
        return json.dumps(json.loads(text), ensure_ascii=False) if text is not None else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _first_payload(candidates: pd.Series) -> pd.Series:
    def pick(found) -> str | None:
        for candidate in found if found is not None else ():
            payload = _loads(candidate) or _loads(_balanced(candidate))
            if payload is not None:
                return payload
        return None

    return candidates.map(pick)


def json_payload(value) -> Column:
    """First JSON document found in model output, re-serialised; NULL when there is none."""
    return _first_payload(payload_candidates(value))


def message_text(parts: Column) -> Column:
    """Readable text of ``array<map<string,string>>`` message parts."""

    def one(part: Column) -> Column:
        def value(key: str) -> Column:
            return strip(F.coalesce(F.try_element_at(part, F.lit(key)), F.lit("")))

        kind = F.coalesce(F.try_element_at(part, F.lit("type")), F.lit(""))
        tool = value("toolName")
        return (
            F.when(kind.isin("text", "reasoning"), value("text"))
            .when((kind == "tool-call") & (tool != ""), F.concat(F.lit("[tool:"), tool, F.lit("]")))
            .when(kind == "source", F.when(value("title") != "", value("title")).otherwise(value("url")))
            .otherwise("")
        )

    return strip(F.array_join(F.filter(F.transform(col(parts), one), lambda t: t != ""), "\n"))
