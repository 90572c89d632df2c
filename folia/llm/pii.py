"""Personal data in whole texts: patterns propose, checksums confirm, context words decide the doubtful.

Four base kinds (e-mail, IPv4 address, payment card, international phone number) are found by pattern,
leftmost first and without overlap, and confirmed by their own rule; failing matches are dropped and not
tried again.  The method adds bank account numbers confirmed by the remainder modulo 97, and shorter card
numbers and phone numbers without a country code where the words around them raise their score.

NULL and empty texts have no spans.  Equal rows give equal results; columns other than the id and the text
are not read.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.words import parts, record

KINDS = ("email", "ip", "card", "phone")
ADDED = "iban"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A pattern that opens with a class of characters is searched faster than one that opens with a look back, so that comes second.
IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?<![0-9]{2})(?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]){11,30}")
SHORTEST_IBAN, LONGEST_IBAN = 15, 34
#: Length of an account number by country; other countries may have any length.
LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
LOCAL_PHONE = re.compile(r"[(0-9](?<![0-9+)(.-][(0-9])(?:(?<=\()[0-9]{3}|(?<!\()[0-9]{2})\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
#: Every kind has a digit or an at sign.
SOME = "[0-9@]"
#: Words that make a doubtful number likely, by kind; fixed values.
CONTEXT = {
    "card": frozenset("card cards visa mastercard amex credit debit cvv payment carte karte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon telefono téléphone teléfono ring".split()),
}
WINDOW = 48
PRIOR, CUE, ACCEPT = 0.4, 0.3, 0.6
WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Country and check digits go to the end, letters count from ten, and the remainder must be one."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def accounts(text: str) -> list[tuple[int, int]]:
    """Account numbers, leftmost first: of the ends at a token border, with the country's length, the last that the remainder confirms."""
    found, floor = [], 0
    while m := IBAN.search(text, floor):
        floor = m.start() + 1
        for end in range(m.end(), m.start() + SHORTEST_IBAN - 1, -1):
            if text[end - 1] == " " or text[end : end + 1].isascii() and text[end : end + 1].isalnum():
                continue
            account = text[m.start() : end].replace(" ", "")
            if SHORTEST_IBAN <= len(account) <= LONGEST_IBAN and LENGTHS.get(account[:2], len(account)) == len(account) and mod97(account):
                found.append((m.start(), end))
                floor = end
                break
    return found


def emails(text: str) -> list[tuple[int, int]]:
    """Grown to the left from each at sign, so a long run without one costs nothing."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            found.append((start, domain.end()))
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)
    return found


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def context_score(text: str, start: int, end: int, kind: str) -> float:
    """A prior, and a share for each nearby context word of the kind."""
    near = WORD.findall(text[max(0, start - WINDOW) : start].lower()) + WORD.findall(text[end : end + WINDOW].lower())
    return min(1.0, PRIOR + CUE * sum(w in CONTEXT[kind] for w in near))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return spans


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans beyond the base ones that don't overlap them."""
    taken = np.array([(a, b) for _, a, b in base], dtype=np.int64).reshape(-1, 2)

    def free(a: int, b: int) -> bool:
        return not ((taken[:, 0] < b) & (taken[:, 1] > a)).any()

    found = []
    found += [(ADDED, a, b) for a, b in accounts(text) if free(a, b)]
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13 or not 13 <= len(d := digits_of(m[0])) <= 15 or not luhn(d):
            continue
        if free(*m.span()) and context_score(text, *m.span(), "card") >= ACCEPT:
            found.append(("card", *m.span()))
    for m in LOCAL_PHONE.finditer(text):
        if free(*m.span()) and context_score(text, *m.span(), "phone") >= ACCEPT:
            found.append(("phone", *m.span()))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (rank[s[0]], s[1], s[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in parts(batches):
        out = []
        for text in texts:
            base = base_spans(text or "")
            kinds = [s[0] for s in base]
            every = base + added_spans(text or "", base)
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            out.append((*(kinds.count(k) for k in KINDS), digest, joined(every)))
        columns = list(zip(*out))
        counts = {f"n_{k}": pa.array(columns[i], pa.int64()) for i, k in enumerate(KINDS)}
        yield record({"doc_id": rows.column("doc_id"), **counts, "base_sha256": columns[-2], "spans": columns[-1]})


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of the base kinds, their digest, and all spans.  No shuffle.

    A text with neither a digit nor an at sign has no spans; Spark tells so, and such a text does not travel to Python.
    """
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {counts}, base_sha256 string, spans string"
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.when(text.rlike(SOME), text).alias("text")).mapInArrow(_scan, schema)
