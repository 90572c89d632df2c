"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: words, and beginnings of words, that toxic documents have far more
often than others.  It becomes a trie; a Levenshtein automaton of one edit runs through the trie with each
distinct word of a text, so misspelled terms are caught: whole words of six characters or more with one character
missing, added or wrong, or two neighbours exchanged, the first letter kept.
Each match is weighed by the words around it: quotation marks and reporting words lower it, the second person
raises it.  A logistic model over the weighed matches gives the score.

Only rows whose crc32 of the id's text modulo 4 is not 2 teach the model.  It is fitted on a bounded sample; the
label, language, source and id of a row are never inputs of its score.  Defined results: NULL and empty texts
score as texts without a match; without labels of both kinds every text scores 0; equal texts score equally;
a document with several labels counts as toxic if one says so; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.samples import labelled_sample
from folia.llm.words import parts, record

#: Labelled documents that the model is fitted on at most (about), and terms in the lexicon at most.
SAMPLE_DOCS, TERMS = 12_000, 400
SHORTEST, LONGEST, FUZZY = 3, 8, 6
LEAST_SUPPORT, LEAST_PRECISION = 4, 0.5
WORD = re.compile(r"\w+")
WINDOW = 6
#: Words that report or discuss what somebody said, and words that address somebody; fixed values.
REPORTING = frozenset(
    "said says say saying quote quoted quotes called calls wrote writes word words term phrase insult slur reported according".split()
)
ADDRESS = frozenset("you your yours youre u ur are tu toi vous te ti usted du dich dir ihr sie".split())
QUOTES = frozenset("\"'“”„«»‘’`")
REPORTED, QUOTED, ADDRESSED = 0.4, 0.3, 1.2
CACHE = 400_000
FEATURES = 7


def teaches() -> Column:
    return F.pmod(F.crc32(F.col("labelled_id").cast("string").cast("binary")), F.lit(4)) != 2


# --- lexicon -----------------------------------------------------------------------------------
def _stems(text: str) -> set[str]:
    """Distinct words (marked by a final space) and beginnings of words of three to eight characters."""
    words = set(WORD.findall(text.lower()))
    found = {w + " " for w in words if len(w) >= SHORTEST}
    for n in range(SHORTEST, LONGEST + 1):
        found.update([w[:n] for w in words if len(w) > n])
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stems of toxic documents and how many toxic and other documents of these rows have them."""
    toxic, other = Counter(), Counter()
    for rows, texts in parts(batches):
        for text, label in zip(texts, rows.column("label").to_pylist()):
            (toxic if label > 0 else other).update(_stems(text))
    stems = sorted({*toxic, *(s for s, n in other.items() if n)})
    for at in range(0, len(stems), 50_000):
        part = stems[at : at + 50_000]
        yield record({
            "stem": pa.array(part, pa.string()), "toxic": pa.array([toxic[s] for s in part], pa.int64()), "other": pa.array([other[s] for s in part], pa.int64()),
        })


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms with their weights (log-odds).

    Of nested beginnings the shortest stays that is nearly as precise.  Whole words that can be misspelled stay beside
    their beginnings, since only they take edits; equal texts of a label count once, so a term needs several
    different documents.
    """
    counted = sample.select("text", "label").distinct().mapInArrow(_counted, "stem string, toxic bigint, other bigint")
    counted = counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    precise = F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("other"))
    useful = counted.filter((F.col("toxic") >= LEAST_SUPPORT) & precise)
    gain = F.col("toxic") * F.log((F.col("toxic") + 0.5) / (F.col("other") + 0.5))
    rows = useful.withColumn("gain", gain).orderBy(F.desc("gain"), "stem").limit(8 * TERMS).collect()
    odds = {r["stem"]: float(np.log((r["toxic"] + 0.5) / (r["other"] + 0.5))) for r in rows}
    chosen: dict[str, float] = {}
    for stem in sorted(odds, key=lambda s: (len(s.rstrip()), s)):
        plain = stem.rstrip()
        above = [chosen[plain[:n]] for n in range(SHORTEST, len(plain) + (stem != plain)) if plain[:n] in chosen]
        if not above or odds[stem] > max(above) + 1.0:
            chosen[stem] = odds[stem]
    best = dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:TERMS])
    whole = [s for s in odds if s.endswith(" ") and len(s) > FUZZY]
    return best | {s: odds[s] for s in whole[:TERMS]}


# --- automaton ---------------------------------------------------------------------------------
class Automaton:
    """The lexicon's trie, walked by all words within one edit of a path.

    A state is the set of trie nodes that are reached, each with the least number of edits; ``~node`` stands for a
    node that is reached once the earlier of two exchanged characters follows.  States are made when first reached and kept, so a walk costs one dictionary lookup for each character.
    """

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.whole: list[float] = [0.0]
        self.begins: list[float] = [0.0]
        self.reach: list[int] = [0]
        self.above: list[str] = [""]  # character that leads to the parent
        for term, weight in lexicon.items():
            plain, node = term.rstrip(), 0
            for before, c in zip(" " + plain, plain):
                if c not in self.children[node]:
                    for column, empty in ((self.children, {}), (self.whole, 0.0), (self.begins, 0.0), (self.reach, 0), (self.above, before)):
                        column.append(empty)
                    self.children[node][c] = len(self.children) - 1
                node = self.children[node][c]
                if term != plain:
                    self.reach[node] = max(self.reach[node], len(plain))
            kind = self.whole if term != plain else self.begins
            kind[node] = max(kind[node], weight)
        self.states: dict[frozenset, int] = {}
        self.members: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})
        self.dead = self._state({})
        self.known: dict[str, tuple[float, bool]] = {}

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(nodes)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        """A matching character keeps the edits; an extra, a wrong, a missing one and an exchange cost one, in long terms alone."""
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits < after.get(node, 2):
                after[node] = edits

        for node, edits in self.members[state].items():
            if node < 0:
                if self.above[~node] == c:
                    reach(~node, 1)
                continue
            exact = self.children[node].get(c)
            if exact is not None:
                reach(exact, edits)
            if edits == 0 and node:
                if self.reach[node] >= FUZZY:
                    reach(node, 1)
                for child in self.children[node].values():
                    if self.reach[child] >= FUZZY:
                        reach(child, 1)
                        if c in self.children[child]:
                            reach(self.children[child][c], 1)
                            reach(~self.children[child][c], 1)
        found = self._state(after)
        self.steps[state][c] = found
        return found

    def __call__(self, word: str) -> tuple[float, bool]:
        """The weight of the best term that a word matches (0: none), and whether it took an edit."""
        known = self.known.get(word)
        if known is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            known = self.known[word] = self._walk(word)
        return known

    def _walk(self, word: str) -> tuple[float, bool]:
        state, begun = self.start, 0.0
        for c in word:
            step = self.steps[state].get(c)
            state = self._step(state, c) if step is None else step
            if state == self.dead:
                return begun, False
            begun = max(begun, max((self.begins[n] for n, e in self.members[state].items() if e == 0), default=0.0))
        exact = max((self.whole[n] for n, e in self.members[state].items() if e == 0), default=0.0)
        if exact > 0:
            return max(exact, begun), False
        near = 0.0
        for n, e in self.members[state].items():
            if e == 1:
                near = max(near, self.whole[n] if n >= 0 and self.reach[n] >= FUZZY else 0.0)
            else:  # the last character of a term may be missing
                near = max([near, *(self.whole[k] for k in self.children[n].values() if self.reach[k] >= FUZZY)])
        # a misspelt word may begin like a weaker term
        return (near, True) if near > begun else (begun, False)


def features(text: str, match: Automaton) -> list[float]:
    lower = text.lower()
    words = WORD.findall(lower)
    get = match.known.get
    hits = []
    for i, w in enumerate(words):
        found = get(w) or match(w)
        if found[0] > 0:
            hits.append((i, *found))
    if not hits:
        return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    wanted = {i for i, _, _ in hits}
    quoted = {i for i, m in enumerate(WORD.finditer(lower)) if i in wanted and _in_quotes(lower, *m.span())}
    exact = fuzzy = best = 0.0
    terms = set()
    for i, weight, edited in hits:
        near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        factor = QUOTED if i in quoted else 1.0
        factor *= REPORTED if any(w in REPORTING for w in near) else 1.0
        factor *= ADDRESSED if any(w in ADDRESS for w in near) else 1.0
        exact, fuzzy = (exact, fuzzy + weight * factor) if edited else (exact + weight * factor, fuzzy)
        best = max(best, weight * factor)
        terms.add(words[i])
    n = np.log1p(len(words))
    return [1.0, float(np.log1p(exact)), float(np.log1p(fuzzy)), best / 4, float(np.log1p(len(terms))), float(np.log1p(exact) / n), float(np.log1p(100 * len(hits) / len(words)))]


def _in_quotes(text: str, a: int, b: int) -> bool:
    return a > 0 and b < len(text) and text[a - 1] in QUOTES and text[b] in QUOTES


# --- model -------------------------------------------------------------------------------------
@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray | None = None


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method with a ridge penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, limit: int = SAMPLE_DOCS) -> Model:
    sample = labelled_sample(docs, labels, "toxic", limit, teaches())
    lexicon = learn_lexicon(sample)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Automaton(lexicon)
        for rows, texts in parts(batches):
            x = [features(t, match) for t in texts]
            yield record({"label": rows.column("label"), "x": pa.array(x, pa.list_(pa.float64()))})

    rows = sorted((r["label"] > 0, r["x"]) for r in sample.mapInArrow(featured, "label int, x array<double>").collect())
    y = np.array([r[0] for r in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(lexicon)
    return Model(lexicon, _fit(np.array([r[1] for r in rows]), y))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text)``.  No shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Automaton(model.lexicon)
        for rows, texts in parts(batches):
            if model.weights is None:
                p = np.zeros(len(texts))
            else:
                x = np.array([features(t or "", match) for t in texts])
                p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield record({"doc_id": rows.column("doc_id"), "score": p})

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
