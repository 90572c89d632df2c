"""Quality classifier from weak labels.

Eight heuristic labellers vote good, bad or nothing on every text.  Expectation-maximisation over the counts of
vote patterns estimates how often each labeller is right on either class, without any given label; the posterior of
a text's pattern is its weak label.  On a bounded sample of texts these labels train a linear scorer over hashed
words and hashed word shapes, which scores every whole text.

Defined results: NULL and empty texts score 0 and are not kept; equal texts score equally; if all texts vote alike,
the posterior decides for all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm import signals as S
from folia.llm.words import LOWER, mixed, parts, record

LABELLERS = ("symbols", "capitals", "shouting", "repetition", "length", "sentences", "word_length", "digits")
GOOD, BAD, NOTHING = 2, 0, 1
#: Documents that the scorer is fitted on at most (about), and words beyond which a document is not used for it.
SAMPLE_DOCS, SAMPLE_WORDS = 4000, 20_000
BUCKETS, SHAPES = 1 << 15, 256
KEEP = 0.5


def votes(s: S.Signals) -> np.ndarray:
    """One column per labeller.  Bounds are stated per share of characters or words."""
    kinds = s.text_kinds().astype(np.float64)
    solid = np.maximum(kinds.sum(axis=1) - kinds[:, S.SPACE], 1)
    letters = np.maximum(kinds[:, S.LOW] + kinds[:, S.UP] + kinds[:, S.WIDE], 1)
    words = np.maximum(s.n_words, 1).astype(np.float64)

    def vote(value: np.ndarray, good: tuple[float, float], bad: tuple[float, float]) -> np.ndarray:
        """Good inside the first range, bad outside the second, nothing in between."""
        is_good = (value >= good[0]) & (value <= good[1])
        return np.where(is_good, GOOD, np.where((value < bad[0]) | (value > bad[1]), BAD, NOTHING))

    columns = [
        vote(kinds[:, S.SYMBOL] / solid, (0, 0.01), (0, 0.04)),
        vote(kinds[:, S.UP] / letters, (0, 0.15), (0, 0.4)),
        vote(kinds[:, S.SHOUT] / words, (0, 0.01), (0, 0.1)),
        vote(s.n_repeat_words / words, (0, 0.1), (0, 0.4)),
        vote(words, (60, np.inf), (15, np.inf)),
        vote(kinds[:, S.STOP] / words, (0.04, 0.4), (0.01, 1.0)),
        vote(solid / words, (3.0, 9.0), (2.0, 14.0)),
        vote(kinds[:, S.DIGIT] / solid, (0, 0.05), (0, 0.25)),
    ]
    return np.stack(columns, axis=1)


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Vote probabilities by class, labeller and vote, and the share of good texts, by expectation-maximisation."""
    v = votes_of(patterns)
    good = np.clip(0.5 + (v - 1).mean(axis=1), 0.05, 0.95)  # starts from the majority
    table, share = np.full((2, len(LABELLERS), 3), 1 / 3), 0.5
    for _ in range(rounds):
        for y, weight in ((0, counts * (1 - good)), (1, counts * good)):
            for j in range(len(LABELLERS)):
                seen = np.bincount(v[:, j], weights=weight, minlength=3) + 1.0
                table[y, j] = seen / seen.sum()
        share = float((counts @ good + 1) / (counts.sum() + 2))
        good = posterior(patterns, table, share)
    return table, share


def posterior(patterns: np.ndarray, table: np.ndarray, share: float) -> np.ndarray:
    v = votes_of(patterns)
    places = np.arange(len(LABELLERS))
    odds = np.log(share / (1 - share)) + (np.log(table[1, places, v]) - np.log(table[0, places, v])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of vote patterns, one row per pattern and part of a batch."""
    for _, texts in parts(batches):
        found, n = np.unique(pattern_of(votes(S.Signals(texts))), return_counts=True)
        yield record({"pattern": found.astype(np.int64), "n": n.astype(np.int64)})


def hashed_words(s: S.Signals) -> tuple[np.ndarray, np.ndarray]:
    """Of every word a bucket of its lower-case bytes and a bucket of its shape."""
    w = s.words
    lower = S.Words.__new__(S.Words)
    lower.data, lower.starts, lower.ends = LOWER[w.data], w.starts, w.ends
    word = (mixed(lower._hashes()) >> np.uint64(49)).astype(np.int64)
    shape = np.zeros(len(w.starts), dtype=np.int64)
    size = w.ends - w.starts
    for bit, kind in enumerate((S.UP, S.DIGIT, S.SYMBOL, S.SHOUT, S.STOP)):
        total = np.concatenate([[0], np.cumsum(s.kinds == kind)])
        has = total[w.ends] - total[w.starts]
        shape |= (has > 0).astype(np.int64) << bit
        if kind == S.UP:
            shape |= ((has == size) & (size > 1)).astype(np.int64) << 5
    return word, shape + 64 * np.digitize(size, (3, 6, 10))


def _sampled(table: np.ndarray, share: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in parts(batches):
            s = S.Signals(texts)
            good = posterior(pattern_of(votes(s)), table, share)
            word, shape = hashed_words(s)
            out = []
            for i, (a, b) in enumerate(zip(s.words.first, s.words.first[1:])):
                if 0 < b - a <= SAMPLE_WORDS:
                    seen, n = np.unique(np.concatenate([word[a:b], BUCKETS + shape[a:b]]), return_counts=True)
                    out.append((float(good[i]), seen.tolist(), (n / (b - a)).tolist()))
            if out:
                g, k, x = zip(*out)
                yield record({"good": pa.array(g), "keys": pa.array(k, pa.list_(pa.int32())), "shares": pa.array(x, pa.list_(pa.float32()))})

    return scan


def fit(rows: list[tuple[float, list[int], list[float]]], *, epochs: int = 60, rate: float = 0.5, penalty: float = 1e-6) -> np.ndarray:
    """Weights of a logistic scorer for soft labels, by gradient steps scaled per feature."""
    weights = np.zeros(BUCKETS + SHAPES + 1)
    if not rows:
        return weights
    keys = np.concatenate([np.array(k, dtype=np.int64) for _, k, _ in rows])
    values = np.concatenate([np.array(x) for _, _, x in rows])
    doc = np.repeat(np.arange(len(rows)), [len(k) for _, k, _ in rows])
    good = np.array([g for g, _, _ in rows])
    mass = max(good.sum(), 1.0), max((1 - good).sum(), 1.0)
    weight = good / mass[0] + (1 - good) / mass[1]
    size = np.full(len(weights), 1e-10)
    for _ in range(epochs):
        z = np.bincount(doc, weights=values * weights[keys], minlength=len(rows)) + weights[-1]
        pull = (good / mass[0] * (1 / (1 + np.exp(z))) - (1 - good) / mass[1] * (1 / (1 + np.exp(-z)))) / weight.sum()
        grad = np.bincount(keys, weights=values * pull[doc], minlength=len(weights))
        grad[-1] = pull.sum()
        grad -= penalty * weights
        size += grad**2
        weights += rate * grad / np.sqrt(size)
    return weights


def train(docs: DataFrame, *, limit: int = SAMPLE_DOCS) -> np.ndarray:
    """Scorer weights.  Votes are counted over all documents; the driver gets at most 3^8 pattern counts."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    rows = texts.select("text").mapInArrow(_patterns, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not rows:
        return np.zeros(BUCKETS + SHAPES + 1)
    patterns, counts = np.array([r["pattern"] for r in rows]), np.array([r["n"] for r in rows], dtype=np.float64)
    table, share = estimate(patterns, counts)
    part = min(1.0, limit / counts.sum())
    chosen = F.pmod(F.xxhash64(F.lit(29), F.col("doc_id").cast("string"), F.crc32(F.col("text").cast("binary"))), F.lit(1 << 30))
    sample = texts.filter(chosen < int(part * (1 << 30))).select("text")
    found = sample.mapInArrow(_sampled(table, share), "good double, keys array<int>, shares array<float>").collect()
    return fit(sorted((r["good"], r["keys"], r["shares"]) for r in found))


def score(docs: DataFrame, weights: np.ndarray, *, keep: float = KEEP) -> DataFrame:
    """``(doc_id, score, kept)`` per row of ``docs(doc_id, text)``.  No shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in parts(batches):
            s = S.Signals(texts)
            word, shape = hashed_words(s)
            text = s.words.text_of_words()
            z = np.bincount(text, weights=weights[word] + weights[BUCKETS + shape], minlength=len(texts))
            p = 1 / (1 + np.exp(-np.clip(z / np.maximum(s.n_words, 1) + weights[-1], -40, 40)))
            p = np.where(s.n_words > 0, p, 0.0)
            yield record({"doc_id": rows.column("doc_id"), "score": p, "kept": p >= keep})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, score double, kept boolean")
