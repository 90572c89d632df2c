"""Every question against every text, block by block.

Texts are dealt to blocks of bounded size and each block is sorted by the tie order of its ranking.  The questions of a
block stream past it in batches, so a task holds one block and one batch; a question leaves at most k rows per block.
Inside a block an inverted index of character runs tells which texts share how many runs with a question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM_SIZES = (2, 3, 4)
#: A block ends at so many texts or characters; small tables are cut finer, down to LEAST_TEXTS, so that every core has work.
BLOCK_TEXTS, BLOCK_CHARS, LEAST_TEXTS = 16_384, 2_000_000, 64
SCORE_DIGITS = 4
#: Scores this close to the k-th best may round to it.
SLACK = 10.0**-SCORE_DIGITS * 2
ROW = ("block", "is_question", "id", "text", "words", "marks", "grams")


def units_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of the texts, each closed by a zero, and the text that each unit is of."""
    units = np.frombuffer("\0".join([*texts, ""]).encode("utf-16-le", "surrogatepass"), np.uint16)
    ends = units == 0
    return units, np.cumsum(ends) - ends


def runs(codes: np.ndarray, rows: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``n`` known units as numbers, and their texts."""
    m = max(0, len(codes) - n + 1)
    value, whole = np.zeros(m, np.int64), np.ones(m, bool)
    for i in range(n):
        value = (value << bits) | codes[i : i + m]
        whole &= codes[i : i + m] > 0
    return value[whole], rows[:m][whole]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted different values; numpy's own ``unique`` hashes, which is ten times slower here."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


@dataclass
class Block:
    """Texts in tie order with an index of their runs, words and marks; the words of an empty text do not count."""

    ids: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    words: dict[str, list[int]] = field(default_factory=dict)
    marks: dict[tuple[int, str], list[int]] = field(default_factory=dict)

    def add(self, batch: pa.RecordBatch) -> None:
        for key, text, words, marks in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "words", "marks"))):
            row = len(self.ids)
            self.ids.append(key)
            self.texts.append(text)
            for w in words if text else ():
                self.words.setdefault(w, []).append(row)
            for i, mark in enumerate(marks):
                if mark is not None:
                    self.marks.setdefault((i, mark), []).append(row)

    def index(self) -> None:
        self.rows_of = {w: np.array(rows) for w, rows in self.words.items()}
        units, of = units_of(self.texts)
        present = np.flatnonzero(np.bincount(units, minlength=1 << 16)[1:]) + 1
        self.code = np.zeros(1 << 16, np.int64)
        self.code[present] = np.arange(1, len(present) + 1)
        self.bits, shift = len(present).bit_length(), len(self.texts).bit_length()
        codes, every, at = self.code[units], [], 0
        self.runs, self.starts = [], []
        for n in GRAM_SIZES:
            value, row = runs(codes, of, n, self.bits)
            names = None
            if n * self.bits + shift > 62:
                names, value = np.unique(value, return_inverse=True)
            key = _distinct((value << shift) | row)
            value, row = key >> shift, (key & ((1 << shift) - 1)).astype(np.int32)
            first = np.flatnonzero(np.diff(value, prepend=-1))
            self.runs.append(value[first] if names is None else names[value[first]])
            self.starts.append(np.append(first, len(row)) + at)
            every.append(row)
            at += len(row)
        self.rows = np.concatenate(every)

    def shared(self, questions: list[str]) -> Iterator[np.ndarray]:
        """Per question the texts that share runs with it, one entry for each different run that both have."""
        units, of = units_of(questions)
        codes, found = self.code[units], [(np.empty(0, np.int64),) * 3]
        for n, known_runs, starts in zip(GRAM_SIZES, self.runs, self.starts):
            value, row = runs(codes, of, n, self.bits)
            if len(known_runs) and len(value):
                place = np.minimum(np.searchsorted(known_runs, value), len(known_runs) - 1)
                known = known_runs[place] == value
                row, place = np.divmod(_distinct(row[known] * len(known_runs) + place[known]), len(known_runs))
                found.append((row, starts[place], starts[place + 1]))
        row, start, end = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(len(questions) + 1))
        start, end = start[order].tolist(), end[order].tolist()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            lists = [self.rows[x:y] for x, y in zip(start[a:b], end[a:b])]
            yield np.concatenate(lists) if lists else self.rows[:0]

    def with_words(self, words: list[str]) -> np.ndarray:
        """Texts that have the words, one entry for each time that a text has one."""
        return np.concatenate([np.empty(0, np.int64), *(self.rows_of[w] for w in words if w in self.rows_of)])


def rounded(scores: np.ndarray) -> np.ndarray:
    """Half-even by the decimal form of a score, as ``bround`` rounds."""
    scaled = scores * 10**SCORE_DIGITS
    out = np.rint(scaled) / 10**SCORE_DIGITS
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6).tolist():
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal(1).scaleb(-SCORE_DIGITS), ROUND_HALF_EVEN))
    return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and rounded scores of the first ``k`` by score and row; a score of zero is none."""
    wanted = scores > 0
    if len(scores) > k:
        wanted &= scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - SLACK
    rows = np.flatnonzero(wanted)
    score = rounded(scores[rows])
    order = np.argsort(-score, kind="stable")[:k]
    order = order[score[order] != 0]
    return rows[order], score[order]


#: Scores of all texts of a block for one question: (block, question, words, marks, number of grams, shared texts).
Scorer = Callable[[Block, str, list[str], list[str], int, np.ndarray], np.ndarray]


def ranked(texts: DataFrame, asked: DataFrame, ties: list[tuple[Column, bool]], scorer: Scorer, k: int) -> DataFrame:
    """``(q, t, score)``: the best ``k`` texts of every block for each question, and so of the whole table.

    ``texts(t, text, words, marks)`` with the columns that ``ties`` read, ``asked(q, text, words, marks, grams)``.  Equal
    scores go by ``ties``, each a column and whether it ascends; texts and words are not NULL.
    """
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    finest = min(2 * texts.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // LEAST_TEXTS))
    blocks = max(1, finest, -(-size["n"] // BLOCK_TEXTS), -(-size["chars"] // BLOCK_CHARS))
    names = [f"tie_{i}" for i in range(len(ties))]
    columns = [F.col(c) for c in ("text", "words", "marks")]
    ours = texts.select(
        F.pmod(F.xxhash64(F.lit(11), "t"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("is_question"), F.col("t").alias("id"), *columns,
        F.lit(0).alias("grams"), *(c.alias(n) for (c, _), n in zip(ties, names)),
    )
    theirs = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_question"), F.col("q").alias("id"), *columns, "grams"
    )
    order = [F.col(n).asc() if up else F.col(n).desc() for (_, up), n in zip(ties, names)]
    dealt = ours.unionByName(theirs, allowMissingColumns=True).repartitionById(blocks, F.col("block"))
    rows = dealt.sortWithinPartitions("block", "is_question", *order).select(*ROW)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, indexed = Block(), None, False
        for batch in batches:
            of = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if of[a] != number:
                    block, number, indexed = Block(), of[a], False
                some = batch.slice(a, b - a)
                first = int(np.argmax(np.append(some.column("is_question").to_numpy(zero_copy_only=False), True)))
                block.add(some.slice(0, first))
                some = some.slice(first)
                if not some.num_rows or not block.ids:
                    continue
                if not indexed:
                    block.index()
                    indexed = True
                yield _answers(block, some, scorer, k)

    return rows.mapInArrow(rank, "q bigint, t bigint, score double")


def _answers(block: Block, asked: pa.RecordBatch, scorer: Scorer, k: int) -> pa.RecordBatch:
    ids = np.array(block.ids, np.int64)
    q, t, s = ([np.empty(0, kind)] for kind in (np.int64, np.int64, np.float64))
    columns = [asked.column(c).to_pylist() for c in ("id", "text", "words", "marks", "grams")]
    for key, text, words, marks, grams, shared in zip(*columns, block.shared(columns[1])):
        rows, scores = best(scorer(block, text, words, marks, grams, shared), k)
        q.append(np.full(len(rows), key))
        t.append(ids[rows])
        s.append(scores)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, t, s)], ["q", "t", "score"])
