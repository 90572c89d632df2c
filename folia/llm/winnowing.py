"""Benchmark decontamination by winnowing.

Fingerprints are the least hash of five words in every window of six such runs, so any ten words that a
document shares with a benchmark item share a fingerprint as well.  The benchmark's fingerprints go to the
tasks in blocks of bounded bytes, the documents' fingerprints meet them there, and each meeting is extended
to the ten-word windows around it, which are compared word by word.  A benchmark item of fewer than ten
words is one window; its length's runs are all fingerprints, as a window of one run keeps them all.

Defined results: NULL and empty texts have no words and no hits; an item without words is never found; an
item without an id marks words as hit but is not listed; repeated items with one id count once; equal
documents give equal rows; other columns are not read.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.words import PLAIN, Words, parts, record, run_hashes
from folia.sources.shared import stored

WINDOW, RUN = 10, 5
SPAN = WINDOW - RUN + 1
#: Bytes of benchmark text in one block.  A larger benchmark is compared block by block.
BLOCK_BYTES = 16 << 20


def chosen(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of five words, and whether some window of six runs within one text has it as its least."""
    runs = run_hashes(hashes, RUN)
    windows = len(runs) - SPAN + 1
    keep = np.zeros(len(runs), dtype=bool)
    if windows <= 0:
        return runs, keep
    least = runs[:windows].copy()
    for j in range(1, SPAN):
        np.minimum(least, runs[j : j + windows], out=least)
    whole = text[:windows] == text[WINDOW - 1 : WINDOW - 1 + windows]
    for j in range(SPAN):
        keep[j : j + windows] |= whole & (runs[j : j + windows] == least)
    return runs, keep


class Index:
    """Fingerprints and windows of one block of items."""

    def __init__(self, items: list[tuple[str | None, str]]) -> None:
        words = Words([t for _, t in items], PLAIN, lower=True)
        runs, keep = chosen(words.hashes, words.text_of_words())
        self.prints = np.unique(runs[keep])
        self.windows: dict[bytes, set[str | None]] = {}
        self.short: dict[int, np.ndarray] = {}
        short: dict[int, list[np.uint64]] = {}
        for (item, _), a, b in zip(items, words.first, words.first[1:]):
            length = min(WINDOW, int(b - a))
            if not length:
                continue
            spelled = [words.word(i) for i in range(a, b)]
            for i in range(len(spelled) - length + 1):
                self.windows.setdefault(b" ".join(spelled[i : i + length]), set()).add(item)
            if length < WINDOW:
                short.setdefault(length, []).append(run_hashes(words.hashes[a:b], length)[0])
        self.short = {n: np.unique(np.array(v, dtype=np.uint64)) for n, v in short.items()}

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set[str | None]]]:
        """Words inside occurrences, and the items that occur in each text."""
        text = words.text_of_words()
        covered = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        found: dict[int, set[str | None]] = {}
        for length, starts in self._candidates(words, text):
            for s in starts.tolist():
                items = self.windows.get(b" ".join(words.word(i) for i in range(s, s + length)))
                if items is not None:
                    covered[s] += 1
                    covered[s + length] -= 1
                    found.setdefault(int(text[s]), set()).update(items)
        return np.cumsum(covered[:-1]) > 0, found

    def _candidates(self, words: Words, text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if len(self.prints):
            runs, keep = chosen(words.hashes, text)
            places = np.flatnonzero(keep)
            places = places[member(runs[places], self.prints)]
            starts = np.unique((places[:, None] - np.arange(SPAN)).ravel())
            starts = starts[(starts >= 0) & (starts + WINDOW <= len(text))]
            yield WINDOW, starts[text[starts] == text[starts + WINDOW - 1]]
        for length, prints in self.short.items():
            starts = np.flatnonzero(member(run_hashes(words.hashes, length), prints))
            yield length, starts[text[starts] == text[starts + length - 1]]


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array; most are turned away by their upper sixteen bits."""
    upper = np.zeros(1 << 16, dtype=bool)
    upper[(among >> np.uint64(48)).astype(np.int64)] = True
    maybe = upper[(values >> np.uint64(48)).astype(np.int64)]
    place = np.flatnonzero(maybe)
    at = np.searchsorted(among, values[place])
    maybe[place] = among[np.minimum(at, len(among) - 1)] == values[place]
    return maybe


def _digest(items: set[str | None]) -> tuple[int, str]:
    ids = sorted(i for i in items if i is not None)
    return len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()


def _scan(index: Index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in parts(batches):
            words = Words(texts, PLAIN, lower=True)
            hit, found = index.hits(words)
            before = np.concatenate([[0], np.cumsum(hit)])
            n_hit = before[words.first[1:]] - before[words.first[:-1]]
            counts, digests = zip(*(_digest(found.get(i, set())) for i in range(len(texts))))
            yield record({
                "doc_id": rows.column("doc_id"), "n_words": np.diff(words.first).astype(np.int64), "n_hit": n_hit.astype(np.int64),
                "n_items": pa.array(counts, pa.int64()), "items_sha256": digests, "contaminated": n_hit > 0,
            })

    return scan


def _marks(index: Index):
    """Per contaminated row: its key, the places of its hit words, and the items found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in parts(batches):
            words = Words(texts, PLAIN, lower=True)
            hit, found = index.hits(words)
            keys, out = rows.column("row_key").to_pylist(), []
            for i in sorted(found):
                a, b = words.first[i], words.first[i + 1]
                out.append((keys[i], np.flatnonzero(hit[a:b]).tolist(), [x for x in found[i] if x is not None]))
            if out:
                key, places, items = zip(*out)
                yield record({
                    "row_key": pa.array(key, pa.string()), "places": pa.array(places, pa.list_(pa.int64())),
                    "items": pa.array(items, pa.list_(pa.string())),
                })

    return scan


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in parts(batches):
        words = Words(texts, PLAIN, lower=True)
        yield record({"doc_id": rows.column("doc_id"), "row_key": rows.column("row_key"), "n_words": np.diff(words.first).astype(np.int64)})


class Blocks:
    """The benchmark's indexes, made one at a time: items are dealt by hash to blocks of about ``block_bytes``."""

    def __init__(self, benchmark: DataFrame, block_bytes: int) -> None:
        items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
        self.items = items.filter(F.col("text").isNotNull())
        size = self.items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
        self.blocks = -(-int(size) // block_bytes) or 1

    def __len__(self) -> int:
        return self.blocks

    def __iter__(self) -> Iterator[Index]:
        for block in range(self.blocks):
            of_block = self.items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(self.blocks)) == block)
            yield Index([(r["item"], r["text"]) for r in of_block.toLocalIterator()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: words, hit words, items found and the verdict.

    ``benchmark(item_id, text)`` is measured first.  Up to ``block_bytes`` it goes to the tasks whole and no
    row is shuffled; beyond, each block makes one pass that returns the marks of contaminated rows alone.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    blocks = Blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        schema = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
        return docs.mapInArrow(_scan(next(iter(blocks))), schema)

    keyed = docs.withColumn("row_key", F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "text"), 256))
    marks = None
    for index in blocks:
        part = stored(keyed.mapInArrow(_marks(index), "row_key string, places array<bigint>, items array<string>"), "marks")
        marks = part if marks is None else marks.unionByName(part)
    hits = marks.select("row_key", F.explode("places").alias("p")).groupBy("row_key").agg(F.countDistinct("p").alias("n_hit"))
    ids = marks.select("row_key", F.explode_outer("items").alias("i")).groupBy("row_key")
    ids = ids.agg(F.array_sort(F.collect_set("i")).alias("ids"))
    counted = keyed.mapInArrow(_counted, f"doc_id {kind}, row_key string, n_words bigint")
    n_hit, ids_or_none = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.coalesce("ids", F.array().cast("array<string>"))
    return counted.join(hits, "row_key", "left").join(ids, "row_key", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids_or_none).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids_or_none, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _clean(index: Index):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in parts(batches):
            words = Words(texts, PLAIN, lower=True)
            _, found = index.hits(words)
            yield rows.filter(pa.array([i not in found for i in range(len(texts))], pa.bool_()))

    return keep


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; ``text`` must be a string column.

    Each block of the benchmark filters what the one before it left.
    """
    for index in Blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(_clean(index), docs.schema)
    return docs
