"""Grouping of spelling variants by dynamic programming over sorted word lists.

A word is compared with a sorted list by scanning it once.  The rows of the edit matrix, three cells wide since one
edit is allowed, are kept by depth, and the next word reuses them up to the prefix that it shares with the word
before.  When no cell of a row is below two, every word that shares the prefix read so far is skipped.  Many
words scan at the same time, one step of each in one array operation.

The vocabulary is dealt by parts of words.  Of two words at one edit, the first place where they differ lies in the
first or in the second half of the shorter one; so they share the half after it or the half before it.  A group
holds the words that share such a part, and for each length the words that are as long and one longer.  A group of
more than ``GROUP_WORDS`` is split by the same rule applied to what its words do not share yet, until its words
differ in one place only, where the alphabet bounds it.  The first difference of a pair lies in one group, so a pair
is found exactly once and no list is compared pair by pair.

Defined results: NULL texts have no words; a NULL id counts as an empty one; repeated rows count as often as they
stand; a word without near words has no form and is its own root; extra columns are not read.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.words import record
from folia.sources.shared import stored

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point.
MISPELT_OF = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent as its variant.
MORE_FREQUENT = 5
#: Words of one group, beyond which it is split.
GROUP_WORDS = 4096
#: Cells of kept matrix rows of the words that scan at one time.
CELLS = 1 << 24
#: Rows gathered for a scan, and letters of the words in it.
ROWS, LETTERS = 1 << 16, 1 << 21
KEY = ("s", "lo", "tail", "hi", "head_part", "tail_part")
FAR = 9


# --- words -----------------------------------------------------------------------------------
def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough; counted in the tasks that read them first."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUNS), F.lit(0))).alias("run"),
    )
    runs = runs.filter(F.char_length("run") >= LEAST_LENGTH).withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.pmod("h", F.lit(MISPELT_OF)) == 0, shorter).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


# --- groups ----------------------------------------------------------------------------------
def _keyed(words: DataFrame) -> DataFrame:
    """A group is named by its length, the shared ends of its words, and where their first difference may lie."""
    return words.withColumn("head_part", F.left("word", F.col("lo"))).withColumn("tail_part", F.right("word", F.col("tail")))


def _split(words: DataFrame) -> DataFrame:
    """Each group by the half of the free part before and the half after the first difference."""
    half = F.floor((F.col("s") - F.col("lo") - F.col("tail")) / 2).cast("int")
    before = words.withColumn("lo", F.col("lo") + half)
    after = words.select(
        "word", "n", "s", "lo", (F.col("s") - F.col("lo") - half).alias("tail"), F.least("hi", F.col("lo") + half).alias("hi")
    )
    return _keyed(before.select(*after.columns).unionByName(after))


def groups(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``words(word, n)`` once for each group that may hold a word near to them."""
    lengths = F.filter(F.array(F.char_length("word"), F.char_length("word") - 1), lambda s: s >= LEAST_LENGTH)
    start = words.select("word", "n", F.explode(lengths).alias("s"), F.lit(0).alias("lo"), F.lit(0).alias("tail"))
    level = stored(_split(start.withColumn("hi", F.col("s") + 1)), "words")
    ready = None
    while True:
        large = level.groupBy(*KEY).agg(F.count("*").alias("words"))
        large = stored(large.filter((F.col("words") > group_words) & (F.col("s") - F.col("lo") - F.col("tail") > 1)).drop("words"), "large")
        if large.limit(1).count() == 0:
            return level if ready is None else ready.unionByName(level)
        small = level.join(large, list(KEY), "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        level = stored(_split(level.join(large, list(KEY), "left_semi").select("word", "n", "s", "lo", "tail", "hi")), "words")


# --- the scan --------------------------------------------------------------------------------
class Lists:
    """Sorted lists laid end to end: code points, lengths and the prefix each word shares with the one before."""

    def __init__(self, words: list[str], new: np.ndarray) -> None:
        self.length = np.array([len(w) for w in words], dtype=np.int32)
        self.width = int(self.length.max())
        # a column of zeros on each side stands for the places before and after a word
        self.chars = np.zeros((len(words), self.width + 3), dtype=np.uint32)
        self.chars[:, 1:-2] = np.array(words, dtype=f"U{self.width}").view(np.uint32).reshape(len(words), self.width)
        self.shared = np.zeros(len(words), dtype=np.int32)
        self.shared[1:] = self.prefix(np.arange(1, len(words)), np.arange(len(words) - 1))
        self.shared[new] = -1
        # beyond[d][j]: the first word after j that shares fewer than d characters with its predecessor
        self.beyond = np.empty((self.width + 1, len(words)), dtype=np.int32)
        for d in range(self.width + 1):
            ends = np.append(np.flatnonzero(self.shared < d), len(words))
            self.beyond[d] = ends[np.searchsorted(ends, np.arange(len(words)), side="right")]

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the shared prefix of two words each."""
        x, y = self.chars[a, 1:-2], self.chars[b, 1:-2]
        differ = (x != y) | (x == 0)
        return np.where(differ.any(axis=1), differ.argmax(axis=1), self.width)


def near_in(lists: Lists, query: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a word of its list at one edit, where the word is longer or comes later.

    ``query`` are numbers of words and ``first`` those of the first words of their lists.  Cell ``k`` of row ``p`` is
    the distance between ``p`` characters of the word and ``p + k - 1`` of the query, or ``FAR``.
    """
    rows = np.full((len(query), lists.width + 2, 3), FAR, dtype=np.int8)
    rows[:, 0, 1], rows[:, 0, 2] = 0, 1
    active, word, depth = np.arange(len(query)), first.astype(np.int64), np.zeros(len(query), dtype=np.int64)
    left, right = [], []
    while len(active):
        own = query[active]
        letter = lists.chars[word, depth + 1]
        row = rows[active, depth]
        new = np.empty_like(row)
        for k in range(3):
            best = row[:, k] + (letter != lists.chars[own, depth + k])
            if k < 2:
                best = np.minimum(best, row[:, k + 1] + 1)
            if k:
                best = np.minimum(best, new[:, k - 1] + 1)
            # cells beyond the query's ends stay out
            end = depth + k
            new[:, k] = np.where((end >= 0) & (end <= lists.length[own]), np.minimum(best, FAR), FAR)
        depth = depth + 1
        rows[active, depth] = new
        out = new.min(axis=1) > 1
        done = ~out & (depth == lists.length[word])
        at = np.flatnonzero(done)
        cell = lists.length[own[at]] - depth[at] + 1
        hit = at[(cell >= 0) & (cell <= 2)]
        hit = hit[new[hit, lists.length[own[hit]] - depth[hit] + 1] == 1]
        hit = hit[(lists.length[word[hit]] > lists.length[own[hit]]) | ((lists.length[word[hit]] == lists.length[own[hit]]) & (word[hit] > own[hit]))]
        left.append(own[hit])
        right.append(word[hit])
        moved = np.flatnonzero(out | done)
        # past the words that share what was read, or to the next word, whose rows are known as far as it shares them
        target = np.where(out[moved], lists.beyond[depth[moved], word[moved]], word[moved] + 1)
        inside = target < len(lists.length)
        target[~inside] = 0
        again = lists.shared[target]
        ended = ~inside | (again < 0)
        word[moved], depth[moved] = target, np.maximum(again, 0)
        if ended.any():
            keep = np.ones(len(active), dtype=bool)
            keep[moved[ended]] = False
            active, word, depth = active[keep], word[keep], depth[keep]
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def _scan(table: pa.Table, new: np.ndarray) -> pa.RecordBatch | None:
    """Of whole groups, per word and group the number of near words and the most frequent, by order of spelling."""
    words = table.column("word").to_pylist()
    lists = Lists(words, new)
    s, hi = table.column("s").to_numpy(), table.column("hi").to_numpy()
    n = table.column("n").to_numpy()
    begin = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(words))))
    query = np.flatnonzero(lists.length == s)
    step = max(1, CELLS // (3 * (lists.width + 2)))
    found = [near_in(lists, query[i : i + step], begin[query[i : i + step]]) for i in range(0, len(query), step)]
    if not found:
        return None
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    inside = lists.prefix(a, b) < hi[a]
    a, b = a[inside], b[inside]
    if not len(a):
        return None
    word, near = np.concatenate([a, b]), np.concatenate([b, a])
    # words of one list are sorted, but a longer word may come before: numbers compare spellings inside a list
    order = np.lexsort((near, -n[near], word))
    word, near = word[order], near[order]
    head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    spelled = pa.array(words)
    return record(
        {
            "word": spelled.take(pa.array(word[head])),
            "n_near": np.diff(np.append(head, len(word))).astype(np.int64),
            "near": spelled.take(pa.array(near[head])),
            "near_n": n[near[head]].astype(np.int64),
        }
    )


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, scanned some whole groups at a time."""

    def scan(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        # words of one scan have similar lengths and bounded letters in all
        s = table.column("s").to_numpy().astype(np.int64)
        share = np.cumsum(s + 4) // LETTERS + (np.frexp(s)[1].astype(np.int64) << 40)
        heads = np.flatnonzero(new)
        cuts = [*heads[np.append(True, share[heads[1:]] != share[heads[:-1]])].tolist(), table.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            found = _scan(table.slice(a, b - a), new[a:b])
            if found is not None:
                yield found

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        table = pa.Table.from_batches(held)
        new = _starts(table)
        cut = int(np.flatnonzero(new)[-1])
        if cut:
            yield from scan(table.slice(0, cut), new[:cut])
        held = table.slice(cut).combine_chunks().to_batches()
    if sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        yield from scan(table, _starts(table))


def _starts(table: pa.Table) -> np.ndarray:
    new = np.ones(table.num_rows, dtype=bool)
    same = np.ones(table.num_rows - 1, dtype=bool)
    for name in KEY:
        values = table.column(name).combine_chunks()
        codes = values.dictionary_encode().indices.to_numpy() if pa.types.is_string(values.type) else values.to_numpy()
        same &= codes[1:] == codes[:-1]
    new[1:] = ~same
    return new


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``(word, n_near, form, form_n)``: the number of words at one edit, and the most frequent, least in spelling."""
    dealt = groups(words, group_words)
    ordered = dealt.repartition(*KEY).sortWithinPartitions(*KEY, "word").select("word", "n", *KEY)
    found = ordered.mapInArrow(_scanned, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))


# --- forms and roots -------------------------------------------------------------------------
def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the end of each chain of ``forms(word, form)``.

    Counts grow fivefold along a chain, so it ends, and doubling the reach takes a few rounds of stored tables.
    """
    reach = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(reach.join(further, "root", "left").select("word", "root", "next"), "roots")
        reach = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next IS NOT NULL").limit(1).count() == 0:
            return reach


def variants(docs: DataFrame, group_words: int = GROUP_WORDS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per word of ``docs(doc_id, text, ...)``."""
    words = stored(vocabulary(docs, least_count), "vocabulary")
    near = words.join(near_words(words, group_words), "word", "left")
    more = F.col("form_n") >= MORE_FREQUENT * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(more, F.col("form")).alias("form"),
        F.when(more, F.col("form_n")).alias("form_n"),
    )
    near = stored(near, "near")
    ends = roots(near.filter("form IS NOT NULL"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
