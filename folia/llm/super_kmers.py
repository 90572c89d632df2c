"""Removal of repeated word sequences by super-k-mer partitioning.

A window is 13 consecutive words.  Its minimiser is the least hash of the three-word runs in it, the leftmost of
equals, so equal windows have equal minimisers.  Consecutive windows with one minimiser are a super-k-mer: they
travel as one packed string, 18 words for about 6 windows, to the bucket of their minimiser.  A task packs the
super-k-mers of some megabytes of text at a time, each different string once with the places that have it.  A
bucket cuts its strings into windows, sorts them by hash, compares every window's spelling with the first of its
hash, and knows then the least document id of each; windows of documents with larger ids go back as runs.

No bucket is unbounded.  The bytes that each slot of minimisers would send are counted first.  Windows of a slot
that is too heavy for a bucket travel one by one under their own spelling instead: Spark takes the least id per
window, combined in the tasks that have read them, and joins it back, where the adaptive skew join splits a
window that very many documents have.

Defined results: NULL texts and texts of fewer than 13 words lose nothing; a NULL id is neither smaller nor
larger than another, so such rows lose nothing and cause nothing; rows with equal ids keep what they share,
whether their texts are equal or not; a window that repeats inside one document counts as one; ids of any type
that can be ordered will do; extra columns are not read.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.words import SPACED, Words, parts, record, run_hashes
from folia.sources.shared import stored

WINDOW, RUN = 13, 3
SPAN = WINDOW - RUN + 1
#: Bytes of text that a task packs at a time; equal strings in it travel once.
PACKED_BYTES = 8 << 20
#: Bytes of strings and places that one bucket is meant to hold, and bytes counted for a place.
BUCKET_BYTES = 12 << 20
PLACE_BYTES = 12
#: Packed strings hold about three times the bytes of their texts.
GROWTH = 3
#: Slots that the minimisers' bytes are counted in: four per bucket within these bounds.  At most a quarter of the
#: slots can be heavy, so the list of heavy ones is at most 2^20 numbers.
LEAST_SLOTS, MOST_SLOTS = 1 << 14, 1 << 22


class Packed(Words):
    """Words of lines that are held in one buffer."""

    def __init__(self, data: bytes) -> None:
        self.data = np.frombuffer(data, dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.flatnonzero(self.data == 0x0A) + 1])
        self.inside = SPACED[self.data]
        edge = np.diff(self.inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hashes()


def windows_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window that lies in one text, its text, and the place of its minimiser."""
    runs = run_hashes(words.hashes, RUN)
    n = len(words.hashes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    text = words.text_of_words()
    least, place = runs[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, SPAN):
        lower = runs[j : j + n] < least
        least[lower] = runs[j : j + n][lower]
        place[lower] = j
    starts = np.flatnonzero(text[:n] == text[WINDOW - 1 : WINDOW - 1 + n])
    return starts, text[starts], starts + place[starts]


class Cut:
    """Super-k-mers of a batch of texts: text, first window, number of windows and minimiser of each."""

    def __init__(self, texts: list[str | None]) -> None:
        self.words = words = Words(texts, SPACED)
        starts, text, place = windows_of(words)
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        self.windows = np.diff(np.append(first, len(starts)))
        self.start, self.text = starts[first], text[first]
        self.minimiser = run_hashes(words.hashes, RUN)[place[first]] if len(first) else np.empty(0, np.uint64)
        self.last = self.start + self.windows + WINDOW - 2
        self.at = self.start - words.first[self.text]

    def spell(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where in it each word starts and ends."""
        lengths = self.words.ends - self.words.starts
        ends = np.cumsum(lengths + 1) - 1
        after = np.zeros(len(self.words.data), dtype=bool)
        after[self.words.ends] = True  # every text ends in a line feed, so the byte after a word exists
        spelled = self.words.data[self.words.inside | after].copy()
        spelled[ends] = 0x20
        return spelled.tobytes(), ends - lengths, ends


def slots_of(minimisers: np.ndarray, slots: int) -> np.ndarray:
    return ((minimisers >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Table, list[str | None]]]:
    """Rows and texts of the batches, joined to about ``limit`` bytes of text."""
    rows, texts, held = [], [], 0
    for part, found in parts(batches):
        rows.append(part)
        texts += found
        held += part.column("text").nbytes
        if held >= limit:
            yield pa.Table.from_batches(rows), texts
            rows, texts, held = [], [], 0
    if rows:
        yield pa.Table.from_batches(rows), texts


def _identified(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, text)``; the mark tells texts of one id apart."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))


def _usable(keyed: DataFrame) -> DataFrame:
    return keyed.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= 2 * WINDOW - 1))


# --- slots that are too heavy for a bucket ---------------------------------------------------
def heavy_slots(keyed: DataFrame, slots: int, limit: int) -> np.ndarray:
    """Slots whose minimisers would send more than ``limit`` bytes, and more than four times the mean."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in gathered(batches, PACKED_BYTES):
            cut = Cut(texts)
            if not len(cut.start):
                continue
            size = cut.words.ends[cut.last] - cut.words.starts[cut.start] + PLACE_BYTES
            total = np.bincount(slots_of(cut.minimiser, slots), weights=size, minlength=slots)
            some = np.flatnonzero(total)
            yield record({"slot": some, "bytes": total[some].astype(np.int64)})

    counted = keyed.select("text").mapInArrow(count, "slot bigint, bytes bigint").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    counted = stored(counted, "slots")
    total = counted.agg(F.sum("bytes")).first()[0] or 0
    found = counted.filter(F.col("bytes") > max(limit, 4 * total // slots)).select("slot").collect()
    return np.sort(np.array([r["slot"] for r in found], dtype=np.int64))


def _single_runs(keyed: DataFrame, slots: int, heavy: np.ndarray, kind: str) -> DataFrame:
    """Removed windows among those of heavy slots: ``(doc_id, mark, at, n)``."""

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in gathered(batches, PACKED_BYTES >> 3):
            cut = Cut(texts)
            own = np.flatnonzero(np.isin(slots_of(cut.minimiser, slots), heavy))
            if not len(own):
                continue
            spelled, starts, ends = cut.spell()
            each = np.repeat(own, cut.windows[own])
            step = np.arange(len(each)) - np.repeat(np.cumsum(cut.windows[own]) - cut.windows[own], cut.windows[own])
            first = cut.start[each] + step
            owner = pa.array(cut.text[each])
            yield record(
                {
                    "window": [spelled[a:b] for a, b in zip(starts[first].tolist(), ends[first + WINDOW - 1].tolist())],
                    "doc_id": rows.column("doc_id").combine_chunks().take(owner),
                    "mark": rows.column("mark").combine_chunks().take(owner),
                    "at": (cut.at[each] + step).astype(np.int32),
                }
            )

    rows = keyed.mapInArrow(cut_windows, f"window binary, doc_id {kind}, mark bigint, at int")
    least = rows.groupBy("window").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "window").filter("doc_id > least").select("doc_id", "mark", "at", F.lit(1).alias("n"))


# --- buckets ---------------------------------------------------------------------------------
def _packed(keyed: DataFrame, buckets: int, slots: int, heavy: np.ndarray, kind: str) -> DataFrame:
    """Per batch and bucket one row: the different strings compressed, the places, and the documents that they name."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for rows, texts in gathered(batches, PACKED_BYTES):
            cut = Cut(texts)
            slot = slots_of(cut.minimiser, slots)
            own = np.flatnonzero(~np.isin(slot, heavy)) if len(heavy) else np.arange(len(slot))
            if not len(own):
                continue
            bucket = slot[own] % buckets
            own, bucket = own[np.argsort(bucket, kind="stable")], np.sort(bucket)
            spelled, starts, ends = cut.spell()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(own)]
            ids, marks = rows.column("doc_id").combine_chunks(), rows.column("mark").combine_chunks()
            for a, b in zip(cuts, cuts[1:]):
                some = own[a:b]
                lines: dict[bytes, int] = {}
                line = [
                    lines.setdefault(spelled[s:e], len(lines))
                    for s, e in zip(starts[cut.start[some]].tolist(), ends[cut.last[some]].tolist())
                ]
                named, owner = np.unique(cut.text[some], return_inverse=True)
                places = np.vstack([np.array(line), owner, cut.at[some]]).astype(np.int32)
                docs = pa.array(named)
                yield record(
                    {
                        "bucket": np.array([bucket[a]]),
                        "strings": [squeeze(b"\n".join([*lines, b""]))],
                        "places": [squeeze(places.tobytes())],
                        "ids": pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), ids.take(docs)),
                        "marks": pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), marks.take(docs)),
                    }
                )

    schema = f"bucket bigint, strings binary, places binary, ids array<{kind}>, marks array<bigint>"
    return keyed.mapInArrow(pack, schema)


def first_of_equal(words: Packed, starts: np.ndarray) -> np.ndarray:
    """For every window the number of the first window with its spelling."""
    hashes = run_hashes(words.hashes, WINDOW)[starts]
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    first = np.empty(len(order), dtype=np.int64)
    first[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))
    # neighbours that follow neighbours are compared as one span
    late = np.flatnonzero(first != np.arange(len(first)))
    if not len(late):
        return first
    shift = starts[late] - starts[first[late]]
    joined = np.ones(len(late), dtype=bool)
    joined[1:] = (np.diff(late) != 1) | (starts[late[1:]] - starts[late[:-1]] != 1) | (shift[1:] != shift[:-1])
    head = np.flatnonzero(joined)
    until = np.append(head[1:], len(late))
    data, spelled = words.data.tobytes(), {}
    spans = zip(*(x.tolist() for x in (late[head], late[until - 1], first[late[head]], first[late[until - 1]], head, until)))
    for a, b, fa, fb, i, j in spans:
        if data[words.starts[starts[a]] : words.ends[starts[b] + WINDOW - 1]] == data[words.starts[starts[fa]] : words.ends[starts[fb] + WINDOW - 1]]:
            continue
        for w in late[i:j].tolist():  # a hash that two spellings have: the spelling itself decides
            own = data[words.starts[starts[w]] : words.ends[starts[w] + WINDOW - 1]]
            other = data[words.starts[starts[first[w]]] : words.ends[starts[first[w]] + WINDOW - 1]]
            first[w] = first[w] if own == other else spelled.setdefault(own, w)
    return first


def _runs(document: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window and number of windows of each run of neighbouring windows."""
    order = np.lexsort((at, document))
    document, at = document[order], at[order]
    keep = np.ones(len(at), dtype=bool)
    keep[1:] = (document[1:] != document[:-1]) | (at[1:] != at[:-1])
    document, at = document[keep], at[keep]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (document[1:] != document[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return document[first], at[first], np.diff(np.append(first, len(at)))


def meet(table: pa.Table) -> pa.Table:
    """Runs of windows in one bucket that a document with a smaller id has as well: ``(doc_id, mark, at, n)``."""
    inflate = zstandard.ZstdDecompressor().decompress
    ids = pa.chunked_array([c.flatten() for c in table.column("ids").chunks]).combine_chunks()
    marks = pa.chunked_array([c.flatten() for c in table.column("marks").chunks]).combine_chunks()
    buffers, places, lines, docs = [], [], 0, 0
    for strings, place, own in zip(table.column("strings"), table.column("places"), table.column("ids")):
        buffers.append(inflate(strings.as_py()))
        rows = np.frombuffer(inflate(place.as_py()), dtype=np.int32).reshape(3, -1).astype(np.int64)
        rows[0] += lines
        rows[1] += docs
        places.append(rows)
        lines += buffers[-1].count(b"\n")
        docs += len(own)
    line, owner, at = np.hstack(places)
    words = Packed(b"".join(buffers))
    del buffers, places
    # ranks stand for the ids in every comparison
    ordered = ids.dictionary_encode()
    values = ordered.dictionary.to_pylist()
    rank_of = np.empty(len(values), dtype=np.int64)
    rank_of[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
    rank = rank_of[ordered.indices.to_numpy()]
    least = np.full(lines, len(values), dtype=np.int64)
    np.minimum.at(least, line, rank[owner])

    starts, of_line, _ = windows_of(words)
    first = first_of_equal(words, starts)
    lowest = np.full(len(starts), len(values), dtype=np.int64)
    np.minimum.at(lowest, first, least[of_line])
    lowest = lowest[first]
    head = np.searchsorted(of_line, np.arange(lines + 1))
    some = np.flatnonzero(rank[owner] > np.minimum.reduceat(lowest, head[:-1])[line]) if lines else np.empty(0, np.int64)
    count = np.diff(head)[line[some]]
    each = np.repeat(some, count)
    step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    gone = rank[owner[each]] > lowest[head[line[each]] + step]
    document, begin, n = _runs(owner[each][gone], (at[each] + step)[gone])
    picked = pa.array(document)
    return pa.Table.from_batches(
        [record({"doc_id": ids.take(picked), "mark": marks.take(picked), "at": begin.astype(np.int32), "n": n.astype(np.int32)})]
    )


def repeated_runs(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, slot_bytes: int | None = None) -> DataFrame:
    """``(doc_id, mark, at, n)``: ``n`` windows from word ``at`` on that a smaller id has; runs may overlap."""
    kind = dict(docs.dtypes)["doc_id"]
    usable = _usable(_identified(docs))
    total = usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total * GROWTH // bucket_bytes))
    slots = min(max(4 * buckets, LEAST_SLOTS), MOST_SLOTS)
    heavy = heavy_slots(usable, slots, bucket_bytes if slot_bytes is None else slot_bytes)
    packed = _packed(usable, buckets, slots, heavy, kind)
    found = packed.groupBy("bucket").applyInArrow(meet, f"doc_id {kind}, mark bigint, at int, n int")
    if len(heavy):
        found = found.unionByName(_single_runs(usable, slots, heavy, kind))
    return stored(found, "repeated_runs")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in gathered(batches, PACKED_BYTES >> 2):
        words = Words(texts, SPACED)
        change = np.zeros(len(words.starts) + 1, dtype=np.int64)
        for i, runs in enumerate(rows.column("runs").to_pylist()):
            for run in runs or ():
                change[words.first[i] + run["at"]] += 1
                change[words.first[i] + run["at"] + run["n"] + WINDOW - 1] -= 1
        gone = np.cumsum(change[:-1]) > 0
        removed = np.add.reduceat(np.append(gone, False), words.first[:-1]) * (np.diff(words.first) > 0)
        kept = []
        for a, b in zip(words.first.tolist(), words.first.tolist()[1:]):
            own = np.flatnonzero(~gone[a:b]) + a
            data = words.data
            kept.append(b" ".join(data[s:e].tobytes() for s, e in zip(words.starts[own].tolist(), words.ends[own].tolist())).decode("utf-8", "replace"))
        yield record(
            {
                "doc_id": rows.column("doc_id").combine_chunks(),
                "n_words": np.diff(words.first).astype(np.int64),
                "n_removed": removed.astype(np.int64),
                "kept_text": kept,
            }
        )


def drop_repeated(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, slot_bytes: int | None = None) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` per row of ``docs(doc_id, text, ...)``.

    The kept words are joined by one space.  ``slot_bytes`` is the weight from which a slot's windows travel alone.
    """
    kind = dict(docs.dtypes)["doc_id"]
    runs = repeated_runs(docs, bucket_bytes, slot_bytes).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    rows = _identified(docs).join(runs, ["doc_id", "mark"], "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(_without, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string")


def digest(kept: Column) -> Column:
    return F.sha2(kept.cast("binary"), 256)
