"""Near-duplicates by order MinHash, verified by banded alignment.

Words are lower-cased runs of ASCII letters, digits and characters beyond ASCII.  A text's k-mers are its
runs of five words (the whole text, if shorter), each labelled with its occurrence number.  A sketch takes
the labelled k-mers of least hash under one random order and keeps them in text order.  Two texts are
linked if their sets of five-word runs have a Jaccard similarity of 0.8 or more and a banded alignment of
their words needs edits for at most a fifth of the longer text.  A class is a connected component of links.

Sketches are taken twice.  Forty coarse ones of five k-mers find the texts that share one with any other;
only these get fine ones (up to 150 of ten k-mers), whose agreement makes a pair a candidate.  Short texts have
sketches of fewer k-mers; the ranges of length overlap so that two texts of similarity 0.8 always have a kind in
common.  At that similarity all sketches of a kind differ with a probability of about 1e-6 or less;
no cap drops a candidate.  Within a group that shares a sketch, members are compared with a leader first.  Members
of groups that are not one class then are compared with each other unless their rarest runs prove that they share
too few (``_unmet``), so a large group costs few pairs and loses no link between classes.

Defined results: equal texts, also empty ones, are one class; a NULL text is a class of its own; texts
without words are near no other; repeated rows stay one row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.components import components
from folia.llm.words import PLAIN, Words, mixed, parts, record, run_hashes
from folia.sources.shared import stored

RUN, SIMILAR = 5, 0.8
#: Width of a bucket of sizes, and how many of them lie within a similarity of 0.8 to either side.
WIDTH, REACH = 1.05, 5


@dataclass(frozen=True)
class Kind:
    """``count`` sketches of ``kept`` k-mers, for texts with ``low`` to ``high`` k-mers (exclusive)."""

    low: int
    high: float
    kept: int
    count: int


#: Texts of similarity 0.8 have numbers of k-mers within a fifth.  Where one kind begins at ``low``, the one before
#: it ends at 1.25 ``low`` or later, so both texts always have a kind in common.
COARSE = (Kind(1, 30, 2, 40), Kind(20, inf, 5, 40))
FINE = (Kind(1, 10, 2, 40), Kind(8, 20, 4, 60), Kind(16, 40, 6, 80), Kind(32, 75, 8, 100), Kind(60, inf, 10, 150))
#: k-mers hashed under all orders at a time.
COLUMNS = 1 << 13
_ORDERS = np.random.default_rng(20240517).integers(1, 2**63, size=(150, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(runs: np.ndarray) -> np.ndarray:
    """Hashes of k-mers together with how often each occurred before."""
    order = np.argsort(runs, kind="stable")
    sorted_runs = runs[order]
    fresh = np.concatenate([[True], sorted_runs[1:] != sorted_runs[:-1]])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(runs)), 0))
    seen = np.empty(len(runs), dtype=np.uint64)
    seen[order] = (np.arange(len(runs)) - start).astype(np.uint64)
    return mixed(runs + seen * np.uint64(0x9FB21C651E98DF25))


def sketches(words: np.ndarray, kinds: tuple[Kind, ...]) -> np.ndarray:
    """Sketch keys of a text with these word hashes, or none if it has no words."""
    if not len(words):
        return np.empty(0, dtype=np.int64)
    kmers = labelled(run_hashes(words, min(RUN, len(words))))
    return np.concatenate([_sketches(kmers, k) for k in kinds if k.low <= len(kmers) < k.high])


def _sketches(kmers: np.ndarray, kind: Kind) -> np.ndarray:
    orders = _ORDERS[: kind.count]
    least, places = np.empty((kind.count, 0), np.uint32), np.empty((kind.count, 0), np.int32)
    for at in range(0, len(kmers), COLUMNS):
        part = ((kmers[at : at + COLUMNS] * orders) >> np.uint64(32)).astype(np.uint32)
        number = np.broadcast_to(np.arange(at, at + part.shape[1], dtype=np.int32), part.shape)
        if part.shape[1] > kind.kept:
            few = np.argpartition(part, kind.kept - 1, axis=1)[:, : kind.kept]
            part, number = np.take_along_axis(part, few, 1), few.astype(np.int32) + np.int32(at)
        least, places = np.concatenate([least, part], axis=1), np.concatenate([places, number], axis=1)
    if least.shape[1] > kind.kept:
        few = np.argpartition(least, kind.kept - 1, axis=1)[:, : kind.kept]
        places = np.take_along_axis(places, few, 1)
    in_order = kmers[np.sort(places, axis=1)]
    key = mixed(np.arange(1, kind.count + 1, dtype=np.uint64) + np.uint64(kind.kept << 32))
    for j in range(in_order.shape[1]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + in_order[:, j])
    return key.astype(np.int64)


def edits_within(a: list, b: list, band: int) -> bool:
    """Whether ``a`` turns into ``b`` by at most ``band`` insertions, deletions and replacements.

    Only diagonals up to ``band`` are visited: for each number of edits, the furthest row of each diagonal.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return False

    def slide(i: int, d: int) -> int:
        while i < n and i + d < m and a[i] == b[i + d]:
            i += 1
        return i

    far = {0: slide(0, 0)}
    for edits in range(band + 1):
        if far.get(m - n, -1) >= n:
            return True
        if edits == band:
            break
        wider = {}
        for d in range(max(-n, -edits - 1), min(m, edits + 1) + 1):
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i >= 0:
                wider[d] = slide(i, d)
        far = wider
    return False


def distinct_runs(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of a text's runs of five words; a shorter text is one run."""
    return np.unique(run_hashes(words, min(RUN, len(words)))) if len(words) else words


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts with these word hashes are near copies."""
    if not len(a) or not len(b) or min(len(a), len(b)) < (SIMILAR - 0.3) * max(len(a), len(b)):
        return False
    x, y = distinct_runs(a), distinct_runs(b)
    if min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    if both * 5 < 4 * (len(x) + len(y) - both):
        return False
    return edits_within(a.tolist(), b.tolist(), max(len(a), len(b)) // 5)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in parts(batches):
        words = Words(texts, PLAIN, lower=True)
        keys = [sketches(words.hashes[a:b], COARSE) if t is not None else None for t, a, b in zip(texts, words.first, words.first[1:])]
        yield record({**{c: rows.column(c) for c in ("doc_id", "h1", "h2")}, "keys": pa.array(keys, pa.list_(pa.int64()))})


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in parts(batches):
        words = Words(texts, PLAIN, lower=True)
        keys = [sketches(words.hashes[a:b], FINE) for a, b in zip(words.first, words.first[1:])]
        yield record({"node": rows.column("node"), "keys": pa.array(keys, pa.list_(pa.int64()))})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in parts(batches, "text_a"):
        one, other = Words(texts, PLAIN, lower=True), Words(rows.column("text_b").to_pylist(), PLAIN, lower=True)
        ok = [
            near(one.hashes[a:b], other.hashes[c:d])
            for a, b, c, d in zip(one.first, one.first[1:], other.first, other.first[1:])
        ]
        yield record({"a": rows.column("a"), "b": rows.column("b"), "ok": pa.array(ok, pa.bool_())})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in parts(batches):
        words = Words(texts, PLAIN, lower=True)
        runs = [distinct_runs(words.hashes[a:b]).view(np.int64) for a, b in zip(words.first, words.first[1:])]
        yield record({
            "node": rows.column("node"), "component": rows.column("component"), "n": pa.array([len(r) for r in runs], pa.int32()), "runs": pa.array(runs, pa.list_(pa.int64())),
        })


def _hashed(docs: DataFrame) -> DataFrame:
    """128 bits that stand for a text; NULL for a NULL text."""
    text = F.col("text").cast("string")
    return docs.select(
        "doc_id", text.alias("text"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("h1"), F.when(text.isNotNull(), F.xxhash64(F.lit(7), text, F.length(text))).alias("h2"),
    )


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' ids with the hashes of their texts, and one row per text with its class."""
    hashed = _hashed(docs)
    kind = dict(docs.dtypes)["doc_id"]
    signed = hashed.mapInArrow(_signed, f"doc_id {kind}, h1 bigint, h2 bigint, keys array<bigint>")
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    texts = signed.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("n")
    )
    texts = stored(texts, "texts")
    # one row of each text stands for its copies
    keyed = signed.join(texts.select(F.col("node").alias("row")), "row", "left_semi")
    keyed = keyed.select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    wanted = stored(keyed.join(groups, "key", "left_semi").select("node").distinct(), "wanted")
    read = stored(_read(wanted, hashed, texts), "read")
    keyed = read.mapInArrow(_refined, "node bigint, keys array<bigint>").select("node", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1")
    shared = stored(keyed.join(groups, "key").select("key", "node", "leader", "size"), "shared")

    pairs = shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    tried = stored(_compared(pairs, read), "checked")
    classes = stored(components(tried.filter("ok")), "classes")
    more = stored(_compared(_unmet(shared, classes, tried, read), read), "checked")
    tried = tried.unionByName(more)
    classes = stored(components(tried.filter("ok")), "classes")

    links = tried.filter("ok").distinct()
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    n_links = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    of_text = texts.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sums = of_text.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("head"), F.min("rep").alias("class_id"), F.sum("n").alias("class_size"))
    of_text = of_text.join(sums, "component").join(n_links, "node", "left").withColumn("heads", F.col("head.node") == F.col("node"))
    of_text = stored(of_text.select("h1", "h2", "rep", "class_id", "class_size", "n_links", "heads"), "of_text")
    return signed.select("doc_id", "h1", "h2"), of_text


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, class_id, class_size, n_links)`` per row of ``docs(doc_id, text)``.

    The class id is the least document id of the class, ``class_size`` its number of rows, and ``n_links`` the number
    of verified links of the row's text to different texts (enough to connect its class, not all of them).
    """
    rows, of_text = _classified(docs)
    found = rows.join(of_text, ["h1", "h2"], "left")
    return found.select(
        "doc_id", F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
    )


def _unmet(shared: DataFrame, classes: DataFrame, tried: DataFrame, read: DataFrame) -> DataFrame:
    """Pairs of different classes that may still be near, of texts whose groups are not one class yet.

    All these texts put their runs in one order: those of a single class first, then the others, rare ones before
    frequent ones.  Two texts of ``n`` and ``m`` runs that are near share at least ``4 / 9 (n + m)``, so the first that
    they share lies among the first ``n - 4 / 9 (n + m) + 1`` of one and likewise of the other.  Partners are kept
    apart by size (buckets 5 % wide, five to either side), which keeps these beginnings short.  A text with more runs
    of its own than near copies may differ in meets nobody, however many texts share its sketches.  Nothing is missed.

    Of the texts that share a run, those of the most frequent class do not meet each other.
    """
    placed = shared.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    members = placed.join(split.select("key"), "key", "left_semi").select("node", "component").distinct()
    runs = read.join(members, "node").mapInArrow(_runs, "node bigint, component bigint, n int, runs array<bigint>")
    runs = stored(runs.select("node", "component", "n", F.explode("runs").alias("run")), "runs")
    seen = runs.groupBy("run").agg(F.count("*").alias("times"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    common = runs.join(seen.filter("lo <> hi").select("run", "times"), "run")
    ordered = common.groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("times", "run"))).alias("runs"))

    own = F.floor(F.log("n") / log(WIDTH)).cast("int")
    ordered = ordered.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.col("own") - REACH, F.col("own") + REACH)))
    least = F.ceil((F.col("n") + F.pow(F.lit(WIDTH), F.col("other"))) * (SIMILAR / (1 + SIMILAR)) - 1e-6)
    # runs of a single class stand before those listed here
    begin = F.greatest(F.lit(0), F.size("runs") - least + 1).cast("int")
    begun = ordered.withColumn("run", F.explode(F.slice("runs.run", F.lit(1), begin)))
    begun = begun.select("node", "component", "own", "other", "run", F.least("own", "other").alias("small"), F.greatest("own", "other").alias("large"))
    begun = stored(begun, "begun")
    of_class = begun.groupBy("run", "small", "large", "component").agg(F.count("*").alias("times"))
    most = of_class.groupBy("run", "small", "large").agg(F.max_by("component", F.struct("times", "component")).alias("most"), F.count("*").alias("classes"))
    mixed_runs = begun.join(most.filter("classes > 1").drop("classes"), ["run", "small", "large"])
    one = mixed_runs.filter("component <> most").select("run", "own", "other", F.col("node").alias("l"), F.col("component").alias("lc"))
    two = mixed_runs.select("run", F.col("own").alias("other"), F.col("other").alias("own"), "node", "component")
    met = one.join(two, ["run", "own", "other"]).filter("component <> lc")
    met = met.select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b")).distinct()
    old = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.join(old, ["a", "b"], "left_anti")


def _read(nodes: DataFrame, hashed: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, text)`` of the given nodes."""
    wanted = texts.join(nodes, "node", "left_semi").select("h1", "h2", "node", F.col("rep").alias("doc_id"))
    # of a text's copies only rows with the least id come through
    same_id = hashed["doc_id"].eqNullSafe(wanted["doc_id"])
    found = hashed.join(wanted, (hashed["h1"] == wanted["h1"]) & (hashed["h2"] == wanted["h2"]) & same_id)
    return found.select(wanted["node"], "text").dropDuplicates(["node"])


def _compared(pairs: DataFrame, read: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the verdict."""
    with_a = pairs.join(read.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(read.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_both.mapInArrow(_verified, "a bigint, b bigint, ok boolean")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each class, the one with the least id.

    Every row with a NULL text stays.
    """
    _, of_text = _classified(docs)
    heads = of_text.filter("heads").select(F.col("h1").alias("__near_h1"), F.col("h2").alias("__near_h2"), F.col("rep").alias("__near_id"))
    text = F.col("text").cast("string")
    keyed = docs.withColumns({"__near_h1": F.xxhash64(text), "__near_h2": F.xxhash64(F.lit(7), text, F.length(text))})
    here = keyed.filter(text.isNotNull()).withColumnRenamed("doc_id", "__near_id")
    stay = here.join(heads, (here["__near_h1"] == heads["__near_h1"]) & (here["__near_h2"] == heads["__near_h2"]) & here["__near_id"].eqNullSafe(heads["__near_id"]), "left_semi")
    stay = stay.dropDuplicates(["__near_h1", "__near_h2", "__near_id"]).withColumnRenamed("__near_id", "doc_id").select(docs.columns)
    return stay.unionByName(docs.filter(text.isNull()))
