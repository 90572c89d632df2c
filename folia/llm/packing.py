"""Best-fit packing into sequences of several permitted lengths.

A text is as long as its number of white-space words; a text longer than the largest permitted length is cut into
pieces of that length and a rest.  Pieces are dealt by hash into packing groups of about equal length, whose number
follows the total, so no group grows with the corpus.  Within a group, longest first, each piece goes to the open
bin with the least room that takes it.  If none does, a bin is opened with the capacity that costs least for what it
is expected to hold: the piece and what the remaining pieces can still fill.  Every opening rule (that one, and
each single capacity) is tried, the packing of least cost stays, and each bin ends at the smallest permitted
capacity that holds its contents.

Defined results: NULL, empty and white-space texts have one piece of length 0 without a bin; equal rows are
packed one by one; the result has one row per piece; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.sources.shared import stored

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin beyond its length, for what starting a sequence takes.
OPENING_COST = 32
#: Length that is packed in one group, about.
GROUP_LENGTH = 4_000_000


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """``(doc_id, piece, start, length)``; a long text has several rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select("doc_id", F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("bigint").alias("n"))
    last = F.greatest(F.floor((F.col("n") - 1) / largest).cast("int"), F.lit(0))
    cut = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * largest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest)).alias("length"))


def pack(lengths: list[int], capacities: tuple[int, ...], fixed: int | None = None) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Bin and offset of each piece, and the bins' final capacities and contents.

    ``lengths`` come longest first; each is at most the largest capacity.  ``fixed`` opens bins of one capacity (or
    the next that takes the piece) instead of the least costly.
    """
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    filled: list[int] = []
    opened: list[int] = []
    places = []
    tail = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])  # what the pieces from here on hold together
    smallest = lengths[-1] if lengths else 0
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            fitting = [c for c in capacities if c >= n]
            if fixed is not None:
                left = max(fixed, fitting[0])
            else:
                rest = int(tail[i + 1])
                # a gap smaller than every remaining piece stays empty
                holds = {c: n + (0 if c - n < smallest else min(c - n, rest)) for c in fitting}
                left = min(fitting, key=lambda c: ((c + OPENING_COST) / holds[c], c))
            b = len(filled)
            filled.append(0)
            opened.append(left)
        places.append((b, filled[b]))
        filled[b] += n
        if left > n:
            insort(room, (left - n, b))
    final = [next(c for c in capacities if c >= f) for f in filled]
    return places, final, filled


def best_packing(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    packings = [pack(lengths, capacities, f) for f in (None, *capacities)]
    return min(packings, key=lambda p: sum(p[1]) + OPENING_COST * len(p[1]))


def _pack_group(capacities: tuple[int, ...]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "h", "doc_key", "piece"], ascending=[False, True, True, True], kind="stable")
        places, final, _ = best_packing(group["length"].tolist(), capacities)
        return pd.DataFrame({
            "doc_key": group["doc_key"].to_numpy(), "piece": group["piece"].to_numpy(), "start": group["start"].to_numpy(), "length": group["length"].to_numpy(),
            "bin": [f"{group['grp'].iloc[0]}-{b}" for b, _ in places], "capacity": [final[b] for b, _ in places], "offset": [o for _, o in places],
        })

    return run


def best_fit(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, *, group_length: int = GROUP_LENGTH) -> DataFrame:
    """``(doc_id, piece, start, length, bin, capacity, offset)`` per piece of ``docs(doc_id, text)``.

    ``start`` is the piece's first word in its text, ``offset`` its place in its bin.  Only ids and lengths are shuffled.
    """
    capacities = tuple(sorted(capacities))
    kind = dict(docs.dtypes)["doc_id"]
    cut = stored(pieces(docs, capacities[-1]).withColumn("row", F.monotonically_increasing_id()), "pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-int(total[0]) // group_length), -(-int(total[1]) // (group_length // 16)))
    # equal rows are told apart by their place, so a repeated row is dealt to many groups
    h = F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), "piece", "length", "row")
    full = cut.filter("length > 0").select(
        F.col("doc_id").cast("string").alias("doc_key"), "piece", "start", "length", h.alias("h"), F.pmod(h, F.lit(groups)).alias("grp")
    )
    packed = full.groupBy("grp").applyInPandas(
        _pack_group(capacities), "doc_key string, piece int, start bigint, length bigint, bin string, capacity int, offset bigint"
    )
    packed = packed.select(F.col("doc_key").cast(kind).alias("doc_id"), "piece", "start", "length", "bin", "capacity", "offset")
    none = cut.filter("length <= 0").select(
        "doc_id", "piece", "start", F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("string").alias("bin"),
        F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("bigint").alias("offset"),
    )
    return packed.unionByName(none)
