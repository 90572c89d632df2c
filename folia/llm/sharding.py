"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

A cell that is to give n shards is cut along its widest dimension so that n // 2 of n parts of its bytes lie
below; the cut is a weighted quantile found from distributed histograms.  Cells are cut until each is one shard
of the target bytes (total bytes over the number of shards).

Dimensions, scaled to 0..1023: place of the source and of the language (by hash), logarithm of the size, and id
(by range).  Rows at the cut's coordinate are divided by a hash, so a source with a third of all rows is split like
any other.

The unit is a group of equal texts, with the metadata of its first row by id, so that copies share a shard.  Groups of
several rows that weigh more than a ``LIGHT``-th of a shard, of which there can be ``LIGHT`` times as many as shards,
are leaves of their own: each goes to the shard that has least so far, heaviest first, and the cuts give each shard what
it has left.  Only a group that outweighs a shard is divided, row by row.  Shard sizes differ by about the largest
single row, plus a ``LIGHT``-th of a shard, unless groups of nearly a shard's weight leave no even division.

Defined results: NULL metadata count as coordinate 0 and a NULL text has no bytes besides the fixed eight; a NULL text
equals an empty one; rows with equal id and text always share a shard; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.sources.shared import stored

STEPS, FINE, ROW_BYTES = 1024, 1 << 14, 8
DIMENSIONS = ("d_source", "d_lang", "d_size", "d_id")
#: Rows of a shard that are numbered in one task, about.
NUMBERED = 200_000
#: Groups of up to this part of a shard are cut like rows.
LIGHT = 64


@dataclass
class Cut:
    """Rows below the step, or at the step with a hash below ``fine``, lie on the lower side."""

    dimension: str
    step: int
    fine: int


def _slim(docs: DataFrame) -> DataFrame:
    """What the tree needs of each row, without the text."""
    has = set(docs.columns)
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))

    def place(name: str) -> Column:
        if name not in has:
            return F.lit(0)
        return F.coalesce(F.pmod(F.xxhash64(F.lit(3), F.col(name).cast("string")), F.lit(STEPS)), F.lit(0)).cast("int")

    return docs.select(
        "doc_id", size.alias("size"), crc.alias("crc"), place("source").alias("d_source"), place("lang").alias("d_lang"),
        F.least(F.floor(F.log2(size.cast("double")) * 32), F.lit(STEPS - 1)).cast("int").alias("d_size"),
        F.xxhash64(F.lit(5), F.col("doc_id").cast("string"), crc, size).alias("h"), F.xxhash64(F.lit(7), F.coalesce(text, F.lit("")), crc).alias("u"),
    )


def _with_id_place(slim: DataFrame, kind: str) -> DataFrame:
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        return slim.withColumn("d_id", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)), F.lit(0)).cast("int"))
    low, high = slim.agg(F.min("doc_id"), F.max("doc_id")).first()
    span = max(int(high or 0) - int(low or 0), 1)
    place = F.floor((F.col("doc_id").cast("double") - float(low or 0)) / float(span) * (STEPS - 1))
    return slim.withColumn("d_id", F.coalesce(place, F.lit(0)).cast("int"))


def _grouped(slim: DataFrame, shards: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows with the coordinates of their group and its hash ``u``, and the heavy groups' ``own`` shard; bytes per shard of these.

    Light groups are joined on their hash; none has more than a ``LIGHT``-th of a shard, so no key is hot.  The heavy
    ones and those that outweigh a shard are at most ``LIGHT`` times the shards, which bounds what is sent and collected.
    """
    first = F.min(F.struct("doc_id", *DIMENSIONS)).alias("first")
    groups = stored(slim.groupBy("u").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), first), "groups")
    goal = (groups.agg(F.sum("weight")).first()[0] or 0) / shards
    several = groups.filter("n > 1")
    heavy = several.filter(F.col("weight") > goal / LIGHT)
    filled, own = dict.fromkeys(range(shards), 0), {}
    for r in sorted(heavy.filter(F.col("weight") <= goal).select("u", "weight").collect(), key=lambda r: (-r["weight"], r["u"])):
        own[r["u"]] = min(filled, key=lambda k: (filled[k], k))
        filled[own[r["u"]]] += r["weight"]
    literals = ", ".join(f"({u}L, {k})" for u, k in own.items()) or "(CAST(NULL AS BIGINT), 0)"
    owned = slim.sparkSession.sql(f"SELECT * FROM VALUES {literals} AS t(u, own)")
    whole = heavy.select("u").join(owned, "u", "left")
    light = several.filter(F.col("weight") <= goal / LIGHT)
    light = light.select("u", *(F.col(f"first.{d}").alias(f"first_{d}") for d in DIMENSIONS))
    kept = [c for c in slim.columns if c not in ("u", *DIMENSIONS)]
    marked = slim.join(F.broadcast(whole.withColumn("heavy", F.lit(True))), "u", "left")
    apart = marked.filter("heavy").select(*kept, *DIMENSIONS, F.col("h").alias("u"), "own")
    place = [F.coalesce(f"first_{d}", d).alias(d) for d in DIMENSIONS]
    rest = marked.filter(F.col("heavy").isNull()).drop("heavy", "own").join(light, "u", "left")
    return apart.unionByName(rest.select(*kept, *place, "u", F.lit(None).cast("int").alias("own"))), filled


def _fine() -> Column:
    return F.pmod(F.shiftright("u", 40), F.lit(FINE)).cast("int")


def _cell(cuts: dict[int, Cut], node: int = 0, first: int = 0, shards: int = 1) -> Column:
    """Number of the first shard of a row's cell, as nested conditions."""
    cut = cuts.get(node)
    if cut is None:
        return F.lit(first)
    below = (F.col(cut.dimension) < cut.step) | ((F.col(cut.dimension) == cut.step) & (_fine() < cut.fine))
    low = shards // 2
    return F.when(below, _cell(cuts, 2 * node + 1, first, low)).otherwise(_cell(cuts, 2 * node + 2, first + low, shards - low))


def build_tree(slim: DataFrame, shards: int, filled: dict[int, int] | None = None) -> dict[int, Cut]:
    """Cuts by node number; node ``i`` has the children ``2 i + 1`` and ``2 i + 2``.

    ``filled`` holds the bytes that shards have besides ``slim``.

    Three small aggregates per level, each of which the tasks reduce to a few rows per cell before the shuffle; the
    driver sees one row per cell.
    """
    extent = slim.agg(*(F.max(d).alias(f"hi_{d}") for d in DIMENSIONS), *(F.min(d).alias(f"lo_{d}") for d in DIMENSIONS), F.sum("size").alias("bytes")).first()
    width = {d: max((extent[f"hi_{d}"] or 0) - (extent[f"lo_{d}"] or 0), 1) for d in DIMENSIONS}
    filled = filled or dict.fromkeys(range(shards), 0)
    even = ((extent["bytes"] or 0) + sum(filled.values())) / shards
    room = [max(even - filled[k], 0.0) for k in range(shards)]
    cuts: dict[int, Cut] = {}
    open_cells = {0: (0, 0, shards)} if shards > 1 else {}  # first shard: node, first, shards
    while open_cells:
        cells = _values(slim, {c: (0.0, 0) for c in open_cells})
        placed = slim.withColumn("cell", _cell(cuts, shards=shards)).join(F.broadcast(cells.select("cell")), "cell")
        ranges = placed.groupBy("cell").agg(
            F.sum("size").alias("total"), *((F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS)
        ).collect()
        if not ranges:
            break
        widest = {r["cell"]: max(DIMENSIONS, key=lambda d: r[d] / width[d]) for r in ranges}
        goal = {}
        for r in ranges:
            _, start, n = open_cells[r["cell"]]
            below, both = sum(room[start : start + n // 2]), sum(room[start : start + n])
            goal[r["cell"]] = float(r["total"]) * (below / both if both else n // 2 / n)
        along = _values(slim, {c: (goal[c], DIMENSIONS.index(d)) for c, d in widest.items()})
        coordinates = F.array(*(F.col(d) for d in DIMENSIONS))
        at = slim.withColumn("cell", _cell(cuts, shards=shards)).join(F.broadcast(along), "cell")
        at = at.select("cell", "size", F.element_at(coordinates, F.col("number") + 1).alias("step"), _fine().alias("fine"))
        steps = _crossing(at.groupBy("cell", "step").agg(F.sum("size").alias("size")), "step", along)
        rest = {c: goal[c] - before for c, (_, before, _) in steps.items()}
        chosen = _values(slim, {c: (rest[c], step) for c, (step, _, _) in steps.items()})
        inside = at.join(F.broadcast(chosen), "cell").filter(F.col("step") == F.col("number"))
        fines = _crossing(inside.groupBy("cell", "fine").agg(F.sum("size").alias("size")), "fine", chosen)
        following = {}
        for cell, (value, before, with_it) in fines.items():
            node, first, n = open_cells[cell]
            # the part that crosses the goal goes to the nearer side
            nearer_below = with_it - rest[cell] < rest[cell] - before
            cuts[node] = Cut(widest[cell], steps[cell][0], value + nearer_below)
            low = n // 2
            for child, start, m in ((2 * node + 1, first, low), (2 * node + 2, first + low, n - low)):
                if m > 1:
                    following[start] = (child, start, m)
        open_cells = following
    return cuts


def _values(like: DataFrame, rows: dict[int, tuple[float, int]]) -> DataFrame:
    """``(cell, goal, number)``, one row per cell and never more than there are shards."""
    literals = ", ".join(f"({cell}, {goal!r}D, {number})" for cell, (goal, number) in rows.items())
    return like.sparkSession.sql(f"SELECT * FROM VALUES {literals} AS t(cell, goal, number)")


def _crossing(histogram: DataFrame, value: str, goals: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Per cell the first value at which the running sum reaches the goal, and the sums before and with it."""
    running = F.sum("size").over(Window.partitionBy("cell").orderBy(value))
    summed = histogram.withColumn("with", running).withColumn("before", F.col("with") - F.col("size"))
    crossed = summed.join(F.broadcast(goals), "cell").filter(F.col("with") >= F.col("goal") - 0.5)
    rows = crossed.groupBy("cell").agg(F.min(F.struct(value, "before", "with")).alias("x")).collect()
    return {r["cell"]: tuple(r["x"]) for r in rows}


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per row of ``docs(doc_id, text, ...)``.

    Slots number the rows of a shard from 0 in the order of a row hash; a shard is numbered in as many parts as
    its rows need, and the parts' counts give each part its first slot.
    """
    kind = dict(docs.dtypes)["doc_id"]
    slim, filled = _grouped(_with_id_place(stored(_slim(docs), "slim"), kind), shards)
    slim = stored(slim, "slim")
    rows = slim.count()
    cuts = build_tree(slim.filter(F.col("own").isNull()), shards, filled)
    parts = max(1, -(-rows // (shards * NUMBERED)))
    placed = slim.withColumn("shard", F.coalesce("own", _cell(cuts, shards=shards))).withColumn(
        "part", F.floor((F.shiftrightunsigned("h", 32) * parts) / F.lit(float(1 << 32))).cast("int")
    )
    placed = stored(placed.select("doc_id", "size", "crc", "h", "shard", "part"), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", before.alias("base"))
    order = Window.partitionBy("shard", "part").orderBy(F.shiftrightunsigned("h", 32), "h", "doc_id", "crc", "size")
    numbered = placed.withColumn("number", F.row_number().over(order)).join(offsets, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        (F.col("base") + F.col("number") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
