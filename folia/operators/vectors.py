"""Exact vector search over a table of embeddings.

Vectors are dealt to the nearest of some centres, which are a bounded sample of them.  A query is compared with the
cells nearest to it first; its k-th best cosine then rules out every other cell whose vectors the triangle inequality
of angles keeps farther away.  Small cells share a region, and a query travels once to each region with the cells that
it visits there.  A region of many vectors or queries is compared in blocks, so no task holds more than one block of
each, and every query emits at most k rows per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.sources.shared import stored

#: At most so many vectors become centres, whatever the table's size; fewer for small tables.
MOST_CENTRES = 1024
#: Cells that a query is compared with before any is ruled out.
PROBED_CELLS = 2
#: Vectors and queries of one block at most, and down to which blocks are made smaller to keep the cores busy.
BLOCK_ROWS, LEAST_ROWS = 16_384, 512
#: Queries multiplied at a time, and hits of a block that are held before they are cut to k a query.
SLICE_ROWS, HELD_ROWS = 512, 2_000_000
#: Cosines are rounded, so that equal vectors tie whatever block they are in; bounds give way by more than that.
DIGITS, SLACK = 12, 1e-9
#: The cell of vectors whose dimension no centre has.
NO_CENTRE = -1


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def unit_vector(vector) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(squared_norm(v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def search_width(k: int) -> int:
    """Candidates fetched before reranking."""
    return max(4 * k, 12)


def _usable(table: DataFrame, name: str, embedding: str) -> DataFrame:
    """``(name, vec, dim)`` of the vectors with values only."""
    whole = F.coalesce(F.size(embedding) > 0, F.lit(False)) & ~F.exists(embedding, lambda x: x.isNull())
    rows = table.filter(whole).select(F.col(name), F.transform(embedding, lambda x: x.cast("double")).alias("vec"))
    return rows.withColumn("dim", F.size("vec"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of length one."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(vectors), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1.0)


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))


def _centres(rows: DataFrame, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension the numbers and the unit vectors of the centres."""
    wanted = min(MOST_CENTRES, max(1, isqrt(rows.count())))
    chosen = rows.orderBy(F.xxhash64(F.lit(7), name), name).limit(wanted).select("dim", "vec").collect()
    out = {}
    for dim in {r["dim"] for r in chosen}:
        own = [i for i, r in enumerate(chosen) if r["dim"] == dim]
        out[dim] = (np.array(own), _matrix(pa.array([chosen[i]["vec"] for i in own])))
    return out


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _placed(rows: DataFrame, name: str, centres: dict) -> DataFrame:
    """Every vector with its nearest centre and the angle to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in _by_dimension(batch):
                cell, angle = np.full(some.num_rows, NO_CENTRE), np.zeros(some.num_rows)
                if dim in centres:
                    numbers, c = centres[dim]
                    angles = _angles(_matrix(some.column("vec")), c)
                    nearest = angles.argmin(axis=1)
                    cell, angle = numbers[nearest], angles[np.arange(len(nearest)), nearest]
                columns = [some.column(name), some.column("vec"), some.column("dim"), pa.array(cell, pa.int32()), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, [name, "vec", "dim", "cell", "angle"])

    kind = dict(rows.dtypes)[name]
    return rows.mapInArrow(place, f"{name} {kind}, vec array<double>, dim int, cell int, angle double")


def _regions(counts: dict[int, int], rows: int) -> dict[int, int]:
    """Cells to regions: neighbouring numbers share a region of at most ``rows`` vectors, a larger cell has its own."""
    out, region, used = {}, -1, rows
    for cell in sorted(counts):
        if used + counts[cell] > rows:
            region, used = region + 1, 0
        out[cell] = region
        used += counts[cell]
    return out


@dataclass(frozen=True)
class _Cells:
    """The filled cells: their centres by dimension, the least and the largest angle of their vectors, and their regions."""

    centres: dict[int, tuple[np.ndarray, np.ndarray]]
    reach: dict[int, tuple[float, float]]
    region: dict[int, int]


def _visits(asked: DataFrame, cells: _Cells, probe: bool) -> DataFrame:
    """``(query_id, vec, floor, dim, region, cells)``: the cells next to each query, or the others that may hold a vector of at least ``floor``.

    One row per query and region, so that a query's vector is not repeated for each cell.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in _by_dimension(batch):
                for at in range(0, some.num_rows, SLICE_ROWS):
                    yield regions_of(dim, some.slice(at, SLICE_ROWS))

    def regions_of(dim: int, some: pa.RecordBatch) -> pa.RecordBatch:
        if dim not in cells.centres:
            row, region = (np.arange(some.num_rows) if probe else np.empty(0, int)), np.full(some.num_rows if probe else 0, NO_CENTRE)
            first, cell = np.arange(len(row) + 1), region
        else:
            numbers, c = cells.centres[dim]
            filled = np.array([n in cells.reach for n in numbers], bool)
            numbers, c = numbers[filled], c[filled]
            angles = _angles(_matrix(some.column("vec")), c)
            wanted = np.zeros(angles.shape, dtype=bool)
            np.put_along_axis(wanted, angles.argsort(axis=1, kind="stable")[:, :PROBED_CELLS], True, axis=1)
            if not probe:
                least, most = (np.array([cells.reach[n][i] for n in numbers]) for i in (0, 1))
                nearest = np.maximum(0.0, np.maximum(angles - most, least - angles))
                floor = some.column("floor").to_numpy(zero_copy_only=False)
                wanted = ~wanted & (np.cos(np.minimum(nearest, np.pi)) >= floor[:, None] - SLACK)
            # numbers ascend and so do their regions
            of, (each, at) = np.array([cells.region[n] for n in numbers], int), np.nonzero(wanted)
            starts = np.flatnonzero(np.append(True, (np.diff(each) != 0) | (np.diff(of[at]) != 0))) if len(each) else np.empty(0, int)
            row, region, cell, first = each[starts], of[at[starts]], numbers[at], np.append(starts, len(each))
        taken = [some.column(c).take(pa.array(row, pa.int64())) for c in ("query_id", "vec", "floor", "dim")]
        listed = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(cell, pa.int32()))
        return pa.RecordBatch.from_arrays([*taken, pa.array(region, pa.int32()), listed], ["query_id", "vec", "floor", "dim", "region", "cells"])

    kind = dict(asked.dtypes)["query_id"]
    return asked.mapInArrow(visit, f"query_id {kind}, vec array<double>, floor double, dim int, region int, cells array<int>")


def _first(k: int, rows: np.ndarray, scores: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each row by score and place."""
    order = np.lexsort((places, -scores, rows))
    rows, scores, places = rows[order], scores[order], places[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    kept = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows)))) < k
    return rows[kept], scores[kept], places[kept]


def _cell_best(q: np.ndarray, floor: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, cosines and vector rows of the best ``k`` of a cell that reach each query's floor."""
    cosine = q @ m.T
    wanted = cosine >= (floor - SLACK)[:, None]
    if np.count_nonzero(wanted) > 2 * k * len(q) and len(m) > k:
        # of many equal cosines only the first k places can be among the best
        cosine = np.round(cosine, DIGITS)
        bar = np.partition(cosine, len(m) - k, axis=1)[:, len(m) - k, None]
        tied = cosine == bar
        wanted &= (cosine > bar) | (tied & (np.cumsum(tied, axis=1) <= k))
    row, place = np.nonzero(wanted)
    return _first(k, row, np.round(cosine[row, place], DIGITS), place)


def _compared(visits: DataFrame, placed: DataFrame, key: str, k: int, low: float, rows: int) -> DataFrame:
    """The best ``k`` of every block for each visiting query: (query_id, key, score).

    Regions and their visitors are dealt to blocks of about ``rows``; a query meets only the cells that it visits.
    """
    parts = placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    turns = visits.groupBy("dim", "region").agg(F.ceil(F.count("*") / rows).cast("int").alias("turns"))
    # a row for each region that is visited: the planner sees how small it is, and no vector moves to meet it
    grid = stored(parts.join(turns, ["dim", "region"]), "grid")

    def dealt(table: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """A row's own part by hash, once for each part of the other side."""
        number = F.pmod(F.xxhash64(F.lit(3), name), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return table.join(grid, ["dim", "region"]).withColumn(f"{own}_no", number).withColumn(f"{other}_no", every)

    block = ["dim", "region", "parts_no", "turns_no"]
    left = dealt(visits, "query_id", "turns", "parts").select("query_id", "vec", "floor", "cells", *block)
    right = dealt(placed, key, "parts", "turns").select(key, "vec", "cell", *block)

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, keys = queries.column("query_id").combine_chunks(), vectors.column(key).combine_chunks()
        found, held = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)), []
        if len(ids) and len(keys):
            # vectors stand in key order, so a smaller place breaks ties by key
            order = np.array(pc.sort_indices(keys))
            m, cell = _matrix(vectors.column("vec").combine_chunks())[order], vectors.column("cell").to_numpy()[order]
            q, floor = _matrix(queries.column("vec").combine_chunks()), queries.column("floor").to_numpy()
            lists = queries.column("cells").combine_chunks()
            visited, visitor = lists.flatten().to_numpy(), lists.value_parent_indices().to_numpy()
            for number in np.unique(cell).tolist():
                places, rows = np.flatnonzero(cell == number), visitor[visited == number]
                some = m[places]
                for at in range(0, len(rows), SLICE_ROWS):
                    own = rows[at : at + SLICE_ROWS]
                    row, score, place = _cell_best(q[own], floor[own], some, k)
                    held.append((own[row], score, places[place]))
                if sum(len(h[0]) for h in held) > HELD_ROWS:
                    held = [_first(k, *(np.concatenate(x) for x in zip(*held)))]
            if held:
                found = _first(k, *(np.concatenate(x) for x in zip(*held)))
                found = tuple(x[found[1] >= low] for x in found)
        row, score, place = found
        chosen = order[place] if len(place) else place
        return pa.table({"query_id": ids.take(pa.array(row, pa.int64())), key: keys.take(pa.array(chosen, pa.int64())), "score": pa.array(score, pa.float64())})

    kinds = dict(visits.dtypes) | dict(placed.dtypes)
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(best, f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double")


def _block_rows(queries: int, vectors: int, cores: int) -> int:
    """Rows of a block: at most BLOCK_ROWS, fewer where the blocks would not keep the cores busy."""
    return max(1, min(BLOCK_ROWS, max(LEAST_ROWS, isqrt(queries * vectors // (4 * cores)))))


def _search(queries: DataFrame, vectors: DataFrame, key: str, k: int, threshold: float | None, embedding: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The compared pairs that may be among the best, the visits, and the placed vectors."""
    low = -np.inf if threshold is None else threshold
    asked = stored(_usable(queries, "query_id", embedding), "queries").withColumn("floor", F.lit(float(max(low, -2.0))))
    rows = stored(_usable(vectors, key, embedding), "vectors")
    centres = _centres(rows, key)
    placed = stored(_placed(rows, key, centres), "placed")
    spread = placed.filter(F.col("cell") != NO_CENTRE).groupBy("cell").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count("*").alias("n")).collect()
    reach = {r["cell"]: (r["least"] - SLACK, r["most"] + SLACK) for r in spread}
    block = _block_rows(asked.count(), sum(r["n"] for r in spread), asked.sparkSession.sparkContext.defaultParallelism)
    cells = _Cells(centres, reach, _regions({r["cell"]: r["n"] for r in spread}, block))
    region = F.lit(NO_CENTRE)
    if cells.region:
        numbered = F.create_map(*(F.lit(x) for pair in cells.region.items() for x in pair))
        region = F.coalesce(F.try_element_at(numbered, "cell"), region)
    placed = placed.withColumn("region", region)

    near = _visits(asked, cells, probe=True)
    first = stored(_compared(near, placed, key, k, low, block), "compared")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floors = first.withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("found"))
    bounded = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("found", "floor")).drop("found")
    far = _visits(stored(bounded, "bounded"), cells, probe=False)
    return first.unionByName(_compared(far, placed, key, k, low, block)), near.unionByName(far), placed


def vector_top_k(
    queries: DataFrame,
    vectors: DataFrame,
    *,
    key: str,
    k: int,
    threshold: float | None = None,
    embedding: str = "embedding",
) -> DataFrame:
    """Best k vectors per query by cosine: (query_id, rank, key, score), ties by key.

    Queries and vectors are compared where their dimensions agree.  A query or vector without a value or
    with a NULL element gives no hit; ``dimension_report`` counts them.  Query ids and keys are unique.
    """
    best, _, _ = _search(queries, vectors, key, k, threshold, embedding)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def comparison_report(queries: DataFrame, vectors: DataFrame, *, key: str, k: int, threshold: float | None = None, embedding: str = "embedding") -> DataFrame:
    """One row: the pairs that a search compares, and all pairs of one dimension."""
    _, visits, placed = _search(queries, vectors, key, k, threshold, embedding)
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("vectors"))
    visited = visits.select("dim", F.explode("cells").alias("cell"))
    compared = visited.join(sizes, ["dim", "cell"]).select("vectors", F.lit(0).alias("all_pairs"))
    asked = _usable(queries, "query_id", embedding).groupBy("dim").agg(F.count("*").alias("queries"))
    every = asked.join(placed.groupBy("dim").agg(F.count("*").alias("vectors")), "dim")
    both = compared.unionByName(every.select(F.lit(0).alias("vectors"), (F.col("queries") * F.col("vectors")).alias("all_pairs")))
    return both.agg(*(F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("vectors", "compared"), ("all_pairs", "all_pairs"))))


def dimension_report(vectors: DataFrame, dimension: int, embedding: str = "embedding") -> DataFrame:
    """How many vectors a search of ``dimension`` can and cannot use."""
    usable = F.coalesce(F.size(embedding) == dimension, F.lit(False))
    return vectors.groupBy(usable.alias("usable")).agg(F.count("*").alias("vectors"))
