"""Merkle manifest of a dataset with incremental witnesses.

A tree has sixteen children a node.  Leaves are appended in order: an append attaches an empty witness to its leaf
and puts it into the open run of the lowest level; when a run is complete its digest moves up a level, and the
siblings in the run extend the witness of every leaf below each of them.  Runs that stay open are closed at the end.

The leaves of one source are numbered without a gap by a range sort, and cut into blocks of 4,096, which are aligned
to three levels.  One task appends one block.  The blocks' roots are further appends, in blocks of 4,096 again, until
each source has one node; the sources' nodes are the leaves of the last tree.  On the way back each level's witnesses
extend those of the blocks below, so a leaf's witness runs to the root although no task holds more than one block.

Defined results: leaves of one id ascend by digest, a NULL id comes first and is never tampered with; rows that are
equal in every column are leaves of their own, next to each other; a source with one leaf is that leaf; extra
columns are not read.  No rows give no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.llm.words import record
from folia.sources.shared import stored

ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
DIGEST = 64
#: The share of documents that the check tampers with: ids whose CRC-32 this number divides.
TAMPERED_OF = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "steps array<struct<place: int, others: string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(_field(fields[f]) for f in FIELDS)).cast("binary"), 256)


class Frontier:
    """Open subtrees of a tree that only grows at its end.

    ``open[level]`` holds the nodes that wait for siblings, each with the witnesses of the leaves below it.  A witness
    is a list of steps from the leaf upward: the node's place in its run, and the others' digests in one string.
    """

    def __init__(self) -> None:
        self.open: list[list[tuple[str, list[list]]]] = [[]]

    def append(self, node: str) -> list[tuple[int, str]]:
        witness: list[tuple[int, str]] = []
        self._push(0, node, [witness])
        return witness

    def _push(self, level: int, node: str, below: list[list]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((node, below))
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        all_digests, members = "".join(node for node, _ in run), []
        for place, (_, below) in enumerate(run):
            step = (place, all_digests[: place * DIGEST] + all_digests[(place + 1) * DIGEST :])
            for witness in below:
                witness.append(step)
            members += below
        self._push(level + 1, digest(all_digests), members)

    def finish(self, least: int) -> str:
        """The root: open runs are closed while several nodes remain, and in any case up to ``least`` levels."""
        level = 0
        while level < least or len(self.open[level]) > 1 or any(self.open[level + 1 :]):
            if self.open[level]:
                self._close(level)
            level += 1
        return self.open[level][0][0]


def folded(node: str, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf and its witness lead to."""
    for place, others in steps:
        node = digest(others[: place * DIGEST] + node + others[place * DIGEST :])
    return node


def _appended(block: pa.Table) -> tuple[pa.Table, str, list[list]]:
    """A block in order, its root and its members' witnesses; a block of several has all its levels."""
    block = block.sort_by("pos")
    tree = Frontier()
    witnesses = [tree.append(node) for node in block.column("node").to_pylist()]
    return block, tree.finish(LEVELS if block.column("n")[0].as_py() > BLOCK else 0), witnesses


# --- order -----------------------------------------------------------------------------------
def numbered(rows: DataFrame, tree: str, keys: list[str]) -> DataFrame:
    """``rows`` with ``pos``, gapless from 0 in the order of ``keys`` within ``tree``, and the count ``n``.

    A range sort deals a large tree over many tasks; the counts per task and tree give each its first number.
    """
    ordered = rows.repartitionByRange(tree, *keys).sortWithinPartitions(tree, *keys)
    ordered = stored(ordered.withColumn("line", F.monotonically_increasing_id()), "ordered")
    task = F.shiftrightunsigned("line", 33).alias("task")
    counts = ordered.groupBy(tree, task).agg(F.count("*").alias("rows"), F.min("line").alias("low"))
    whole = Window.partitionBy(tree)
    before = F.sum("rows").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(tree, "task", "low", F.coalesce(before, F.lit(0)).alias("base"), F.sum("rows").over(whole).alias("n"))
    placed = ordered.withColumn("task", task).join(firsts, [tree, "task"])
    return placed.withColumn("pos", F.col("base") + F.col("line") - F.col("low")).drop("line", "task", "low", "base")


# --- up and down -----------------------------------------------------------------------------
def _roots(nodes: DataFrame) -> DataFrame:
    """The blocks of ``nodes(tree, pos, n, node)`` as the nodes of the next tree."""

    def root(block: pa.Table) -> pa.Table:
        block, node, _ = _appended(block)
        first = block.slice(0, 1)
        n = first.column("n")[0].as_py()
        return pa.Table.from_batches(
            [record({"tree": first.column("tree").combine_chunks(), "pos": [first.column("block")[0].as_py()], "n": [-(-n // BLOCK)], "node": [node]})]
        )

    kind = dict(nodes.dtypes)["tree"]
    slim = nodes.select("tree", "pos", "n", "node", _block())
    return slim.groupBy("tree", "block").applyInArrow(root, f"tree {kind}, pos bigint, n bigint, node string")


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).alias("block")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the nodes above them, block by block, up to one node a tree."""
    levels = [nodes]
    while len(levels) == 1 or levels[-1].filter("n > 1").limit(1).count():
        levels.append(stored(_roots(levels[-1]), "roots"))
    return levels


def extended(nodes: DataFrame, outer: DataFrame, emit, schema: str) -> DataFrame:
    """``emit`` of every block with its members' witnesses and the one row of ``outer`` that its root has."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block, _, witnesses = _appended(block)
        up = above.slice(0, 1).to_pylist()[0]
        up["steps"] = [(s["place"], s["others"]) for s in up["steps"]]
        return pa.Table.from_batches([record(emit(block, witnesses, up))])

    blocks = nodes.withColumn("block", _block()).groupBy("tree", "block")
    return blocks.cogroup(outer.groupBy("tree", "pos")).applyInArrow(run, schema)


def _lowered(levels: list[DataFrame], outer: DataFrame) -> DataFrame:
    """Witnesses of the roots of the lowest blocks, from those of the top nodes."""
    kind = dict(levels[0].dtypes)["tree"]

    def emit(block: pa.Table, witnesses: list, up: dict) -> dict:
        return {
            "tree": block.column("tree").combine_chunks(),
            "pos": block.column("pos").combine_chunks(),
            "subroot": [up["subroot"]] * len(block),
            "root": [up["root"]] * len(block),
            "steps": _steps([w + up["steps"] for w in witnesses]),
        }

    for nodes in reversed(levels[1:-1]):
        outer = stored(extended(nodes, outer, emit, f"tree {kind}, pos bigint, subroot string, root string, {STEPS}"), "witnesses")
    return outer


def _steps(witnesses: list[list[tuple[int, str]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
    return pa.array([[{"place": p, "others": o} for p, o in w] for w in witnesses], kind)


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row of ``docs``.

    The proof's digest covers the siblings from the leaf to the root; the folded root starts from the leaf of the
    tampered row where the row is one that the check tampers with.
    """
    own = {f: F.col(f) for f in FIELDS}
    lowered = own | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED_OF)) == 0
    slim = docs.select(
        # NULL first: the other names follow a letter
        F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("tree"),
        "doc_id",
        leaf_digest(own).alias("node"),
        F.when(tampered, leaf_digest(lowered)).alias("altered"),
    )
    leaves = stored(numbered(stored(slim, "leaves"), "tree", ["doc_id", "node"]), "numbered")
    levels = grown(leaves)

    names = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    sources = stored(numbered(names, "tree", ["name"]), "sources")
    top = grown(sources)
    last = top[-1].select("tree", "pos", F.lit("").alias("subroot"), F.col("node").alias("root"), F.array().cast(STEPS[6:]).alias("steps"))

    def of_source(block: pa.Table, witnesses: list, up: dict) -> dict:
        return {
            "tree": block.column("name").combine_chunks(),
            "pos": [0] * len(block),
            "subroot": block.column("node").combine_chunks(),
            "root": [up["root"]] * len(block),
            "steps": _steps([w + up["steps"] for w in witnesses]),
        }

    outer = extended(sources, _lowered(top, last), of_source, f"tree string, pos bigint, subroot string, root string, {STEPS}")
    outer = _lowered(levels, stored(outer, "witnesses"))

    def of_leaf(block: pa.Table, witnesses: list, up: dict) -> dict:
        above = "".join(o for _, o in up["steps"])
        nodes, altered = block.column("node").to_pylist(), block.column("altered").to_pylist()
        back = [folded(b or a, w + up["steps"]) for a, b, w in zip(nodes, altered, witnesses)]
        return {
            "doc_id": block.column("doc_id").combine_chunks(),
            "leaf": nodes,
            "subroot": [up["subroot"]] * len(block),
            "root": [up["root"]] * len(block),
            "proof_sha256": [digest("".join(o for _, o in w) + above) for w in witnesses],
            "folded_root": back,
            "verified": [b == up["root"] for b in back],
        }

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return extended(leaves, outer, of_leaf, schema)
