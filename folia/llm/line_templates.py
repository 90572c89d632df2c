"""Line dedup by a log-template tree.

A line's path in the tree is its number of tokens and its first three tokens, with variable fields (tokens with
a digit, addresses) as wildcards.  The lines at a leaf are split into groups until each agrees: the token that most
of a group have at a position, or a wildcard where none has a majority, is its template where it fixes more than half
of the positions, and the lines that do not match go on as a group of their own.  A group that does not agree is split
by its tokens at the position that tokens of five lines or more cover best, the rarer tokens together.  So a line that
five documents have ends in a template, whatever else shares its leaf.  A line of fewer than five tokens has a leaf of its
own, without wildcards, and so is a template of its own.  The split tells the template of each different line, so a line
meets one template only when documents are counted.  A template recurs if at least five documents with different
surroundings have a line of it.  Where lines are dropped, a line belongs to the recurring template that fixes most of it,
and goes everywhere but in the document with the least id that has such a line.

Copies of one document must not make its own lines recur, since near-dedup decides about them.  So documents
count by signatures, the least hash of their other lines in each of several orders of the hashes, and in one order
signatures must make up a fifth of the documents: copies share most lines and so the signatures, while documents
that share only some passage have their own.  Documents without another line count as one.

Defined results: lines without a token are kept; NULL and empty texts have no lines; a NULL
id counts as the largest; equal rows share one decision; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folia.llm.words import parts, record
from folia.sources.shared import stored

#: Tokens that lead to a leaf; a line of fewer than ``SHORT`` tokens is led by all of them, as they stand.
LEAD, SHORT = 3, 5
LEAST_DOCS, LEAST_SHARE = 5, 0.2
#: Each order of the leaf hashes is their order after an exclusive or; the upper bits differ, so that a hash is least in one at most.
ORDERS = (0, 0x53A91C6E7F20D84B, 0xA6174BD2E9358C1F - (1 << 64), 0xF8C26D0B4179E3A5 - (1 << 64))
#: Recurring leaves that go to the tasks as one sorted array at most (eight bytes each); beyond, lines are joined.
SENT_LEAVES = 1 << 20
#: Different lines of a group that one task splits at most; larger groups are split by aggregates.
TASK_LINES = 1 << 14
#: Bytes of templates that go to the tasks at most.
SENT_BYTES = 32 << 20
WILD = "<*>"
VARIABLE = re.compile(r"[0-9]|://|@")


def leaf_of(tokens: list[str]) -> int:
    lead = tokens if len(tokens) < SHORT else [WILD if VARIABLE.search(t) else t for t in tokens[:LEAD]]
    return xxhash.xxh3_64_intdigest("\x1f".join([str(len(tokens)), *lead]).encode("utf-8", "replace")) - (1 << 63)


def _lines(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Number, leaf and tokens of each line that has a token."""
    for i, line in enumerate((text or "").split("\n")):
        tokens = line.split()
        if tokens:
            yield i, leaf_of(tokens), tokens


def _marks(leaves: set[int], wanted: set[int]) -> dict[int, list[int] | None]:
    """The signatures of a document for each wanted leaf, from its other leaves; none where it has no other."""
    if len(leaves) < 2:
        return dict.fromkeys(wanted)
    least = [sorted(leaf ^ order for leaf in leaves)[:2] for order in ORDERS]
    return {leaf: [b if leaf ^ order == a else a for order, (a, b) in zip(ORDERS, least)] for leaf in wanted}


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves of each document, once each, with a hash of them all."""
    for _, texts in parts(batches):
        out: list[int] = []
        contents: list[int] = []
        for text in texts:
            leaves = sorted({leaf for _, leaf, _ in _lines(text)})
            if leaves:
                out += leaves
                contents += [xxhash.xxh3_64_intdigest(repr(leaves)) - (1 << 63)] * len(leaves)
        yield record({"leaf": pa.array(out, pa.int64()), "content": pa.array(contents, pa.int64())})


def _tokens(only: frozenset[int] | None):
    """Lines with their tokens, of the given leaves or of all."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in parts(batches):
            ids, hashes = rows.column("doc_id").to_pylist(), rows.column("hash").to_pylist()
            out = []
            for text, doc_id, h in zip(texts, ids, hashes):
                lines = list(_lines(text))
                leaves = {leaf for _, leaf, _ in lines}
                marks = _marks(leaves, leaves if only is None else leaves & only)
                out += [(doc_id, h, i, leaf, marks[leaf], t) for i, leaf, t in lines if leaf in marks]
            if out:
                a, b, c, d, e, f = zip(*out)
                yield record({
                    "doc_id": pa.array(a, rows.schema.field("doc_id").type), "hash": pa.array(b, pa.int64()), "line": pa.array(c, pa.int32()),
                    "leaf": pa.array(d, pa.int64()), "marks": pa.array(e, pa.list_(pa.int64())), "tokens": pa.array(f, pa.list_(pa.string())),
                })

    return scan


def _shared(leaves: DataFrame) -> DataFrame:
    """Leaves that enough documents of different content have; no other can recur."""
    return leaves.distinct().groupBy("leaf").agg(F.count("*").alias("contents")).filter(F.col("contents") >= LEAST_DOCS).select("leaf")


def _recurring(marked: DataFrame) -> DataFrame:
    """Templates whose documents have enough signatures of their own; counted by signature first, so no template is hot."""
    by_mark = marked.select("template", F.posexplode_outer("marks").alias("order", "mark")).groupBy("template", "order", "mark").agg(F.count("*").alias("n"))
    by_order = by_mark.groupBy("template", "order").agg(F.count("mark").alias("marks"), F.sum(F.when(F.col("mark").isNotNull(), F.col("n"))).alias("docs"))
    alone = F.max(F.col("order").isNull().cast("int"))
    counted = by_order.groupBy("template").agg((F.max("marks") + alone).alias("marks"), (F.coalesce(F.max("docs"), F.lit(0)) + alone).alias("docs"))
    return counted.filter((F.col("marks") >= LEAST_DOCS) & (F.col("marks") >= LEAST_SHARE * F.col("docs"))).select("template")


def _split(group: list[tuple[tuple[str, ...], int]]) -> Iterator[tuple[dict[int, str], list[tuple[str, ...]]]]:
    """The tokens by place that each template of a group of lines fixes, and its lines; a line has its count."""
    waiting = [(group, 0)]
    while waiting:
        lines, before = waiting.pop()
        total = sum(n for _, n in lines)
        if total < LEAST_DOCS:
            continue
        columns = [Counter() for _ in lines[0][0]]
        for tokens, n in lines:
            for column, token in zip(columns, tokens):
                column[token] += n
        fixed: dict[int, str] = {}
        decisive = (0, 0)
        for place, column in enumerate(columns):
            top, token = max((n, t) for t, n in column.items())
            if top >= LEAST_DOCS and top * 2 > total:
                fixed[place] = token
            if top < total:
                decisive = max(decisive, (sum(n for n in column.values() if n >= LEAST_DOCS), -place))
        if len(fixed) * 2 > len(columns) and total != before:
            unlike = [any(t[p] != token for p, token in fixed.items()) for t, _ in lines]
            yield fixed, [t for (t, _), other in zip(lines, unlike) if not other]
            waiting.append(([x for x, other in zip(lines, unlike) if other], total))
        elif decisive[0]:
            place, parted = -decisive[1], {}
            for x in lines:
                parted.setdefault(x[0][place] if columns[place][x[0][place]] >= LEAST_DOCS else None, []).append(x)
            waiting += [(x, 0) for x in parted.values()]


ASSIGNED = "leaf bigint, kind bigint, places array<int>, fixed array<string>"


def _split_small(rows: pa.Table) -> pa.Table:
    kinds = {tuple(t): k for t, k in zip(rows.column("tokens").to_pylist(), rows.column("kind").to_pylist())}
    group = sorted((tuple(t), n) for t, n in zip(rows.column("tokens").to_pylist(), rows.column("n").to_pylist()))
    found = [(kinds[t], sorted(fixed.items())) for fixed, own in _split(group) for t in own]
    return pa.table({
        "leaf": pa.array(rows.column("leaf").to_pylist()[:1] * len(found), pa.int64()), "kind": pa.array([k for k, _ in found], pa.int64()),
        "places": pa.array([[p for p, _ in f] for _, f in found], pa.list_(pa.int32())), "fixed": pa.array([[t for _, t in f] for _, f in found], pa.list_(pa.string())),
    })


def _split_once(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the groups that agree with their templates, and the groups that remain; the step of ``_split`` as aggregates."""
    support = groups.select("leaf", "group", "before", "n", F.posexplode("tokens").alias("place", "token"))
    support = stored(support.groupBy("leaf", "group", "before", "place", "token").agg(F.sum("n").alias("n")), "support")
    often = F.col("n") >= LEAST_DOCS
    at = support.groupBy("leaf", "group", "before", "place").agg(
        F.sum("n").alias("total"), F.max(F.struct("n", "token")).alias("top"), F.coalesce(F.sum(F.when(often, F.col("n"))), F.lit(0)).alias("covered")
    )
    major = (F.col("top.n") >= LEAST_DOCS) & (F.col("top.n") * 2 > F.col("total"))
    parting = (F.col("covered") > 0) & (F.col("top.n") < F.col("total"))
    state = at.groupBy("leaf", "group", "before").agg(
        F.max("total").alias("total"), F.count("*").alias("width"),
        F.array_sort(F.collect_list(F.when(major, F.struct("place", F.col("top.token").alias("token"))))).alias("major"),
        (-F.max(F.when(parting, F.struct("covered", (-F.col("place")).alias("back"))))["back"]).alias("decisive"),
    )
    agrees = (F.size("major") * 2 > F.col("width")) & (F.col("total") != F.col("before"))
    state = stored(state.filter(F.col("total") >= LEAST_DOCS).withColumn("agrees", agrees).drop("before", "leaf"), "state")
    places, fixed = F.col("major.place").alias("places"), F.col("major.token").alias("fixed")
    known = support.filter(often).select("group", F.col("place").alias("decisive"), F.col("token").alias("at"))
    parted = groups.join(state, "group").filter("NOT agrees AND decisive IS NOT NULL").withColumn("at", F.expr("element_at(tokens, decisive + 1)"))
    parted = parted.join(known.withColumn("often", F.lit(True)), ["group", "decisive", "at"], "left")
    parted = parted.withColumn("group", F.xxhash64("group", "decisive", F.coalesce("often", F.lit(False)), F.when(F.col("often"), F.col("at"))))
    unlike = F.expr("exists(major, m -> element_at(tokens, m.place + 1) != m.token)")
    agreeing = groups.drop("before").join(state.filter("agrees"), "group")
    found = agreeing.filter(~unlike).select("leaf", "kind", places, fixed)
    rest = agreeing.filter(unlike)
    rest = rest.withColumn("group", F.xxhash64("group", F.lit("rest")))
    parted = parted.select("leaf", "group", F.lit(0).cast("bigint").alias("before"), "kind", "tokens", "n")
    return found, parted.unionByName(rest.select("leaf", "group", F.col("total").alias("before"), "kind", "tokens", "n"))


def _all_templates(lines: DataFrame, task_lines: int) -> DataFrame:
    """``(template, leaf, kind, places, fixed)``: each different line of ``lines(leaf, kind, tokens)`` with its one template."""
    groups = lines.groupBy("leaf", "kind").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    groups = groups.select("leaf", F.col("leaf").alias("group"), F.lit(0).cast("bigint").alias("before"), "kind", "tokens", "n")
    every = None
    while True:
        groups = stored(groups, "groups")
        sizes = groups.groupBy("group").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter(F.col("total") >= LEAST_DOCS)
        sizes = stored(sizes, "sizes")
        small = groups.join(sizes.filter(F.col("kinds") <= task_lines), "group", "left_semi")
        small = small.groupBy("group").applyInArrow(_split_small, ASSIGNED)
        every = small if every is None else every.unionByName(small)
        large = sizes.filter(F.col("kinds") > task_lines)
        if large.isEmpty():
            return every.select(F.xxhash64("leaf", "places", "fixed").alias("template"), "leaf", "kind", "places", "fixed")
        found, groups = _split_once(groups.join(large, "group", "left_semi"))
        every = every.unionByName(found)


def _matched(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines with each template that they match, met by the tokens at its places."""
    at = F.expr("transform(places, p -> element_at(tokens, p + 1))")
    return lines.join(found.select("leaf", "places").distinct(), "leaf").withColumn("fixed", at).join(found, ["leaf", "places", "fixed"])


def _keyed(docs: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    return keyed.withColumn("hash", F.xxhash64("text"))


def templates(docs: DataFrame, *, task_lines: int = TASK_LINES, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``(template, leaf, places, fixed, first_id)``: recurring templates, the tokens they fix, and the least id that has them."""
    kind = dict(docs.dtypes)["doc_id"]
    keyed = _keyed(docs)
    leaves = stored(_shared(keyed.select("text").mapInArrow(_leaves, "leaf bigint, content bigint")), "leaves")
    schema = f"doc_id {kind}, hash bigint, line int, leaf bigint, marks array<bigint>, tokens array<string>"
    if leaves.count() <= SENT_LEAVES:
        only = frozenset(r["leaf"] for r in leaves.toLocalIterator())
        lines = keyed.mapInArrow(_tokens(only), schema)
    else:
        lines = keyed.mapInArrow(_tokens(None), schema).join(leaves, "leaf", "left_semi")
    lines = stored(lines.select("doc_id", "hash", "leaf", "marks", F.xxhash64("tokens").alias("kind"), "tokens"), "lines")

    assigned = stored(_all_templates(lines, task_lines), "assigned")
    matching = lines.select("doc_id", "hash", "marks", "leaf", "kind").join(assigned.select("leaf", "kind", "template"), ["leaf", "kind"])
    again = _recurring(matching.select("doc_id", "hash", "marks", "template").distinct())
    found = assigned.select("template", "leaf", "places", "fixed").distinct().join(again, "template", "left_semi")
    found = stored(found, "found")
    return stored(found.join(_firsts(docs, found, sent_bytes), "template"), "templates")


def _sent(found: DataFrame, sent_bytes: int) -> list | None:
    """The templates for the tasks, or None where they are too large to send."""
    size = found.agg(F.coalesce(F.sum(F.octet_length(F.array_join("fixed", " ")) + 16 * F.size("fixed") + 96), F.lit(0))).first()[0]
    return list(found.toLocalIterator()) if size <= sent_bytes else None


def _firsts(docs: DataFrame, found: DataFrame, sent_bytes: int) -> DataFrame:
    """``(template, first_id)`` over all lines that belong to each template; the least id of a batch first."""
    rows = _sent(found, sent_bytes)
    if rows is None:
        lines = _best_lines(docs, found)
    else:
        matcher = Matcher([(r["template"], r["leaf"], r["places"], r["fixed"], None) for r in rows])

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in parts(batches):
                known: dict[int, object] = {}
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                    for _, template, _ in matcher.lines(text):
                        old = known.get(template)
                        known[template] = doc_id if old is None or (doc_id is not None and doc_id < old) else old
                yield record({"template": pa.array(known, pa.int64()), "doc_id": pa.array(known.values(), batch.schema.field("doc_id").type)})

        lines = _keyed(docs).select("doc_id", "text").mapInArrow(least, f"template bigint, doc_id {dict(docs.dtypes)['doc_id']}")
    return lines.groupBy("template").agg(F.min("doc_id").alias("first_id"))


class Matcher:
    """Line numbers to drop from a text, given the recurring templates."""

    def __init__(self, rows: list[tuple[int, int, list[int], list[str], object]]) -> None:
        self.known: dict[int, dict[tuple[int, ...], dict[tuple[str, ...], tuple[int, object]]]] = {}
        for template, leaf, places, fixed, first in rows:
            self.known.setdefault(leaf, {}).setdefault(tuple(places), {})[tuple(fixed)] = template, first

    def lines(self, text: str | None) -> Iterator[tuple[int, int, object]]:
        """Number, template and first id of each line that belongs to a template."""
        for number, leaf, tokens in _lines(text):
            found = []
            for places, known in self.known.get(leaf, {}).items():
                match = known.get(tuple([tokens[p] for p in places]))
                if match:
                    found.append((len(places), *match))
            if found:
                yield number, *max(found, key=lambda x: x[:2])[1:]

    def __call__(self, doc_id: object, text: str | None) -> list[int]:
        dropped, own = [], set()
        for number, template, first in self.lines(text):
            if doc_id == first and template not in own:
                own.add(template)
            else:
                dropped.append(number)
        return dropped


def _dropping(matcher: Matcher):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in parts(batches, "__text"):
            drop = [matcher(i, t) for i, t in zip(rows.column("__id").to_pylist(), texts)]
            drops = pa.array([d or None for d in drop], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, drops], [*rows.schema.names, "__drop"])

    return scan


def _best_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, hash, line, template)`` of the lines that belong to a template, met by leaf and tokens."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, hash bigint, line int, leaf bigint, marks array<bigint>, tokens array<string>"
    lines = _matched(_keyed(docs).mapInArrow(_tokens(None), schema).distinct(), found)
    best = F.max_by("template", F.struct(F.size("places"), "template")).alias("template")
    return lines.groupBy("doc_id", "hash", "line").agg(best)


def _joined_drops(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(__gone_id, __gone_hash, __drop)`` where the templates are too many to send: lines meet them by leaf and tokens."""
    lines = _best_lines(docs, found).join(found.select("template", "first_id"), "template")
    place = F.row_number().over(Window.partitionBy("doc_id", "hash", "template").orderBy("line"))
    gone = lines.withColumn("n", place).filter((F.col("n") > 1) | ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    gone = gone.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set("line")).alias("__drop"))
    return stored(gone, "gone").select(F.col("doc_id").alias("__gone_id"), F.col("hash").alias("__gone_hash"), "__drop")


def with_lines_dropped(docs: DataFrame, *, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``docs`` with ``text`` shortened, and ``__lines``, ``__dropped`` and ``__numbers`` added.

    Templates of up to ``sent_bytes`` go to the tasks, and no text is shuffled; beyond, lines join them by leaf.
    """
    found = templates(docs, sent_bytes=sent_bytes)
    rows = _sent(found, sent_bytes)
    text = F.col("text").cast("string")
    if rows is not None:
        rows = [(r["template"], r["leaf"], r["places"], r["fixed"], r["first_id"]) for r in rows]
        keyed = docs.withColumns({"__id": F.col("doc_id"), "__text": text})
        schema = ", ".join([*(f"`{c}` {t}" for c, t in keyed.dtypes), "__drop array<int>"])
        joined = keyed.mapInArrow(_dropping(Matcher(rows)), schema)
    else:
        gone = _joined_drops(docs, found)
        same = docs["doc_id"].eqNullSafe(F.col("__gone_id")) & (F.xxhash64(text) == F.col("__gone_hash"))
        joined = docs.join(gone, same, "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__drop"), i)), "\n")
    return joined.select(
        *(F.when(F.col("__drop").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("__lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("bigint").alias("__dropped"),
        F.coalesce(F.array_join(F.col("__drop").cast("array<string>"), ","), F.lit("")).alias("__numbers"),
    )


def drop_recurring_lines(docs: DataFrame, *, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``docs`` without recurring lines; ``n_chars``, where there is one, follows the text."""
    found = with_lines_dropped(docs, sent_bytes=sent_bytes)
    columns = []
    for c, t in docs.dtypes:
        changed = F.when(F.col("__dropped") > 0, F.length("text").cast(t)).otherwise(F.col(c))
        columns.append(changed.alias(c) if c == "n_chars" else F.col(c))
    return found.select(columns)


def line_counts(docs: DataFrame) -> DataFrame:
    """Per row: lines, dropped lines, their numbers, and a digest of the text that stays."""
    found = with_lines_dropped(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.col("__numbers").alias("dropped_lines"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )
