"""Direct hits: questions that name a file.

Stems and questions meet in blocks; the places of the four-character runs that they share, followed along the question,
give the longest common run, so no pair that shares a run is a row of a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folia.functions import text as T
from folia.operators.blocks import Block, ranked, runs, units_of
from folia.operators.containment import overlapping
from folia.sources.shared import stored

# --- Fixed values: weights of a file name match ------------------------------------------
HINT_WEIGHT = 50.0
MIN_COMMON_RUN = 4
BASE_SCORE = 1.5
SCORE_SCALE = 100.0
#: The mark of a stem that has hints.
HINTED = "1"


def _longest_chain(places: Column) -> Column:
    """Length of the longest run of neighbouring numbers in a sorted array."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state: Column, place: Column) -> Column:
        run = F.when(place == state["last"] + 1, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(place.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(places, start, step, lambda state: state["best"])


def common_runs(stems: DataFrame, asked: DataFrame) -> DataFrame:
    """``(path, query_id, length)``: the longest string that ``s_norm`` and ``q_norm`` share, where it has four characters.

    It lists every such pair, by a join; ``filename_hits`` ranks without listing them.
    """
    ours = stems.select("path", F.posexplode(overlapping(F.col("s_norm"), MIN_COMMON_RUN)).alias("i", "run"))
    theirs = asked.select("query_id", F.posexplode(overlapping(F.col("q_norm"), MIN_COMMON_RUN)).alias("j", "run"))
    seeds = ours.join(theirs, "run").select("path", "query_id", "i", (F.col("i") - F.col("j")).alias("diagonal"))
    chains = seeds.groupBy("path", "query_id", "diagonal").agg(F.sort_array(F.collect_list("i")).alias("places"))
    longest = chains.groupBy("path", "query_id").agg(F.max(_longest_chain(F.col("places"))).alias("run"))
    return longest.select("path", "query_id", (F.col("run") + MIN_COMMON_RUN - 1).alias("length"))


def _index_places(block: Block) -> None:
    """Where each run of a block's stems stands, in the order of the runs."""
    units, block.stem_of = units_of(block.texts)
    value, places = runs(block.code[units], np.arange(len(units)), MIN_COMMON_RUN, block.bits)
    order = np.argsort(value, kind="stable")
    value, block.places = value[order], places[order]
    first = np.flatnonzero(np.diff(value, prepend=-1))
    block.place_runs, block.place_starts = value[first], np.append(first, len(value))
    #: length of the common run that ends before a place
    block.before = np.zeros(len(units) + 1, np.int32)
    block.short = [(row, text) for row, text in enumerate(block.texts) if len(text) < MIN_COMMON_RUN]


def _common_runs(block: Block, question: str) -> np.ndarray:
    """Length of the longest string that each stem shares with the question, where it has four characters."""
    best = np.zeros(len(block.ids), np.int32)
    units, _ = units_of([question])
    value, at = runs(block.code[units], np.arange(len(units)), MIN_COMMON_RUN, block.bits)
    last, held = -2, block.places[:0]
    if len(block.place_runs) and len(value):
        found = np.minimum(np.searchsorted(block.place_runs, value), len(block.place_runs) - 1)
        known = block.place_runs[found] == value
        for j, run in zip(at[known].tolist(), found[known].tolist()):
            places = block.places[block.place_starts[run] : block.place_starts[run + 1]]
            lengths = block.before[places] + 1 if j == last + 1 else np.ones(len(places), np.int32)
            block.before[held + 1] = 0
            block.before[places + 1] = lengths
            np.maximum.at(best, block.stem_of[places], lengths)
            last, held = j, places
        block.before[held + 1] = 0
    return np.where(best > 0, best + MIN_COMMON_RUN - 1, 0)


def _scores(block: Block, question: str, words: list[str], marks: list[str], grams: int, shared: np.ndarray) -> np.ndarray:
    """Scores of a block's stems; ``words`` are the question's hints.  A question with hints takes no run from a stem that has other hints only."""
    if not hasattr(block, "places"):
        _index_places(block)
    lengths = _common_runs(block, question)
    for row, text in block.short:
        if text in question:
            lengths[row] = max(lengths[row], len(text))
    if 0 < len(question) < MIN_COMMON_RUN:
        for row, text in enumerate(block.texts):
            if question in text:
                lengths[row] = max(lengths[row], len(question))
    hints = np.zeros(len(block.ids))
    for hint in words:
        for stem, rows in block.rows_of.items():
            if hint in stem:
                hints[rows] += 1
    hinted = np.zeros(len(block.ids), bool)
    hinted[block.marks.get((0, HINTED), [])] = True
    return np.where(hinted & (hints == 0) & bool(words), 0.0, lengths) + HINT_WEIGHT * hints


def _best_paths(paths: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(query_id, path, score, path_rank)``; different questions meet the stems in blocks (see ``blocks``)."""
    none = F.slice(F.array(F.lit("")), 1, 0)
    classes = asked.groupBy("question").agg(F.first("q_norm").alias("text"), F.first("q_hints").alias("words"))
    classes = classes.select("question", F.monotonically_increasing_id().alias("q"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("words", none).alias("words"))
    classes = stored(classes.withColumn("marks", none).withColumn("grams", F.lit(0)), "classes")
    hinted = F.when(F.size("stem_hints") > 0, HINTED)
    stems = paths.select(
        F.monotonically_increasing_id().alias("t"), "path", "first_seen", F.col("s_norm").alias("text"), F.array("stem").alias("words"), F.array(hinted).alias("marks")
    )
    stems = stored(stems, "stems")
    found = ranked(stems, classes.drop("question"), [(F.col("first_seen"), True), (F.col("path"), True)], _scores, k)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first_seen", "path"))
    best = found.join(stems.select("t", "path", "first_seen"), "t").withColumn("path_rank", rank).filter(F.col("path_rank") <= k)
    members = asked.select("query_id", "question").join(classes.select("question", "q"), "question")
    return best.join(members, "q").select("query_id", "path", "score", "path_rank")


def filename_hits(
    questions: DataFrame, documents: DataFrame, *, order: str, max_paths: int = 3, chunks_per_path: int = 2
) -> DataFrame:
    """First rows of the best matching paths: (query_id, path, order, retrieval_score).

    ``documents`` has one row per chunk with ``path`` and an ``order`` column.  A question with
    numbered hints never matches a path that bears other numbers only.
    """
    asked = questions.withColumn("q_norm", T.norm_text("question")).withColumn("q_hints", T.filename_hints("question"))
    stem = T.path_stem("path")
    paths = documents.groupBy("path").agg(F.min(order).alias("first_seen")).select(
        "first_seen", "path", stem.alias("stem"), T.norm_text(stem).alias("s_norm"), T.filename_hints(stem).alias("stem_hints")
    )
    chosen = _best_paths(paths.filter("s_norm <> ''"), asked, max_paths)
    # The first chunks of a path are the same for every question; only chosen paths are numbered.
    chunk = F.row_number().over(Window.partitionBy("path").orderBy(order))
    opening = documents.join(chosen.select("path").distinct(), "path", "left_semi").withColumn("chunk_rank", chunk).filter(F.col("chunk_rank") <= chunks_per_path)
    return (
        opening.join(chosen, "path")
        .withColumn("retrieval_score", F.lit(BASE_SCORE) + F.col("score") / F.lit(SCORE_SCALE))
        .drop("score", "chunk_rank")
    )
