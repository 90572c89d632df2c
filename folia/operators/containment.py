"""Which strings of one table occur inside the strings of another, and what tokens two tables share.

Both are equi-joins.  A string that occurs in another shares all its n-grams with it, so each is joined on one of
them, the one that the fewest strings of its table have, and the pair is then confirmed.  Shared tokens are joined
on the token and counted per pair.  Neither builds an index of its own or meets rows that share nothing.

Spark takes an exploded table for as large as the one it comes from, so it would broadcast a hundred rows a text
through the driver.  Joins of such rows are hinted: they are shuffled, or the other side is sent if it is measured small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.sources.shared import stored

LONGEST_GRAM = 4
#: Question tokens up to this many rows of a short string and an id are sent to every task, beyond it they are joined.
SENT_TOKENS = 1_000_000
#: A table up to this many rows of a string and a few numbers is sent to the exploded rows it meets.
SENT_ROWS = 100_000
#: A token of more texts than this is dealt over several tasks.
HOT_TEXTS = 200_000


def overlapping(text: Column, n: int) -> Column:
    """Every run of ``n`` characters in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct runs of the given sizes."""
    return F.array_distinct(F.concat(*(overlapping(text, n) for n in sizes)))


def with_anchor(needles: DataFrame) -> DataFrame:
    """``(needle, anchor)`` of the distinct non-empty needles: their rarest run of four characters, or all of a shorter one."""
    words = needles.select("needle").filter("needle <> ''").distinct()
    runs = words.select("needle", F.explode(F.when(F.char_length("needle") < LONGEST_GRAM, F.array("needle")).otherwise(grams(F.col("needle"), (LONGEST_GRAM,)))).alias("gram"))
    counts = runs.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", "gram")).alias("rarest")
    return runs.hint("merge").join(counts, "gram").groupBy("needle").agg(rarest).select("needle", F.col("rarest.gram").alias("anchor"))


def _met(exploded: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """``exploded`` rows joined with a stored ``side``; the exploded rows are never broadcast."""
    if side.count() <= SENT_ROWS:
        return exploded.join(F.broadcast(side), on)
    return exploded.hint("merge").join(side, on)


def contained_pairs(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """``(needle, key)`` of each distinct ``needle`` inside a ``hay`` of ``hays(key, hay)``; keys are unique.

    An empty string is inside nothing here.
    """
    anchors = stored(with_anchor(needles), "anchors")
    sizes = tuple(range(1, LONGEST_GRAM + 1))
    runs = hays.select("key", F.explode(grams(F.col("hay"), sizes)).alias("anchor"))
    candidates = _met(runs, anchors, "anchor").select("key", "needle")
    return candidates.join(hays.select("key", "hay"), "key").filter(F.contains("hay", "needle")).select("needle", "key")


def names_inside(names: DataFrame, hays: DataFrame) -> DataFrame:
    """``(needle, key)`` as ``contained_pairs`` gives them, for many short names that are alike.

    The hays are cut where a name could begin, to the lengths of the names that begin so, and the cuts meet the names by
    equality.  The cuts grow with the hays, where rows that meet on a run grow with the names that share it.
    """
    words = stored(names.select("needle").filter("needle <> ''").distinct(), "names")
    starts = words.groupBy(F.left("needle", F.lit(LONGEST_GRAM)).alias("start")).agg(F.collect_set(F.char_length("needle")).alias("lengths"))
    starts = stored(starts, "starts")
    sizes = [r[0] for r in words.select(F.least(F.char_length("needle"), F.lit(LONGEST_GRAM)).alias("size")).distinct().collect()]
    places = hays.select("key", "hay", F.char_length("hay").alias("chars")).filter("chars > 0").withColumn("at", F.explode(F.sequence(F.lit(1), "chars")))
    begun = F.array(*(F.when(F.col("at") + n <= F.col("chars") + 1, F.substring("hay", F.col("at"), F.lit(n))) for n in sorted(sizes))).cast("array<string>")
    runs = places.withColumn("start", F.explode(begun)).filter("start IS NOT NULL")
    cut = _met(runs, starts, "start").select("key", "hay", "at", "chars", F.explode("lengths").alias("length")).filter("at + length <= chars + 1")
    needles = cut.select("key", F.substring("hay", F.col("at"), F.col("length")).alias("needle"))
    return needles.join(words, "needle", "left_semi").select("needle", "key").distinct()


def shared_tokens(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``(q, t, shared, hits)`` of each pair of ``texts(t, tokens)`` and ``asked(q, token, is_keyword)`` that shares a token.

    ``shared`` counts grams and ``hits`` keywords.  Few questions go to the texts, which are dealt by number first, so that
    a pair is counted where its text is and no pair moves.  Many questions meet the texts on the token; a token of very
    many texts is dealt over as many parts as it needs, with its questions repeated in each.
    """
    asked = stored(asked, "tokens")
    counts = F.sum(1 - F.col("is_keyword")).alias("shared"), F.sum("is_keyword").alias("hits")
    if asked.count() <= SENT_TOKENS:
        exploded = texts.repartition("t").select("t", F.explode("tokens").alias("token"))
        return exploded.join(F.broadcast(asked), "token").groupBy("q", "t").agg(*counts)
    exploded = texts.select("t", F.explode("tokens").alias("token"))
    exploded = exploded.join(asked.select("token").distinct(), "token", "left_semi")
    hot = exploded.groupBy("token").agg(F.count("*").alias("texts")).filter(F.col("texts") > HOT_TEXTS)
    hot = stored(hot.select("token", F.ceil(F.col("texts") / HOT_TEXTS).cast("int").alias("parts")), "hot_tokens")
    part = F.pmod(F.xxhash64("t"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = exploded.join(hot, "token", "left").withColumn("part", part).drop("parts")
    repeated = asked.join(hot, "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = dealt.join(repeated.drop("parts"), ["token", "part"])
    return met.groupBy("q", "t").agg(*counts)
