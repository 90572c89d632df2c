"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int, only: Column | None = None) -> DataFrame:
    """``(doc_id, text, label)`` of about ``limit`` documents that have a label in ``column``, chosen by a hash of the id.

    ``only`` restricts the ids.  A document with several labels takes the largest.  NULL ids, labels and texts
    are left out.  The chosen labels are at most about ``limit`` short rows, which bounds their broadcast.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").alias("labelled_id"), F.col(column).cast("int").alias("label"))
    if only is not None:
        known = known.filter(only)
    share = min(1.0, limit / max(known.count(), 1))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(11), "labelled_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = chosen.groupBy("labelled_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")
