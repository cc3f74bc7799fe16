"""Labelled rows: which may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_column: str = "doc_id", text_column: str = "text", unlabelled: int = 0) -> DataFrame:
    """At most ``rows`` labelled documents that are not held out and, if asked for, at most ``unlabelled`` others without a
    label (null), chosen by a hash of the id: doc_id, text, label. An id has one row: of repeated ids that with the least
    text, and label 1 if any of its labels is.

    The chosen ids, not more than both numbers, go to every task.
    """
    key, first = F.col(id_column), (F.xxhash64("doc_id"), "doc_id")
    known = labels.where(F.col(label).isin(0, 1) & key.isNotNull()).groupBy(key.alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    found = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    ids = known.where(~held_out(F.col("doc_id"))).orderBy(*first).limit(rows)
    if unlabelled:
        others = found.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(known, "doc_id", "left_anti").distinct()
        ids = ids.union(others.select("doc_id", F.lit(None).cast("int")).orderBy(*first).limit(unlabelled))
    return found.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
