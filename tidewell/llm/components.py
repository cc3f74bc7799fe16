"""Connected components as tables: neither links nor labels go to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, spent


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): label is the smallest node of its component.

    Large-star and small-star in turn: every node hangs its larger neighbours on the smallest node it knows, then itself
    and its smaller neighbours too, until every component is a star. Rounds grow with the logarithm of a component's size,
    whatever its diameter; each is written to the shared folder. Minima are combined before the shuffle, and a node of many
    links meets them in joins, which Spark splits.
    """
    now = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        n, mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).collect()[0]
        if not n or (n, mark) == before:
            break
        before = n, mark
        both = now.toDF("u", "v").union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        old, now = now, cut(small.distinct(), "links")
        spent(old, large)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
