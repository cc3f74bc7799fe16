"""Merging of categories with one or two entries into the nearest broader one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut

SMALL = 2


def _words(text):
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{T.SPACE}]+", -1), lambda w: w != ""))


def merged(entries: DataFrame, small: int = SMALL) -> DataFrame:
    """period_key, category, merged: what each category of a month becomes. Columns: period_key, category, title.

    Categories rank by their entries, the most first, then by name. In a round every category of at most ``small`` entries
    takes, among the words of its titles that other categories of the month have too, the rarest one that some category
    ranking above it has; rare means in few categories, and of two the lesser word counts. It moves into the highest category
    with that word. One without any shared word moves into the month's highest. A category that is the highest for
    all its shared words waits for others to move into it. All move at once, also into categories that move themselves.
    Rounds end when no month has a category that moves: then none is small, or a month has one category alone.
    Nulls: a null category or month is left out, a null title has no words.

    Words meet their category's rank through one row a word, so no two categories are paired, and texts are read once.
    """
    # written before it is exploded: a filter on the exploded words would be pushed below what makes the titles, and repeat it
    rows = cut(entries.where("period_key is not null and category is not null").select("period_key", "category", _words(F.col("title")).alias("words")))
    sizes = cut(rows.groupBy("period_key", "category").agg(F.count("*").alias("n")))
    words = cut(rows.select("period_key", "category", F.explode("words").alias("word")).distinct())
    became = sizes.select("period_key", "category", F.col("category").alias("merged"))
    while True:
        place = F.struct((-F.col("n")).alias("less"), "category")
        held = words.join(sizes, ["period_key", "category"]).withColumn("place", place)
        shared = held.groupBy("period_key", "word").agg(F.count("*").alias("df"), F.min("place").alias("best")).where("df > 1")
        mine = held.where(F.col("n") <= small).join(shared, ["period_key", "word"])
        near = mine.groupBy("period_key", "category").agg(F.min(F.when(F.col("place") > F.col("best"), F.struct("df", "word", "best"))).alias("near"))
        top = sizes.groupBy("period_key").agg(F.min(place).alias("top"))
        asked = sizes.where(F.col("n") <= small).join(near.withColumn("shares", F.lit(True)), ["period_key", "category"], "left").join(top, "period_key")
        to = F.when(F.col("shares").isNotNull(), F.col("near.best.category")).otherwise(F.col("top.category"))
        moves = cut(asked.select("period_key", "category", to.alias("to")).where("to != category"))
        if moves.isEmpty():
            return became.select("period_key", "category", "merged")
        while True:  # moves go up in rank, so chains of them end
            onward = moves.select("period_key", F.col("category").alias("to"), F.col("to").alias("last"))
            met = moves.join(onward, ["period_key", "to"], "left")
            if met.where("last is not null").isEmpty():
                break
            moves = cut(met.select("period_key", "category", F.coalesce("last", "to").alias("to")))
        renamed = lambda df, c: df.join(moves.withColumnRenamed("category", c), ["period_key", c], "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        became = cut(renamed(became, "merged"))
        sizes = cut(renamed(sizes, "category").groupBy("period_key", "category").agg(F.sum("n").alias("n")))
        words = cut(renamed(words, "category").select("period_key", "category", "word").distinct())
