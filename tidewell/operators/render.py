"""Rendering: entries of a period to digest parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut


def lines(entries: DataFrame, messages: DataFrame) -> DataFrame:
    """A row for each shown entry, ranked by generated category and title, nulls first."""
    shown = entries.where("eligible = 1 and excluded_reason is null").join(messages.select(F.col("id").alias("message_pk"), "source_url"), "message_pk")
    rank = F.row_number().over(Window.partitionBy("period_key").orderBy(F.asc_nulls_first("category_title"), F.asc_nulls_first("short_title"), "message_pk"))
    title = T.first_filled(F.col("manual_title"), F.col("short_title"), F.lit(T.NO_TITLE))
    return shown.select("period_key", rank.alias("rank"), T.first_filled(F.col("category_emoji"), F.lit(T.NO_EMOJI)).alias("emoji"), T.first_filled(F.col("manual_category"), F.col("category_title"), F.lit(T.NO_CATEGORY)).alias("category"), T.line(title, F.col("source_url")).alias("line"))


def blocks(rows: DataFrame) -> DataFrame:
    """Lines grouped by emoji and category, in the order in which groups are first seen."""
    grouped = rows.groupBy("period_key", "emoji", "category").agg(F.min("rank").alias("ord"), F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return grouped.select("period_key", "ord", T.block(F.col("emoji"), F.col("category"), F.transform("x", lambda x: x["line"])).alias("block"))


#: Blocks of a period up to which an array of them is folded in one row.
FOLD_BLOCKS = 5000


def folded(rows: DataFrame, limit: int) -> DataFrame:
    """period_key, part_no, total, body: a period's blocks packed by a fold over their array."""
    listed = rows.groupBy("period_key").agg(F.sort_array(F.collect_list(F.struct("ord", "block"))).alias("x"))
    bodies = listed.select("period_key", T.packed(F.transform("x", lambda x: x["block"]), limit).alias("bodies"))
    each = bodies.select("period_key", F.size("bodies").alias("total"), F.posexplode("bodies").alias("pos", "body"))
    return each.select("period_key", (F.col("pos") + 1).alias("part_no"), "total", "body")


def doubled(rows: DataFrame, limit: int, gap: str = "\n\n") -> DataFrame:
    """The same without an array of a period. Blocks are not empty.

    Sizes are summed up to each block; the part that would begin with it ends before the first block whose sum is too far
    on. So each block knows where the next part would begin. Which blocks do begin parts is found from the first by pointer
    doubling: jumps of one part are joined to jumps of two, of four, and so on, and the beginnings found so far take each
    of them once. Texts come in at the end, a part at a time.
    """
    period = Window.partitionBy("period_key")
    order = period.orderBy("ord")
    step = F.length("block").cast("long") + len(gap)
    placed = rows.select("period_key", "ord", (F.row_number().over(order) - 1).cast("long").alias("n"), F.coalesce(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"), F.sum(step).over(period).alias("all"), F.count("*").over(period).alias("blocks"))
    far = F.max("n").over(period.orderBy("at").rangeBetween(0, limit + len(gap)))
    placed = cut(placed.withColumn("next", F.when(F.col("all") <= F.col("at") + limit + len(gap), F.col("blocks")).otherwise(F.greatest(far, F.col("n") + 1))))
    jump = placed.where("next < blocks").select("period_key", "n", "next")
    begin = placed.where("n = 0").select("period_key", "n")
    while True:
        more = begin.join(jump, ["period_key", "n"]).select("period_key", F.col("next").alias("n"))
        if more.isEmpty():
            break
        begin = cut(begin.union(more))
        onward = jump.select("period_key", F.col("n").alias("next"), F.col("next").alias("last"))
        jump = cut(jump.join(onward, ["period_key", "next"]).select("period_key", "n", F.col("last").alias("next")))
    marked = placed.join(begin.withColumn("first", F.lit(1)), ["period_key", "n"], "left")
    numbered = marked.select("period_key", "ord", F.sum(F.coalesce("first", F.lit(0))).over(order).cast("int").alias("part_no"))
    totals = begin.groupBy("period_key").agg(F.count("*").cast("int").alias("total"))
    texts = numbered.join(rows, ["period_key", "ord"]).groupBy("period_key", "part_no").agg(F.sort_array(F.collect_list(F.struct("ord", "block"))).alias("x"))
    return texts.join(totals, "period_key").select("period_key", "part_no", "total", F.array_join(F.transform("x", lambda x: x["block"]), gap).alias("body"))


def parts(rows: DataFrame, limit: int = T.LIMIT, brand: str = "обЪявления", most: int | None = None) -> DataFrame:
    """period_key, part_no, total, html. Where a period has many blocks no row holds all of them. ``most``: how many blocks a
    period has at most, if that is known; else they are counted where it may be too many."""
    if most is None or most > FOLD_BLOCKS:
        most = rows.groupBy("period_key").count().agg(F.max("count")).collect()[0][0] or 0
    each = folded(rows, limit) if most <= FOLD_BLOCKS else doubled(rows, limit)
    return each.select("period_key", "part_no", "total", T.envelope(F.col("body"), F.col("period_key"), F.col("part_no"), F.col("total"), brand).alias("html"))


def digest(entries: DataFrame, messages: DataFrame, limit: int = T.LIMIT, brand: str = "обЪявления", most: int | None = None) -> DataFrame:
    return parts(blocks(lines(entries, messages)), limit, brand, most)
