"""Parts whose headers and footer count against the limit, with the number of parts in every header."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

GAP = "\n\n"
#: Code points kept free for a header and a footer where blocks are split to fit a part.
OVERHEAD = 500
#: Names of months (fixed values).
MONTHS = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")


def month_name(period: Column) -> Column:
    names = F.array(*map(F.lit, MONTHS))
    return F.concat_ws(" ", F.element_at(names, F.substring(period, 6, 2).cast("int")), F.substring(period, 1, 4))


def head(period: Column, part: Column, total: Column, brand: str) -> Column:
    """The first part's header has a line more words than the later ones'."""
    first = F.concat(F.lit(f"📚 <b>{brand}</b>\nГлавное за "), month_name(period), F.lit(" · Часть "))
    later = F.concat(F.lit(f"📚 <b>{brand}</b> · "), month_name(period), F.lit("\nЧасть "))
    return F.concat(F.when(part == 1, first).otherwise(later), part.cast("string"), F.lit(" из "), total.cast("string"), F.lit(GAP))


def footer(brand: str, link: str) -> str:
    return f'{GAP}Актуальность уточняйте у автора.{GAP}<b>Новые объявления каждый день → <a href="{link}">{brand}</a></b>'


def paged(rows: DataFrame, limit: int = T.LIMIT, brand: str = "обЪявления", link: str = "https://t.me/") -> DataFrame:
    """period_key, part_no, total, html of ordered blocks (period_key, ord, block), none longer than ``limit`` code points with its
    header and footer, unless a single block is. The footer is never parted from the last block.

    A header names the number of parts, and the longer that number the fewer blocks fit, so it is sought as a fixpoint. The
    number of parts does not fall as its digits grow, so the least number of digits that the parts found with it do not exceed
    is the least fixpoint. Candidates, 1 up to the digits of the number of blocks, are tried in turn, each in one pass over a
    month's lengths of blocks; texts meet the parts' first blocks afterwards.
    """
    foot = footer(brand, link)
    order = Window.partitionBy("period_key").orderBy("ord")
    placed = rows.withColumns({"n": F.row_number().over(order), "last": F.lead("ord").over(order).isNull()})
    size = F.length("block") + F.when(F.col("last"), len(foot)).otherwise(0)
    # a header's length, but for the digits of both numbers
    bare = lambda part: F.length(head(F.col("period_key"), F.lit(part), F.lit(""), brand)) - 1
    sized = placed.select("period_key", "n", size.alias("size"), (limit - bare(1)).alias("first_room"), (limit - bare(2)).alias("room"))

    def begun(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        sizes, rooms = group.column("size").to_pylist(), [group.column(c)[0].as_py() for c in ("first_room", "room")]
        for digits in range(1, len(str(len(sizes))) + 1):
            starts, left = [], -1
            for n, x in enumerate(sizes):
                left -= len(GAP) + x
                if left < 0:
                    starts.append(n)
                    left = rooms[len(starts) > 1] - digits - len(str(len(starts))) - x
            if len(str(len(starts))) <= digits:
                break
        rows = group.take(starts).select(["period_key", "n"])
        parts = pa.array(range(1, len(starts) + 1), pa.int32())
        return rows.append_column("begun", parts).append_column("total", pa.array([len(starts)] * len(starts), pa.int32()))

    starts = sized.groupBy("period_key").applyInArrow(begun, "period_key string, n int, begun int, total int")
    met = placed.select("period_key", "ord", "n", "block").join(starts, ["period_key", "n"], "left")
    so_far = Window.partitionBy("period_key").orderBy("n")
    met = met.withColumns({"part_no": F.max("begun").over(so_far), "total": F.max("total").over(so_far)})
    parts = met.groupBy("period_key", "part_no", "total").agg(F.sort_array(F.collect_list(F.struct("n", "block"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["block"]), GAP)
    whole = F.concat(head(F.col("period_key"), F.col("part_no"), F.col("total"), brand), body, F.when(F.col("part_no") == F.col("total"), foot).otherwise(""))
    return parts.select("period_key", "part_no", "total", whole.alias("html"))
