"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions alone.

A logged conversation often stands in the log several times, each time a few turns longer. The hash of a conversation's
first n turns rolls: it is the exclusive or of two 64-bit hashes of (place, role, text) of each turn, so a running window
gives it for every n. A conversation whose whole hash is the hash of a proper prefix of another one is a snapshot of it; an
anti-join on (turns, hash) removes those. Of equal conversations that with the smallest id stays. What remains is rendered.

Prefixes are made distinct before the join, with partial aggregation, so a first turn that a third of all conversations
share is one row of it.

Defined cases: a null role or text differs from an empty one and is rendered as empty; rows with a null conv_id belong to
no conversation; a null turn stands before the others; repeated rows of a turn are turns, in the order of role and text;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with its place and the two hashes of all turns up to it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("n", F.row_number().over(order))
    parts = ["n", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.length("role"), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    roll = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.bit_xor(F.xxhash64(F.lit(1), *parts)).over(roll), "b": F.bit_xor(F.xxhash64(F.lit(2), *parts)).over(roll)})
    return rows


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n of the conversations to keep."""
    rows = prefixes(turns).select("conv_id", "n", "a", "b")
    last = rows.groupBy("conv_id").agg(F.max("n").alias("n"), F.max_by("a", "n").alias("a"), F.max_by("b", "n").alias("b"))
    whole = last.groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    follow = F.lead("n").over(Window.partitionBy("conv_id").orderBy("n"))
    proper = rows.withColumn("next", follow).where("next is not null").select("n", "a", "b").distinct()
    return whole.join(proper, ["n", "a", "b"], "left_anti").select("conv_id", "n")


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns and the rendered text of each maximal conversation."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = rows.join(maximal(turns).select("conv_id"), "conv_id", "left_semi")
    # nulls first, as in the order of the hashes
    lists = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit(start), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(end + "\n"))
    return lists.select("conv_id", F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", line), "").alias("text"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return render(table(spark, sf_dir, "conversations"))


SQL = """
WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l)
SELECT conv_id, len(l)::INT AS n_turns,
       array_to_string(list_transform(l, lambda x: '<|im_start|>' || coalesce(x.r, '') || chr(10) || coalesce(x.t, '') || '<|im_end|>' || chr(10)), '') AS text
FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE len(v.l) > len(u.l) AND v.l[1:len(u.l)] = u.l)
"""
