"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of ``BITS`` bits is cut into segments, and an index row leads from a segment's value to each distinct code that
holds it. Round r looks up, for every query code still open, all values at distance r from its segments (the first round
those at distance 0 too, which saves a round that closes next to no query); so after round r every code within
``segments * (r + 1) - 1`` of the query has been met. A query closes when its last place's verified distance is within that
radius. A code met is kept only if it is no farther than the last place so far, tested in the join itself. The number of
segments follows the number of codes, so a lookup meets a few codes at any table size.

Rounds rank codes, each once however many rows hold it, by distance and then by the smallest id that holds it. A query
keeps ``(k + 1) * spread`` codes, ``spread`` being the most codes that any one id has (1 unless ids repeat): these hold k
ids besides the query's own, all of them before any id of a code left out. Only then do codes give way to their ids, of
which the k + 1 smallest of a code can matter. So a vector that a third of all rows share is one code, and no neighbour
is lost. Queries with equal codes are searched once.

Lookups and index meet by shuffle, never by broadcast, as both grow with the table.

Defined cases: a null vector has no code and takes no part; a null or missing coordinate counts as not positive, and a
vector of more coordinates than bits is an error; an id is one neighbour, at the smallest distance between any of its codes
and any of the query's; a query is never its own neighbour, repeated ids of it included; ties go to the smaller id; fewer
than k ids give fewer neighbours; null ids are ignored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, spent

BITS = 64
#: Queries of one code that are matched with its neighbours in one task.
SHARERS = 256


def sign_code(vector: str, bits: int = BITS) -> Column:
    """A bit for each coordinate: 1 if it is positive."""
    bit = lambda i: F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    code = reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(bits)])
    return F.when(F.size(vector) > bits, F.raise_error(F.lit(f"a vector has more than {bits} coordinates")).cast("long")).when(F.col(vector).isNotNull(), code)


def segments_for(codes: int, bits: int = BITS) -> int:
    """Segments of which a value is held by some eight codes if codes are evenly spread; at least four bits wide."""
    return max(1, int(bits // max(4.0, math.log2(max(2, codes)) - 3)))


def widths(bits: int, segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    out, at = [], 0
    for i in range(segments):
        w = bits // segments + (i < bits % segments)
        out.append((at, w))
        at += w
    return out


def _value(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _masks(width: int, radii: tuple[int, ...]) -> list[int]:
    """What to flip in a segment to get the values at these distances."""
    return [sum(1 << x for x in c) for r in radii for c in combinations(range(width), r)]


def _probes(open_: DataFrame, parts: list[tuple[int, int]], radii: tuple[int, ...]) -> DataFrame:
    """(q, bound, seg, value) of all values at these distances from the segments of the open query codes."""
    out = None
    for i, (s, w) in enumerate(parts):
        if masks := _masks(w, radii):
            one = open_.select("q", "bound", F.lit(i).alias("seg"), F.explode(F.expr(f"array({', '.join(f'{m}L' for m in masks)})")).alias("mask"))
            one = one.select("q", "bound", "seg", _value(F.col("q"), s, w).bitwiseXOR(F.col("mask")).alias("value"))
            out = one if out is None else out.union(one)
    return out


def _nearest_codes(codes: DataFrame, asked: DataFrame, places: int, bits: int, segments: int) -> DataFrame:
    """(q, code, distance): the ``places`` codes nearest to each of the query codes ``asked`` (q), by distance and first id. Where
    ``codes`` has a ``held``, only the nearest code of each counts."""
    kept = [c for c in ("held",) if c in codes.columns]
    parts = widths(bits, segments)
    values = F.array(*[F.struct(F.lit(i).alias("seg"), _value(F.col("code"), s, w).alias("value")) for i, (s, w) in enumerate(parts)])
    index = cut(codes.select("code", "first", *kept, F.explode(values).alias("x")).select("x.seg", "x.value", "code", "first", *kept), "index")
    open_, best = asked.withColumn("bound", F.lit(bits)), None
    order = F.row_number().over(Window.partitionBy("q").orderBy("distance", "first", "code"))
    for r in range(1, max(w for _, w in parts) + 1):
        probes = _probes(open_, parts, (0, 1) if r == 1 else (r,))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")
        near = probes.hint("merge").join(index.hint("merge"), ["seg", "value"]).where(distance <= F.col("bound"))
        near = near.select("q", "code", "first", *kept, distance.alias("distance"))
        every = (near if best is None else near.union(best)).distinct()
        if kept:
            nearest = F.row_number().over(Window.partitionBy("q", "held").orderBy("distance", "first", "code"))
            every = every.withColumn("rank", nearest).where("rank = 1").drop("rank")
        old, best = best, cut(every.withColumn("rank", order).where(F.col("rank") <= places).drop("rank"), "best")
        state = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        state = asked.join(state, "q", "left").select("q", F.when(F.col("n") >= places, F.col("last")).otherwise(bits).alias("bound"))
        was, open_ = open_, cut(state.where(f"bound > {segments * (r + 1) - 1}"), "open")
        spent(old, was)
        if open_.isEmpty():
            break
    spent(index, open_)
    return best


def _held_alike(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(code, first, held), ``held`` being one of the codes that have the same k + 1 smallest ids, and how many codes must be
    found so that no id among the k + 1 nearest is missed.

    Of codes with the same smallest ids the nearest tells all, so an id with many codes of its own takes one place, not one for
    each code. A first id may still stand for several such groups; k + 1 times the most of them have k + 1 first ids.
    """
    smallest = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    ids = cut(rows.withColumn("at", smallest).where(F.col("at") <= k + 1).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ids")
    groups = ids.groupBy("ids").agg(F.min("code").alias("held"))
    most = groups.groupBy(F.col("ids")[0]).count().agg(F.max("count")).collect()[0][0]
    codes = cut(ids.join(groups, "ids").select("code", F.col("ids")[0].alias("first"), "held"), "codes")
    spent(ids)
    return codes, (k + 1) * most


def search(rows: DataFrame, queries: DataFrame, k: int, bits: int = BITS, segments: int | None = None) -> DataFrame:
    """The k nearest rows of each query, both given as (id, code): query_id, rank, id, distance."""
    rows = cut(rows.where("id is not null and code is not null").select("id", "code").distinct(), "rows")
    codes = cut(rows.groupBy("code").agg(F.min("id").alias("first")), "codes")
    n = codes.count()
    spread = rows.groupBy("id").count().agg(F.max("count")).collect()[0][0] or 1
    places = k + 1
    if spread > 1:
        codes, places = _held_alike(rows, k)
    asked = cut(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct(), "queries")
    sharers = cut(asked.groupBy("q").agg(F.ceil(F.count("*") / SHARERS).cast("int").alias("places")), "sharers")
    best = _nearest_codes(codes, sharers.select("q"), places, bits, segments or segments_for(n, bits))

    # the ids that can matter: of each code the k + 1 smallest, then of each query code the k + 1 nearest
    wanted = best.select("code").distinct()
    smallest = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    held = rows.join(wanted, "code", "left_semi").withColumn("at", smallest).where(F.col("at") <= k + 1).groupBy("code").agg(F.collect_list("id").alias("ids"))
    each = best.join(held, "code").select("q", "distance", F.explode("ids").alias("id")).groupBy("q", "id").agg(F.min("distance").alias("distance"))
    nearest = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    near = cut(each.withColumn("at", nearest).where(F.col("at") <= k + 1).drop("at"), "near")

    # many queries may share a code: its neighbours go to as many places as they need
    spread_out = near.join(sharers, "q").select("q", "id", "distance", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    dealt = asked.join(sharers, "q").select("query_id", "q", F.pmod(F.xxhash64("query_id"), "places").cast("int").alias("place"))
    found = dealt.join(spread_out, ["q", "place"]).where("id != query_id")
    found = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance")) if spread > 1 else found.select("query_id", "id", "distance")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op1_hamming_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    from .shared import table

    rows = cut(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code")), "codes_of_rows")
    out = search(rows, rows.where("id % 20 = 0"), k)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, r.vec_id,
             list_sum(list_transform(range(1, 65), lambda i: (q.b[i] <> r.b[i])::INT))::INT AS distance
      FROM c q JOIN c r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank, vec_id, distance
FROM d QUALIFY rank <= 10
"""
