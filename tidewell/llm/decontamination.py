"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions alone.

A benchmark item is found in a document that holds at least ``PERCENT`` hundredths of the item's distinct shingles of five
words. Items are partitioned by size, into classes of doubling numbers of shingles. An item's sketch is its smallest
shingle hashes, as many as a class's largest item may miss and one more; so whatever order hashes give, a document that
holds enough of the item holds one of its sketch, and the search misses nothing. Documents' shingle hashes meet the
sketches in a join; the pairs that come of it are verified by the exact shingles.

Sketches, and later the pairs and the items, go to every task only if their number, of items that of all their shingles,
is at most ``MAX_SENT``; beyond that both sides are
shuffled. The shuffled side then is what explodes, and AQE splits a passage that many documents share.

Words are lower-cased runs of letters and digits. Defined cases: an item of fewer than five words has its whole sequence
as its one shingle, and documents are searched for that many words in a row; a null, empty or wordless item or document
takes no part; a null doc_id is kept, a null item_id takes no part; rows repeating a doc_id or item_id count as one if equal, else each gives its row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

WORDS, PERCENT = 5, 75
#: Rows of sketches or pairs, and shingles of all items, that may be sent to every task.
MAX_SENT = 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text.cast("string")), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _runs(w: Column, size: int, make) -> Column:
    """``make`` of each run of ``size`` words; no rows where there are fewer words."""
    at = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size))
    return F.coalesce(F.transform(at, lambda i: make([F.get(w, i + k) for k in range(size)])), F.array())


def _hashes(w: Column, size: int) -> Column:
    return _runs(w, size, lambda parts: F.xxhash64(*parts))


def _marked(w: Column, size: int) -> Column:
    return F.transform(_hashes(w, size), lambda h: F.struct(F.lit(size).alias("k"), h.alias("h")))


def _texts(w: Column, size: int) -> Column:
    return _runs(w, size, lambda parts: F.concat_ws(" ", *parts))


def _chosen(column: str, sizes: list[int], make) -> Column:
    """By the item's own shingle size, which column ``k`` holds."""
    out = F.lit(None)
    for k in sizes:
        out = F.when(F.col("k") == k, make(F.col(column), k)).otherwise(out)
    return out


def sketches(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, list[int]]:
    """Items (item_id, k, n, shingles), their sketches (item_id, h), and the shingle sizes in use (1 to 5)."""
    rows = items.select(F.col(id_column).alias("item_id"), words(F.col(text_column)).alias("w")).where(F.size("w") > 0).distinct()
    rows = cut(rows.withColumn("k", F.least(F.size("w"), F.lit(WORDS))), "items")
    sizes = sorted(r["k"] for r in rows.select("k").distinct().collect())  # five values at most
    if not sizes:
        none = rows.select("item_id", "k", F.lit(0).alias("n"), F.array().cast("array<string>").alias("shingles"))
        return none, rows.select("item_id", "k", F.lit(0).cast("long").alias("h")), sizes
    found = rows.select("item_id", "k", F.array_distinct(_chosen("w", sizes, _texts)).alias("shingles"), F.array_sort(F.array_distinct(_chosen("w", sizes, _hashes))).alias("hashes"))
    found = found.withColumn("n", F.size("shingles"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1).cast("long") - 1  # of the item's size class
    may_miss = largest - F.ceil(largest * PERCENT / 100) + 1
    sketch = found.select("item_id", "k", F.explode(F.slice("hashes", F.lit(1), may_miss.cast("int"))).alias("h"))
    return found.drop("hashes"), sketch, sizes


def contained(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment of every item found in a document."""
    found, sketch, sizes = sketches(items, item_id, item_text)
    found, sketch = cut(found, "found"), cut(sketch, "sketches")
    small = lambda df, size="1": F.broadcast(df) if (df.agg(F.sum(F.expr(size))).collect()[0][0] or 0) <= MAX_SENT else df
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    split = base.select("doc_id", words(F.col("text")).alias("w"))
    if sizes == [WORDS]:
        exploded = split.select("doc_id", F.explode(_hashes(F.col("w"), WORDS)).alias("h"), F.lit(WORDS).alias("k"))
    elif sizes:
        exploded = split.select("doc_id", F.explode(F.concat(*[_marked(F.col("w"), k) for k in sizes])).alias("x")).select("doc_id", "x.h", "x.k")
    else:
        exploded = split.select("doc_id", F.lit(0).cast("long").alias("h"), F.lit(0).alias("k")).limit(0)
    pairs = cut(exploded.join(small(sketch), ["k", "h"]).select("doc_id", "item_id").distinct(), "pairs")
    named = small(pairs.withColumnRenamed("doc_id", "found_in"))
    known = split.join(named, F.col("doc_id").eqNullSafe(F.col("found_in"))).join(small(found, "n"), "item_id")
    matched = F.size(F.array_intersect("shingles", F.coalesce(_chosen("w", sizes, _texts).cast("array<string>"), F.array())))
    out = known.select("doc_id", "item_id", F.col("n").alias("n_shingles"), matched.alias("n_found"))
    return out.where(F.col("n_found") * 100 >= F.col("n_shingles") * PERCENT).withColumn("containment", F.col("n_found") / F.col("n_shingles")).distinct()


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)
SELECT doc_id, item_id, any_value(n)::INT AS n_shingles, count(*)::INT AS n_found, count(*) / any_value(n)::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n)
"""
