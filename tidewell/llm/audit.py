"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

A document's failures are five bits. Once documents are counted by bits, an order costs nothing more: at each step the
counts of the bits that no earlier filter had are added up. So texts are looked at once, whatever the number of orders.

Four bits come from the text alone. The fifth, an exact copy of a document with a smaller id, comes from refining a
partition of the table: documents are split by their number of code points, then by the hash of one block of text after
another, each block sixteen times as long as the one before and the last taking the rest; after each split, classes that
hold a single id are dropped. This goes on over a narrow table of hashes, without texts. Texts of the classes that are
left are then compared whole with that of the class's smallest id, and those that differ in spite of all hashes are
compared again among themselves until none is left. Every document that equals another and has not the smallest id gets
the bit. A class may hold a third of all documents: its size is counted by partial sums, and its texts meet one row, which
Spark's skewed join hands to every part of the class. A bitmap of the classes left (of bounded size) keeps the texts of
other documents from being shuffled; it lets some through but stops none that counts.

Defined cases: a null text is empty and a null language is the empty string; a row with a null id is counted, equals
nothing and has no label; of repeated rows with one id none is a copy of the other, and each is counted; of several labels
of an id the highest counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, ready, spent

FILTERS = "ABCDE"
COPY = 1 << 4
#: Code points of the hashed blocks; one more takes the rest of a text.
BLOCKS = (256, 4096, 65536)
#: The largest bitmap has so many bits.
MOST_BITS = 1 << 27
KEYS = ["chars", *(f"block_{i}" for i in range(len(BLOCKS) + 1))]


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, repeated words, capitals, marks."""
    spaced = F.translate(text, "\t\n\x0b\f\r", "     ")
    words = F.array_remove(F.split(spaced, " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return reduce(Column.bitwiseOR, [F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)])


def hashed(rows: DataFrame) -> DataFrame:
    """Add the number of code points and the hash of each block; a block behind the text's end has none."""
    at, columns = 1, {"chars": F.length("text")}
    for name, size in zip(KEYS[1:], (*BLOCKS, None), strict=True):
        part = F.substring("text", at, size) if size else F.expr(f"substring(text, {at})")
        columns[name] = F.when(F.length("text") >= at, F.xxhash64(part)).otherwise(0)
        at += size or 0
    return rows.withColumns(columns)


def refined(narrow: DataFrame) -> DataFrame:
    """Classes of at least two ids that agree in all keys, with their smallest id. Of narrow's rows, those whose class has
    one id leave at each split."""
    left, keys = narrow.where("doc_id is not null").select("doc_id", *KEYS), []
    classes = held = None
    for key in KEYS:
        keys.append(key)
        classes = left.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        if key != KEYS[-1]:
            before, held = held, cut(left.join(classes.select(*keys), keys, "left_semi"), f"by_{key}")
            spent(before)
            left = held
    found = cut(classes.select(*KEYS, "first"), "classes")
    spent(held)
    return found


def maybe(classes: DataFrame):
    """A condition that holds wherever KEYS are those of a class, and for few other rows."""
    spark = classes.sparkSession
    bits = min(MOST_BITS, max(64, 1 << (16 * classes.count()).bit_length()))
    bit = F.pmod(F.xxhash64(*KEYS), F.lit(bits))
    words = classes.select(bit.alias("bit")).groupBy(F.expr("int(bit div 32)").alias("word"))
    words = words.agg(F.expr("bit_or(shiftleft(1, int(bit % 32))) AS x")).toPandas()  # at most MOST_BITS / 32 rows
    bitmap = np.zeros(bits // 32, np.int32)
    bitmap[words["word"].to_numpy()] = words["x"].to_numpy()
    sent = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def known(at: pd.Series) -> pd.Series:
        b = at.to_numpy()
        return pd.Series((sent.value[b // 32] >> (b % 32).astype(np.int32)) & 1 == 1)

    return known(bit)


def copies(docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """doc_id, part, text of the rows whose text is exactly that of a smaller id."""
    classes = refined(narrow)
    left = hashed(docs).where("doc_id is not null").where(maybe(classes))
    found = []
    while True:
        first = left.join(classes, KEYS).where("doc_id = first")
        first = first.groupBy(*KEYS, "first").agg(F.min("text").alias("whole"))
        met = left.join(first, KEYS)
        found.append(met.where("text = whole and doc_id > first").select("doc_id", "part", "text"))
        rest = cut(met.where("text != whole").select(*left.columns), "unequal")
        if rest.isEmpty():  # but for colliding hashes
            return reduce(DataFrame.union, found)
        left, classes = rest, rest.groupBy(*KEYS).agg(F.min("doc_id").alias("first"))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of the filters that fail) and how many documents have it, in all, of good quality, and toxic."""
    ready(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    narrow = cut(hashed(rows.withColumn("mask", failures(F.col("text")))).drop("text"), "measured")
    again = cut(copies(rows, narrow).select("doc_id", "part", failures(F.col("text")).alias("mask")), "copies")
    moved = again.select("doc_id", "part", F.explode(F.array(F.struct("mask", F.lit(-1).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), F.lit(1).alias("n")))).alias("x"))
    weighed = narrow.select("doc_id", "part", "mask", F.lit(1).alias("n")).union(moved.select("doc_id", "part", "x.mask", "x.n"))
    flag = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    whole = weighed.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    marked = weighed.join(known, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum(F.coalesce(F.col("n") * F.col("quality"), F.lit(0))).alias("good"), F.sum(F.coalesce(F.col("n") * F.col("toxic"), F.lit(0))).alias("toxic"))
    return whole.union(marked).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def steps() -> Column:
    """Every step of every order: the order, the step, its filter's bit and the bits of the filters before it."""
    held = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, at in enumerate(order, 1):
            held.append(f"struct('{''.join(FILTERS[i] for i in order)}' AS filter_order, {step} AS step, {1 << at} AS bit, {before} AS before)")
            before |= 1 << at
    return F.expr(f"inline(array({', '.join(held)}))")


def interactions(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the counts of :func:`counted` (at most 32 a part)."""
    each = counts.select("*", steps())
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).alias
    # Of the orders, a filter is the first of k failing ones in one of k; 120 / k is whole.
    fair = F.col("n") * F.expr("120 div greatest(1, bit_count(mask))")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~earlier & ~fails)("kept"), total(fails & ~earlier)("removed"), total(fails & earlier)("redundant"), total(F.col("mask") == F.col("bit"))("unique_fails"),
        total(fails & ~earlier, "good")("good_lost"), total(fails & ~earlier, "toxic")("toxic_lost"), F.sum(F.when(fails, fair).otherwise(0)).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return interactions(counted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


SQL = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
   coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM d LEFT JOIN l USING (doc_id)),
o AS (SELECT a || b || c || d || e AS filter_order, [a, b, c, d, e] AS letters
  FROM unnest(['A', 'B', 'C', 'D', 'E']) AS t1(a), unnest(['A', 'B', 'C', 'D', 'E']) AS t2(b), unnest(['A', 'B', 'C', 'D', 'E']) AS t3(c), unnest(['A', 'B', 'C', 'D', 'E']) AS t4(d), unnest(['A', 'B', 'C', 'D', 'E']) AS t5(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step::INT AS step, letters[step] AS letter, ascii(letters[step]) - 64 AS which, list_transform(letters[1:step - 1], lambda x: ascii(x) - 64) AS earlier FROM o, range(1, 6) AS r(step)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, fails),
x AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[which] AS fail, coalesce(list_bool_or(list_transform(earlier, lambda i: fails[i])), false) AS gone, len(list_filter(fails, lambda f: f)) AS failing FROM g, s),
y AS (SELECT part, filter_order, step, any_value(letter) AS letter, sum(n) FILTER (WHERE NOT fail AND NOT gone) AS kept, sum(n) FILTER (WHERE fail AND NOT gone) AS removed, sum(n) FILTER (WHERE fail AND gone) AS redundant,
  sum(n) FILTER (WHERE fail AND failing = 1) AS unique_fails, sum(good) FILTER (WHERE fail AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE fail AND NOT gone) AS toxic_lost FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
 coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM y
"""
