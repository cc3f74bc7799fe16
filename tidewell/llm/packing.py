"""Sequence packing: shortest-pack-first over the length histogram.

A document's ids are cut into whole sequences and one remainder, so a piece never exceeds a sequence. The lengths'
histogram, which has at most as many rows as a sequence has ids, goes to the driver. There lengths are placed longest
first, each on the pack patterns with the most room, a pattern's count being split when a length has fewer pieces than
the pattern has packs. The n-th piece of a length then takes the n-th place that the patterns hold for that length, so
patterns and documents meet by rank alone.

Ranks are counted in shards of a few thousand pieces (the number of shards follows the length's own count), so a length
that holds a third of all pieces is not ranked in one task.

Defined cases: a null or empty text has only the end id; an empty table gives no rows; repeated rows are packed each by
itself; a null doc_id is kept; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, ready, tidy
from .tokens import encoder

#: Pieces that one task ranks together.
SHARD_ROWS = 2048


def pieces(docs: DataFrame, length: int = 2048, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    last = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(vocabulary).encode_all
        for batch in batches:
            rows: list[tuple] = []
            for key, found in zip(batch.column(0).to_pylist(), encode_all(batch.column(1)), strict=True):
                ids = found + last
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((key, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4) + ((part,) if with_ids else ()))
            if rows:
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:5])]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    ready(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(tidy(run), schema)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns, each with its lengths longest first and its number of packs.

    Every length is placed on the patterns with the most room first; one that fits nowhere opens a new pattern.
    """
    room: dict[int, list[list]] = defaultdict(list)  # by room left: [lengths, count]
    for size in sorted(counts, reverse=True):
        if not 0 < size <= capacity:
            raise ValueError(f"a piece of {size} ids does not fit a sequence of {capacity}")
        left = counts[size]
        while left:
            most = max((r for r in room if room[r]), default=-1)
            if most < size:
                room[capacity - size].append([(size,), left])
                break
            lengths, count = room[most].pop()
            took = min(count, left)
            if took < count:
                room[most].append([lengths, count - took])
            room[most - size].append([(*lengths, size), took])
            left -= took
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for each in room.values():
        for lengths, count in each:
            merged[lengths] += count
    return sorted(merged.items(), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The places that patterns hold, by length and first rank: how rank becomes a sequence and an offset.

    Their number is bounded by the lengths that the patterns list, not by the pieces.
    """
    rows, used, first = [], defaultdict(int), 0
    for lengths, count in patterns:
        at = 0
        for size in lengths:
            rows.append((size, used[size], first, at))
            used[size] += count
            at += size
        first += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def ranked(table: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Add ``rank``: 0, 1, ... among the pieces of a length, counted shard by shard."""
    shards = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // SHARD_ROWS))) for n in range(max(counts, default=0) + 1)])
    dealt = table.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.element_at(shards, (F.col("length") + 1).cast("int"))))
    sizes = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "start"))
    return dealt.withColumn("inside", inside).join(sizes, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("before", "inside", "shard")


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack documents into sequences: the columns of :func:`pieces` with ``sequence_id`` and the gapless ``offset``."""
    spark = docs.sparkSession
    table = cut(pieces(docs, length, end_id, vocabulary, with_ids, id_column, text_column), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    held = spark.sparkContext.broadcast(places(pack_histogram(counts, length)))
    big = 1 << 48

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        keys = p["length"] * big + p["rank"]
        for batch in batches:
            size, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(keys, size * big + rank, side="right") - 1
            out = batch.drop_columns(["rank"])
            yield out.append_column("sequence_id", pa.array(p["sequence"][at] + rank - p["rank"][at])).append_column("offset", pa.array(p["offset"][at]))

    full = ranked(table, counts).select(*table.columns, "rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return full.mapInArrow(tidy(run), f"{kinds}, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return pack(table(spark, sf_dir, "documents"))
