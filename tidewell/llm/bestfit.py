"""Best-fit packing, planned over the histogram of lengths.

Only documents of more ids than a sequence holds are cut, into whole sequences and a rest. The pieces' histogram, which has
at most as many rows as a sequence has ids, goes to the driver. There lengths are placed longest first, each where the room
left is smallest and still enough: what best fit does with one piece after another, done for all pieces of a length and all
sequences of one room at once. Counts in the thousands of millions are planned as fast as counts of one.

A piece then takes the planned slot of its rank among the pieces of its length. Ranks need no global order: each written
file of pieces is numbered by itself, within a length, and comes after the files before it, so a length that holds a third
of all pieces is spread over all files. The plan is sent to the tasks; it has one row for each length of each pattern, and
patterns number at most four for each length, whatever the number of pieces.

Defined cases: a null or empty text has only the end id; an empty table gives no rows; repeated rows are packed each by
itself; a null doc_id is kept; which of two pieces of one length gets which slot follows the order in which they are
written; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import pieces
from .shared import cut, tidy

#: Sizes with how many of each a sequence holds, longest first, and the number of sequences.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Packing patterns of best fit decreasing over counts."""
    rooms: dict[int, list[list]] = defaultdict(list)  # by room left: [sizes, sequences]
    filled = 0  # bit r is set where rooms[r] has any

    def put(sizes: tuple, room: int, sequences: int) -> None:
        nonlocal filled
        if sequences:
            rooms[room].append([sizes, sequences])
            filled |= 1 << room

    for size in sorted(counts, reverse=True):
        if not 0 < size <= capacity:
            raise ValueError(f"a piece of {size} ids does not fit a sequence of {capacity}")
        left = counts[size]
        while left > 0:
            enough = filled >> size
            if enough:
                room = size + (enough & -enough).bit_length() - 1
                sizes, sequences = rooms[room].pop()
                if not rooms[room]:
                    filled ^= 1 << room
            else:
                room, sizes, sequences = capacity, (), left
            # What a sequence has left after one piece is a closer fit for the next, so it takes all that it holds.
            each = room // size
            whole = min(sequences, left // each)
            put((*sizes, (size, each)), room - each * size, whole)
            left -= whole * each
            sequences -= whole
            if sequences and left:
                put((*sizes, (size, left)), room - left * size, 1)
                left, sequences = 0, sequences - 1
            if sizes:
                put(sizes, room, sequences)
    merged: dict[tuple, int] = defaultdict(int)
    for found in rooms.values():
        for sizes, sequences in found:
            merged[sizes] += sequences
    return sorted(merged.items(), reverse=True)


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """The plan by length and first rank: where the next ranks go. Of ``sequences`` sequences from ``sequence`` on, ranks take
    the place at ``offset`` of each, then the one behind it."""
    rows, used, first = [], defaultdict(int), 0
    for sizes, sequences in patterns:
        at = 0
        for size, each in sizes:
            rows.append((size, used[size], first, sequences, at))
            used[size] += sequences * each
            at += size * each
        first += sequences
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "sequences", "offset"), table.T, strict=True))


def with_rank(written: DataFrame) -> DataFrame:
    """Add ``rank``: 0, 1, ... among the pieces of a length. ``written`` is read from files."""
    placed = written.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = written.groupBy("length", F.col("_metadata.file_name").alias("__file")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "__file", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__file", "length").orderBy("__row"))
    rank = (F.col("__before") + F.col("__inside") - 1).alias("rank")
    return placed.withColumn("__inside", inside).join(sizes, ["__file", "length"]).select(*written.columns, rank)


def pack(docs: DataFrame, length: int = 2048, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, gapless offset and, if asked
    for, the ids."""
    spark = docs.sparkSession
    written = cut(pieces(docs, length, end_id, vocabulary, with_ids, id_column, text_column), "pieces")
    counts = {r["length"]: r["n"] for r in written.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    plan = spark.sparkContext.broadcast(slots(best_fit(counts, length)))
    big = 1 << 48

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        keys = p["length"] * big + p["rank"]
        for batch in batches:
            size, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            at = np.searchsorted(keys, size * big + rank, side="right") - 1
            n = rank - p["rank"][at]
            out = batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(p["sequence"][at] + n % p["sequences"][at]))
            yield out.append_column("offset", pa.array(p["offset"][at] + n // p["sequences"][at] * size))

    found = with_rank(written)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in written.schema)
    out = found.mapInArrow(tidy(run), f"{kinds}, sequence_id long, offset long")
    rest = ["length", "ids_crc32", "sequence_id", "offset", "doc_tokens"] + ["ids"] * with_ids
    return out.select("doc_id", F.expr(f"cast(start div {length} as int)").alias("piece"), "start", *rest)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return pack(table(spark, sf_dir, "documents"))
