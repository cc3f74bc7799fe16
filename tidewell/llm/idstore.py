"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream where the hash falls below a mark, so equal passages give equal
chunks wherever they stand. A chunk is stored once under its digest. A recipe lists a document's chunks; the root of a
hash tree over their digests and sizes stands in it. A block's root is that of a tree over its documents' ids, places,
numbers of ids and roots; a part's root is over its blocks, and the store's over its parts.

Layout under the store's path, all Parquet, written and committed by Spark:

``chunks``    digest binary, n long, ids binary (little-endian, ``width`` bytes an id), in no order
``recipes``   part, block, doc_id, start, n_tokens, digests, sizes, root: in ascending doc_id
``manifest``  part, block, documents, n_tokens, start, root: a block has at most ``BLOCK`` documents
``top``       part, start, blocks, root and, repeated, the width and the store's root

Which copy of a chunk is written is settled on digests alone: text and ids are not shuffled unless the copies to leave
out are too many to send to each task (:data:`MAX_SENT`); then documents and their lists meet in a join.

Reading back checks every chunk against its digest, every recipe against its root and its chunks' true sizes, every block
against the manifest, every part against ``top`` and that against the store's root; what does not match is an error. A
document's number of ids is that of its chunks' bytes, and its checksum follows from theirs (a checksum of joined parts
follows from the parts' checksums and lengths), so no ids move.

Defined cases: a null or empty text has only the end id; an empty table gives an empty store; rows with a null doc_id come
first; repeated rows have a recipe each; an id that does not fit the width is an error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, gathered, ready, remove, scratch, spent, tidy
from .tokens import TOGETHER, encoder

#: Chunk lengths in ids: fewest, expected beyond the fewest, most.
LEAST, USUAL, MOST = 64, 256, 2048
#: Documents of a block.
BLOCK = 4096
#: Chunk copies, at 16 bytes each, that may be sent to every task.
MAX_SENT = 1_000_000

_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 1 << 16, dtype=np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash of the last 16 ids is below the mark; other streams before them do not matter."""
    h = _GEAR[ids & 0xFFFF]
    for k in (1, 2, 4, 8):  # the hash of the last 16 ids, doubled from that of 8, 4, ...
        h[k:] += h[:-k] << np.uint32(k)
    return np.flatnonzero(h < np.uint32((1 << 32) // USUAL)) + 1


def between(places: list[int], last: int, n: int) -> list[int]:
    """Ends of the chunks of the stream from ``last`` to ``n``; the first mark that counts has more than 16 of its ids before it."""
    out = []
    for end in [*places, n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST and end < n:
            out.append(end)
            last = end
    if last < n:
        out.append(n)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream."""
    return between(marks(ids).tolist(), 0, len(ids))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def root(leaves: list[bytes]) -> bytes:
    """Root of the hash tree; an odd last node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def recipe_root(digests: list[bytes], sizes: list[int]) -> bytes:
    return root([d + n.to_bytes(8, "little") for d, n in zip(digests, sizes, strict=True)])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of bit-reversed polynomials modulo the checksum's."""
    out = np.zeros_like(a)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(k)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))
    return out


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part with this checksum adds to that of a whole in which so many bytes follow it."""
    out, power, left = crc.astype(np.uint64), np.array([1 << 23], dtype=np.uint64), after.astype(np.uint64)  # power: x^8
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = _times(out[odd], np.broadcast_to(power, odd.sum()).copy())
        power, left = _times(power, power.copy()), left >> np.uint64(1)
    return out


def _staged(docs: DataFrame, end_id: int, width: int, vocabulary: str | None, id_column: str, text_column: str) -> DataFrame:
    last = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(vocabulary).encode_all
        for batch in gathered(batches, TOGETHER):
            found = [x + last for x in encode_all(batch.column(2))]
            ids = np.frombuffer(b"".join(found), "<u4")
            if width < 4 and len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError(f"an id does not fit {width} bytes")
            data = ids.astype(f"<u{width}").tobytes()
            bounds = np.cumsum([0, *map(len, found)]) // 4
            at = marks(ids)
            first = np.searchsorted(at, bounds, side="right").tolist()
            at, ends, digests, sizes, roots, held = at.tolist(), bounds.tolist(), [], [], [], [0]
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                own, own_sizes = [], []
                for end in between(at[first[k] : first[k + 1]], a, b):
                    own.append(digest(data[a * width : end * width]))
                    own_sizes.append(end - a)
                    a = end
                roots.append(recipe_root(own, own_sizes))
                digests += own
                sizes += own_sizes
                held.append(len(sizes))
            offsets = pa.array(held, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((digests, pa.binary()), (sizes, pa.int32()))]
            texts = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.array(bounds * width, pa.int32()).buffers()[1], pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds)), *lists, pa.array(roots, pa.binary()), texts], names=["row", "doc_id", "n_tokens", "digests", "sizes", "root", "data"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column), F.col(text_column).cast("string"))
    return rows.mapInArrow(tidy(run), f"row long, doc_id {kind}, n_tokens long, digests array<binary>, sizes array<int>, root binary, data binary")


def _left_out(staged: DataFrame) -> DataFrame:
    """(row, at) of every chunk that another one stands for: all but the first of each digest."""
    each = staged.select("row", F.posexplode("digests").alias("at", "digest")).withColumn("place", F.struct("row", "at"))
    first = each.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    return each.join(first, "digest").where(F.col("place") != F.col("first")).select("row", "at")


def write(docs: DataFrame, path: str, end_id: int = 2, width: int = 2, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text", most_sent: int = MAX_SENT) -> None:
    """Write the store of a table of documents. ``width``: bytes an id takes in the files."""
    spark = docs.sparkSession
    ready(spark)
    stage = scratch(spark, "ids")
    _staged(docs, end_id, width, vocabulary, id_column, text_column).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.parquet(stage)

    out = cut(_left_out(staged), "copies")
    if out.count() <= most_sent:
        got = out.toPandas()
        order = np.lexsort((got["at"], got["row"]))
        sent = spark.sparkContext.broadcast((got["row"].to_numpy()[order], got["at"].to_numpy()[order]))
        source = staged.select("row", "digests", "sizes", "data", F.lit(None).cast("array<int>").alias("out"))
    else:
        sent = None
        source = staged.select("row", "digests", "sizes", "data").join(out.groupBy("row").agg(F.collect_list("at").alias("out")), "row", "left")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, digests, sizes, data, skip = batch.columns
            first, n, whole = digests.offsets.to_numpy() - digests.offsets[0].as_py(), sizes.flatten().to_numpy(), _buffer(data)
            if sent:
                rows, places = sent.value
                begin, end = (np.searchsorted(rows, row.to_numpy(), side=x) for x in ("left", "right"))
                many = end - begin
                at = places[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            else:
                many, at = pc.fill_null(pc.list_value_length(skip), 0).to_numpy(), skip.flatten().to_numpy()
            keep = np.ones(len(n), bool)
            keep[np.repeat(first[:-1], many) + at] = False
            ends = np.cumsum(np.concatenate([[0], n * width], dtype=np.int64))  # a batch's chunks stand one behind another
            parts = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.array(ends, pa.int32()).buffers()[1], whole])
            yield pa.RecordBatch.from_arrays([digests.flatten(), pa.array(n, pa.int64()), parts], names=["digest", "n", "ids"]).filter(pa.array(keep))

    source.mapInArrow(tidy(chunks), "digest binary, n long, ids binary").write.option("compression", "zstd").parquet(f"{path}/chunks")

    order = ["doc_id", "row"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    recipes = staged.select("row", "doc_id", "n_tokens", "digests", "sizes", "root").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = cut(recipes.withColumn("part", F.spark_partition_id()), "recipes")
    remove(spark, stage)
    heads = dealt.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a row for each partition
    begins, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in heads):
        begins[part], at = at, at + n
    begin = spark.createDataFrame(sorted(begins.items()), "part int, begin long")
    inside = Window.partitionBy("part").orderBy(*order)
    before = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumns({"before": before, "block": F.floor((F.row_number().over(inside) - 1) / BLOCK).cast("int")}).join(F.broadcast(begin), "part")
    placed = placed.select("part", "block", "doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "digests", "sizes", "root")
    placed.sortWithinPartitions("part", "start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    spent(dealt, out)
    blocks = _blocks(spark.read.parquet(f"{path}/recipes"))
    blocks.write.parquet(f"{path}/manifest")
    tops = sorted(map(tuple, _parts(spark.read.parquet(f"{path}/manifest")).collect()))  # a row for each partition
    whole = root([_leaf(*t) for t in tops])
    spark.createDataFrame([(*t, width, whole) for t in tops], "part int, start long, blocks long, root binary, width int, store binary").coalesce(1).write.parquet(f"{path}/top")


def _bounds(values: pa.Array) -> np.ndarray:
    """Where each binary value begins in their buffer, and where the last one ends."""
    return np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)


def _buffer(values: pa.Array) -> pa.Buffer:
    """All bytes of binary values, one value behind another."""
    bounds = _bounds(values) if len(values) else [0, 0]
    return (values.buffers()[2] or pa.py_buffer(b"")).slice(bounds[0], bounds[-1] - bounds[0])


def _leaf(*values) -> bytes:
    return repr(tuple(bytes(v) if isinstance(v, bytes | bytearray) else v for v in values)).encode()


def _blocks(recipes: DataFrame) -> DataFrame:
    """What the manifest says of each block: its documents in their order."""

    def run(key, rows):
        rows = rows.sort_by("start")
        leaves = [_leaf(*x) for x in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "root")), strict=True)]
        n, first = sum(rows.column("n_tokens").to_pylist()), rows.column("start")[0].as_py()
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "documents": [len(leaves)], "n_tokens": [n], "start": [first], "root": pa.array([root(leaves)], pa.binary())})

    kinds = "part int, block int, documents long, n_tokens long, start long, root binary"
    return recipes.select("part", "block", "doc_id", "start", "n_tokens", "root").groupBy("part", "block").applyInArrow(run, kinds)


def _parts(manifest: DataFrame) -> DataFrame:
    """part, start, blocks and root of each part: its blocks in their order."""

    def run(key, rows):
        rows = rows.sort_by("block")
        leaves = [_leaf(*x) for x in zip(*(rows.column(c).to_pylist() for c in ("block", "documents", "n_tokens", "start", "root")), strict=True)]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "start": [rows.column("start")[0].as_py()], "blocks": [len(leaves)], "root": pa.array([root(leaves)], pa.binary())})

    return manifest.groupBy("part").applyInArrow(run, "part int, start long, blocks long, root binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids) of each document, checked on the way."""
    recipes, chunks, manifest, top = (spark.read.parquet(f"{path}/{x}") for x in ("recipes", "chunks", "manifest", "top"))
    stated = top.collect()  # a row for each partition that wrote
    width = stated[0]["width"] if stated else 2
    tops = sorted((r["part"], r["start"], r["blocks"], bytes(r["root"])) for r in stated)
    if any(bytes(r["store"]) != root([_leaf(*t) for t in tops]) for r in stated):
        raise ValueError("the store's root does not match its parts")
    if sorted((r["part"], r["start"], r["blocks"], bytes(r["root"])) for r in _parts(manifest).collect()) != tops:
        raise ValueError("a part of the manifest does not match the store's")
    key, rest = ["part", "block"], ["documents", "n_tokens", "start", "root"]
    both = manifest.join(_blocks(recipes).select(*key, *[F.col(c).alias(f"own_{c}") for c in rest]), key, "full")
    if not both.where(" or ".join(f"not ({c} <=> own_{c})" for c in rest)).isEmpty():
        raise ValueError("a block of recipes does not match the manifest")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            stated, data = batch.column(0).to_numpy(zero_copy_only=False), memoryview(_buffer(batch.column(1)))
            bounds = _bounds(batch.column(1)) - _bounds(batch.column(1))[0]
            ends = bounds.tolist()
            if any(digest(data[a:b]) != d for d, a, b in zip(stated, ends[:-1], ends[1:], strict=True)) or (bounds % width).any():
                raise ValueError("a chunk does not match its digest")
            own = np.diff(bounds).astype(np.int64) // width
            wide = memoryview(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
            ends = (bounds.astype(np.int64) // width * 4).tolist()
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(own)], names=["digest", "crc", "own"])

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column("digests"), batch.column("sizes")
            first, ends = (x.offsets.to_numpy() - x.offsets[0].as_py() for x in (lists, sizes))
            if not np.array_equal(first, ends):
                raise ValueError("a recipe does not match its root")
            digests, n, bounds = lists.flatten().to_numpy(zero_copy_only=False).tolist(), sizes.flatten().to_numpy(), first.tolist()
            whole = n.tolist()
            for r, a, b in zip(batch.column("root").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                if recipe_root(digests[a:b], whole[a:b]) != r:
                    raise ValueError("a recipe does not match its root")
            sums = np.cumsum(np.concatenate([[0], n], dtype=np.int64))
            after = np.repeat(sums[first[1:]], np.diff(first)) - sums[1:]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "start", "digests", "sizes")), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(after))], names=["doc_id", "start", "digests", "sizes", "after"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            part = shifted(rows.column("crc").to_numpy(), 4 * rows.column("after").to_numpy())
            yield from rows.select(["doc_id", "start", "n"]).append_column("part", pa.array(part.astype(np.int64))).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:  # many rows at once, as each takes some hundred steps
            held.append(batch)
            if sum(x.num_rows for x in held) >= 1 << 16:
                yield from done(held)
                held = []
        if held:
            yield from done(held)

    kind = recipes.schema["doc_id"].dataType.simpleString()
    lists = recipes.select("doc_id", "start", "digests", "sizes", "root").mapInArrow(tidy(rooted), f"doc_id {kind}, start long, digests array<binary>, sizes array<int>, after array<long>")
    each = lists.select("doc_id", "start", F.explode(F.arrays_zip("digests", "sizes", "after")).alias("x"))
    each = each.select("doc_id", "start", F.col("x.digests").alias("digest"), F.col("x.sizes").cast("long").alias("n"), F.col("x.after").alias("after"))
    sums = chunks.select("digest", "ids").mapInArrow(tidy(checked), "digest binary, crc long, own long")
    crc = F.when(F.col("n").eqNullSafe(F.col("own")), F.col("crc")).otherwise(F.raise_error(F.lit("a chunk is missing or of another size")).cast("long"))
    found = each.join(sums, "digest", "left").select("doc_id", "start", F.col("own").alias("n"), "after", crc.alias("crc"))
    parts = found.mapInArrow(tidy(moved), f"doc_id {kind}, start long, n long, part long")
    return parts.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"))


def ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids themselves: doc_id, start, ids array<int>, rebuilt from the chunks."""
    recipes, chunks = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/chunks")
    heads = spark.read.parquet(f"{path}/top").select("width").limit(1).collect()
    width = heads[0]["width"] if heads else 2
    each = recipes.select("doc_id", "start", F.posexplode("digests").alias("at", "digest")).join(chunks.select("digest", "ids"), "digest")
    rows = each.groupBy("doc_id", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"]).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.frombuffer(b"".join(x), f"<u{width}").astype(np.int32) for x in batch.column("data").to_pylist()]
            yield batch.select(["doc_id", "start"]).append_column("ids", pa.array(out, pa.list_(pa.int32())))

    kind = recipes.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, start long, ids array<int>")


def op9_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    path = scratch(spark, "store")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
