"""Similarity join of documents on word shingles, to connected components.

Words are lower-cased (A-Z) runs of anything but white space; a document's set holds its distinct shingles of five words
(fewer words: the whole sequence). Two documents link when their sets' Jaccard similarity reaches the threshold.

1. One scan gives each document its set's size, 128-bit digest and signature, and adds every shingle to two count
   sketches. Documents with equal sets are one class from here on, so a large group of copies costs one set.
2. Shingles are ordered by sketched count, rarest first, and by hash. A linked pair shares a shingle among the first
   ``n - ceil(t n) + 1`` of both (the prefix filter, true of any common order), so only those are shuffled, and of those
   only what the sketch can't rule out as one document's alone; shingles that a single class holds are dropped after it.
3. Candidates pass the length filter and the positional filter, then the suffix filter, over signatures of 256 bytes and
   again over the sets themselves, and are verified once per pair by exact intersection.
4. Classes already known to be connected need not be compared: in each round, of every shingle's classes one of each
   component meets a member of the component with most of them (the one with most of its prefix shared, then others by
   a hash of the round), and components merge, until what is left to compare across components is in proportion
   to the shingles' rows or a round has hardly lessened it. Then all of it is compared, in bands of sizes that can link. So a
   group of thousands of near copies costs a few pairs a member, and no link between components is missed.

The fine sketch has 4-bit counters, as many as there may be words up to ``FINE`` (64 MB), the coarse one 2^20 counters for
what is common. A sketch never counts too little, so what it calls single is single; noise costs time and never a link.
With more than some 10^8 words the fine sketch rules out less and less, down to nothing: then each class shuffles a
quarter of its set, which is in proportion to the input.
Sets are 64-bit hashes of shingles, and equal hashes are taken for equal shingles.

Defined cases: a null text or one without words has size 0, links with nothing and is its own component; repeated rows
share a component, and so may rows of one doc_id with other texts; rows with a null doc_id link like all others, and get a
null component only where none of its rows has an id; ids are whole numbers below 2^62, and other ids are an error; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import cut, ready, remove, scratch, slices, spent, tidy

U = np.uint64
#: Words of a shingle and the threshold in hundredths.
WORDS, PERCENT = 5, 75
#: Most and fewest counters of the fine sketch, two to a byte; counters of the coarse one; bytes of a row of either.
FINE, LEAST_FINE, COARSE, STRIPE = 1 << 27, 1 << 16, 1 << 20, 1 << 15
#: Rows of a few numbers, at some 64 bytes each in a task's table, that may be sent to every task.
MAX_SENT = 500_000
#: Ids from here on stand for rows that have none.
NAMELESS = 1 << 62
#: Digests of sets that a task remembers as sent.
REMEMBERED = 200_000
#: Pairs left to compare across components, for each row of shared shingles, at which all are compared; the share of them
#: that a round must leave at most, or all are compared after it; the most rounds.
DENSE, LESS, ROUNDS = 2, 0.9, 16
#: Leaders that a set meets in a round.
LEADERS = 3
#: Partners of a set that one task compares it with.
PARTNERS = 200


def _sets(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, shingles and offsets of each slice of a batch."""
    first = 0
    for part in slices(batch, column):
        data, ends = K.flat(part.column(column))
        data = K.LOWER[data]
        starts, stops, doc = K.words(data, ends)
        s, at = K.shingles(K.word_hashes(data, starts, stops), doc, part.num_rows, WORDS)
        yield first, s, at
        first += part.num_rows


def _sums(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set: sums of two mixes of its members."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate((np.zeros(1, U), np.cumsum(K.mix(s ^ U(salt)))))
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _cells(octets: int) -> int:
    """Counters of the fine sketch for texts of so many bytes: one for each word that they may hold, a power of two."""
    return min(FINE, max(LEAST_FINE, 1 << round(np.log2(max(1, octets / 6)))))


def _fine(s: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and shift of each shingle's fine counter: counters of the first half are low nibbles, the others high ones."""
    at = ((s >> U(20)) & U(cells - 1)).astype(np.int64)
    half = cells // 2
    return at & (half - 1), ((at >= half) * 4).astype(np.uint8)


def _count(fine: np.ndarray, coarse: np.ndarray, s: np.ndarray) -> None:
    """Add shingles to both sketches; fine counters stay at 15."""
    np.add.at(coarse, (s & U(COARSE - 1)).astype(np.int64), 1)
    byte, shift = _fine(s, 2 * len(fine))
    for high in (0, 4):
        at, n = np.unique(byte[shift == high], return_counts=True)
        old = fine[at]
        now = np.minimum(((old >> high) & 15) + n, 15).astype(np.uint8)
        fine[at] = (old & np.uint8(0xF0 >> high)) | (now << np.uint8(high))


@dataclass(frozen=True)
class Sketch:
    """Both sketches, in compressed rows; a worker unpacks them once."""

    name: str
    cells: int
    rows: dict[int, bytes]

    def order(self, s: np.ndarray) -> np.ndarray:
        """How common each shingle is taken to be; 1 is one document's alone."""
        fine, coarse = _unpacked(self)
        byte, shift = _fine(s, self.cells)
        n = ((fine[byte] >> shift) & 15).astype(np.int64)
        common = n == 15
        n[common] = 15 + coarse[(s[common] & U(COARSE - 1)).astype(np.int64)]
        return n


_HELD: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _unpacked(sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    if sketch.name not in _HELD:
        _HELD.clear()  # a worker holds one sketch
        whole = np.zeros(sketch.cells // 2 + 4 * COARSE, np.uint8)
        for stripe, data in sketch.rows.items():
            part = np.frombuffer(zlib.decompress(data), np.uint8)
            whole[stripe * STRIPE : stripe * STRIPE + len(part)] = part
        _HELD[sketch.name] = whole[: sketch.cells // 2], whole[sketch.cells // 2 :].view(np.uint32)
    return _HELD[sketch.name]


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, Sketch]:
    """(doc_id, n, hi, lo, signature) of each document, and the sketches of how many documents hold each shingle."""
    spark = docs.sparkSession
    ready(spark)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    cells = _cells(source.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0)
    split = cells // 2 // STRIPE  # rows from here on are the coarse sketch's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine, coarse, seen = np.zeros(cells // 2, np.uint8), np.zeros(COARSE, np.uint32), set()
        names = ["doc_id", "n", "hi", "lo", "signature", "stripe", "counts"]
        for batch in batches:
            for first, s, at in _sets(batch, "text"):
                hi, lo = _sums(s, at)
                n = len(hi)
                new = np.zeros(n, dtype=bool)
                for i, key in enumerate(zip(hi.tolist(), lo.tolist(), strict=True)):
                    if key not in seen:
                        new[i] = True
                        seen.add(key)
                if len(seen) > REMEMBERED:
                    seen.clear()
                _count(fine, coarse, s[np.repeat(new, np.diff(at))])
                marks = pa.array([signature(s[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(np.diff(at)), pa.array(hi), pa.array(lo), marks, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        whole = np.concatenate((fine, coarse.astype("<u4").view(np.uint8))) if coarse.any() else np.zeros(0, np.uint8)
        for group in range(0, len(whole), 64 * STRIPE):
            rows = [(k // STRIPE, zlib.compress(whole[k : k + STRIPE].tobytes(), 1)) for k in range(group, min(len(whole), group + 64 * STRIPE), STRIPE) if whole[k : k + STRIPE].any()]
            if rows:
                stripe, data = zip(*rows, strict=True)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in range(4)), pa.nulls(n, pa.binary()), pa.array(stripe, pa.int32()), pa.array(data, pa.binary())], names=names)

    kinds = "doc_id long, n long, hi long, lo long, signature binary, stripe int, counts binary"
    both = source.mapInArrow(tidy(run), kinds)
    path = scratch(spark, "classes")
    both.withColumn("part", F.when(F.col("stripe").isNull(), "rows").otherwise("counts")).write.partitionBy("part").option("compression", "zstd").parquet(path)
    part = lambda name, *columns: spark.read.schema(kinds + ", part string").parquet(path).where(f"part = '{name}'").select(*columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of rows sorted by stripe, one row for each stripe and task."""
        now, total = None, None

        def done() -> pa.RecordBatch:
            x = total
            if now < split:
                x = np.minimum(x, 15).astype(np.uint8)
                x = x[0] | (x[1] << np.uint8(4))
            else:
                x = np.minimum(x, 2**32 - 1).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["stripe", "counts"])

        for batch in batches:
            for stripe, data in zip(batch.column("stripe").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if stripe != now:
                    if now is not None:
                        yield done()
                    now, total = stripe, 0
                x = np.frombuffer(zlib.decompress(data), np.uint8)
                total = total + (np.stack([x & 15, x >> 4]).astype(np.uint32) if stripe < split else x.view("<u4").astype(np.uint64))
        if now is not None:
            yield done()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = part("counts", "stripe", "counts").repartition(parts, "stripe").sortWithinPartitions("stripe")
    summed = dealt.mapInArrow(tidy(add), "stripe int, counts binary").toArrow()  # bounded by the sketches' sizes
    rows = dict(zip(summed.column("stripe").to_pylist(), summed.column("counts").to_pylist(), strict=True))
    remove(spark, f"{path}/part=counts")
    return part("rows", "doc_id", "n", "hi", "lo", "signature"), Sketch(uuid.uuid4().hex, cells, rows)


def prefix(n: int) -> int:
    """How many of a set's first shingles any similar set must share one of."""
    return n + (-PERCENT * n) // 100 + 1


def _shared(docs: DataFrame, sketch: Sketch, text_column: str) -> DataFrame:
    """(token, hi, size, prev): prefix shingles that two classes or more hold. ``hi`` is the first half of the class's digest,
    size is n << 32 | pos, and prev the shingle before it in the set's order that isn't known to be single."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sketch)
    name = sketch.name
    names = ["token", "hi", "size", "prev"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held = None
        for batch in batches:
            for _, s, at in _sets(batch, "text"):
                hi, lo = _sums(s, at)
                if held is None:
                    held = sent.value
                counts = held.order(s)
                keep, rows, pos, prev = [], [], [], []
                for i, key in enumerate(zip(hi.tolist(), lo.tolist(), strict=True)):
                    a, b = int(at[i]), int(at[i + 1])
                    if a == b or key in seen:
                        continue
                    seen.add(key)
                    n = counts[a:b]
                    p = prefix(b - a)
                    singles = int(np.count_nonzero(n == 1))  # these come first
                    if singles >= p:
                        continue
                    several = np.flatnonzero(n != 1)
                    first = several[np.lexsort((s[a:b][several], n[several]))[: p - singles]] + a
                    keep.append(first)
                    rows.append(np.full(len(first), i))
                    pos.append(np.arange(singles, p))
                    prev.append(np.concatenate(([hi[i] ^ 0x5DEECE66D], s[first[:-1]].view(np.int64))))
                if len(seen) > REMEMBERED:
                    seen.clear()
                if keep:
                    row = np.concatenate(rows)
                    size = (np.diff(at)[row] << 32) | np.concatenate(pos)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[np.concatenate(keep)].view(np.int64), hi[row], size, np.concatenate(prev))], names=names)
        _HELD.pop(name, None)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by token and class: repeats go, then tokens with one row; a batch's last row waits for the next."""
        held, same = None, False  # the waiting row, and whether a row of its token went before it
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns])
            if held is not None:
                x = np.hstack([held, x])
            new = np.ones(x.shape[1], dtype=bool)
            new[1:] = (x[:3, 1:] != x[:3, :-1]).any(axis=0)
            x = x[:, new]
            again = np.concatenate(([same], x[0, 1:] == x[0, :-1]))
            held, same = x[:, -1:], bool(again[-1])
            kept = (again[:-1] | again[1:]) if x.shape[1] > 1 else np.zeros(0, bool)
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[:-1][kept]) for c in x], names=names)
        if held is not None and same:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)

    kinds = "token long, hi long, size long, prev long"
    ready(spark)
    source = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(tidy(emit), kinds)
    ready(spark, 1 << 16)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = source.repartition(parts, "token").sortWithinPartitions("token", "hi", "size")
    out = cut(sorted_.mapInArrow(tidy(several), kinds), "shared")
    ready(spark)
    sent.unpersist()
    return out


def _possible(a: str, b: str) -> Column:
    """Length and positional filter of two rows of one token, if it is the first that their sets share.

    It is not if the shingles before it are equal. So no linked pair is lost, as it passes at its first shared shingle,
    and a passage that two sets share makes their pair once and not once a shingle.
    """
    n = lambda x: F.shiftright(f"{x}.size", 32)
    pos = lambda x: F.col(f"{x}.size").bitwiseAND(F.lit((1 << 32) - 1))
    low, high = F.least(n(a), n(b)), F.greatest(n(a), n(b))
    most = F.least(n(a) - pos(a), n(b) - pos(b))  # nothing before this token, and what follows from it on
    fresh = F.col(f"{a}.prev") != F.col(f"{b}.prev")
    return (low * 100 >= high * PERCENT) & (most * 100 >= (low + high - most) * PERCENT) & fresh


def _compared(left: DataFrame) -> DataFrame:
    """(a, b) of the possible pairs across labels of rows of one token. Sets that may link lie in one band of sizes or in
    neighbouring ones, so of a token's rows only those of two bands meet."""
    n = F.shiftright("size", 32)
    banded = left.withColumn("band", F.floor(F.log(n) / np.log(1.34)).cast("int"))
    reach = banded.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    size = lambda x: F.shiftright(f"{x}.size", 32)
    rising = (size("x") < size("y")) | ((size("x") == size("y")) & (F.col("x.id") < F.col("y.id")))
    pairs = reach.alias("x").join(banded.alias("y"), ["token", "band"]).where(rising & (F.col("x.label") != F.col("y.label")) & _possible("x", "y"))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """Most members that two ascending sets may share, by where the middle of one falls in the other."""
    if not depth or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y))
    i = len(x) // 2
    j = int(np.searchsorted(y, x[i]))
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(x) + len(y)
    need = -(-PERCENT * both // (100 + PERCENT))
    if min(len(x), len(y)) < need:
        return False
    if suffix_bound(x, y) < need:
        return False
    return both - len(np.union1d(x, y)) >= need


def signature(x: np.ndarray) -> bytes:
    """How many members lie in each of 256 ranges of hashes; 255 stands for that many or more."""
    return np.minimum(np.bincount((x >> U(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The suffix filter over fixed ranges: no pair of sets shares more than the lesser count of each range. ``x``, ``y``:
    signatures as rows; ``n``, ``m``: sizes."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    x[x == 255], y[y == 255] = 1 << 40, 1 << 40
    most = np.minimum(np.minimum(x, y).sum(axis=1), np.minimum(n, m))
    return most * 100 >= (n + m - most) * PERCENT


def _set_rows(texts: DataFrame, wanted: DataFrame, make, kind: str) -> DataFrame:
    """``make`` of the set of each wanted text (id, text); ``wanted``: (id, ...), sent to every task if few."""
    sent = F.broadcast(wanted) if wanted.count() <= MAX_SENT else wanted
    rest = [c for c in wanted.columns if c != "id"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, s, at in _sets(batch, "text"):
                data = [make(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                kept = [batch.column(c).slice(first, len(data)) for c in ("id", *rest)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(at)), pa.array(data, pa.binary())], names=["id", *rest, "n", kind])

    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in ("id", *rest))
    return texts.join(sent, "id").select("id", *rest, "text").mapInArrow(tidy(emit), f"{kinds}, n long, {kind} binary")


def _verified(pairs: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs (a, b): by signatures first, then by the sets themselves.

    A set is sent once to each of its partners' places; the first of a pair may have any number of partners, which are
    dealt to as many places as they need.
    """

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("x", "y"))
            good = may_link(x, y, batch.column("n").to_numpy(), batch.column("m").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(good))

    both = pairs.join(signatures.toDF("a", "n", "x"), "a").join(signatures.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    left = cut(both.mapInArrow(tidy(filtered), "a long, b long").distinct(), "likely")
    places = left.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("places"))
    firsts = places.select(F.col("a").alias("id"), F.col("a"), F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    seconds = left.join(places, "a").select(F.col("b").alias("id"), "a", "b", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"))
    wanted = cut(firsts.union(seconds), "wanted")
    rows = _set_rows(texts, wanted, lambda x: x.astype("<u8").tobytes(), "members")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # the sets that the place's first stands for
        for batch in batches:
            found = []
            for a, place, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "place", "b", "members")), strict=True):
                if key != (a, place):
                    key, held = (a, place), []
                x = np.frombuffer(data, "<u8")
                if b is None:
                    held.append(x)
                elif any(similar(h, x) for h in held):
                    found.append((a, b))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("a", "place", "b", "members").repartition(parts, "a", "place").sortWithinPartitions("a", "place", F.asc_nulls_first("b"))
    return dealt.mapInArrow(tidy(compared), "a long, b long")


def links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes with their documents, (doc_id, n, first), and (node, label) of the classes that link with others; a class
    is named by its smallest doc_id."""
    each, sketch = classes(docs, id_column, text_column)
    named = cut(each.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("id")), "named")
    members = each.join(named.withColumnRenamed("id", "first"), ["hi", "lo", "n"], "left").select("doc_id", "n", "first")

    shared = _shared(docs, sketch, text_column)
    found = shared.withColumn("n", F.shiftright("size", 32)).join(named.drop("lo"), ["hi", "n"]).where("id is not null")
    rows = cut(found.select("token", "id", "size", "prev"), "rows")
    spent(shared)
    ids = cut(rows.groupBy("id").agg(F.count("*").alias("shared")), "ids")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    few = F.broadcast(ids.select("id")) if ids.count() <= MAX_SENT else ids
    signatures = cut(each.join(few, each["doc_id"] == few["id"], "left_semi").where("n > 0").select(F.col("doc_id").alias("id"), "n", "signature"), "signatures")

    labels = ids.select(F.col("id").alias("node"), F.col("id").alias("label"), "shared")
    tested, before = [], None
    for turn in range(ROUNDS):
        # first the sets with most of their prefix shared, then others of the same component
        weight = F.col("shared") / F.shiftright("size", 32) if turn == 0 else F.xxhash64("id", F.lit(turn)).cast("double")
        now = rows.join(labels, rows["id"] == labels["node"]).select("token", "id", "size", "prev", "label", weight.alias("weight"))
        one = cut(now.groupBy("token", "label").agg(F.max(F.struct("weight", "id")).alias("best"), F.count("*").alias("k")), "one")
        lead = F.max(F.struct("k", "best"))["best"]["id"]
        per = one.groupBy("token").agg(lead.alias("lead"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.count("*").alias("parts"))
        open_ = cut(per.where("parts > 1"), "open")
        work, held = open_.agg(F.coalesce(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).collect()[0]
        if not held:
            spent(one, open_)
            break
        last = work <= DENSE * held or turn == ROUNDS - 1 or (before is not None and work > LESS * before)
        before = work
        if last:
            pairs = _compared(now.join(open_.select("token"), "token", "left_semi"))
        else:
            met = one.select("token", F.col("best.id").alias("id")).join(open_.select("token", "lead"), "token").where("id != lead")
            shared_most = F.slice(F.sort_array(F.collect_list(F.struct("n", "lead")), False), 1, LEADERS)  # of a set's prefix at most
            best = met.groupBy("id", "lead").agg(F.count("*").alias("n")).groupBy("id").agg(shared_most.alias("x"))
            best = best.select("id", F.explode("x.lead").alias("lead"))
            pairs = best.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        pairs = pairs.distinct()
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        if not last:  # tokens of one component alone have nothing left to tell
            old, rows = rows, cut(rows.join(open_.select("token"), "token", "left_semi"), "rows")
            spent(old)
        spent(one, open_)
        good = cut(_verified(pairs, signatures, texts).distinct(), "good")
        tested.append(pairs)
        if not good.isEmpty():
            of = labels.select("node", "label")
            merged = good.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
            moved = components(merged).toDF("label", "to")
            old, labels = labels, cut(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"), "shared"), "labels")
            spent(old)
        spent(good)
        if last:
            break
    spent(rows, ids, signatures, *tested)
    # labels of classes on their own say nothing
    return members, labels.where("node != label").select("node", "label")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    nameless = source.where("doc_id is null")
    if not nameless.isEmpty():  # they get ids of their own, above all others, so that no component is called by one that has others
        named = cut(nameless.select((F.lit(NAMELESS) + F.monotonically_increasing_id()).alias("doc_id"), "text"), "nameless")
        source = source.where("doc_id is not null").union(named)
    members, labels = links(source)
    out = members.join(labels, members["first"] == labels["node"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "first")).otherwise(F.col("doc_id"))
    known = lambda x: F.when(x < NAMELESS, x)
    return out.select(known(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(component).alias("component_id"))


def op5_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "documents"))
