"""Scan of a chat export: one JSON object with an array of messages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.period import in_month, in_month_of
from ..operators.edition import normalised, prepared

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"
OFFSET = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*([+-]\d{2}:?\d{2}|Z)$"


#: A cell is cut off at a comma outside strings no deeper than this: in the document (1) or in a value of it (2).
DEEPEST = 2
#: The start of a member of the document: its name, in quotes, and what follows the colon.
MEMBER = r'(?s)\A\s*"((?:[^"\\]|\\.)*)"\s*:\s*(.*)\z'
#: A cell's content before what closes the value, or the value and the document, by the depth behind the cell.
CLOSED = {1: r"(?s)\A(.*)\]\s*\z", 0: r"(?s)\A(.*)\]\s*\}\s*\z"}


def _raise(message: str, kind: str = "string") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, text): a hash of a file's path, where a byte range of it begins, and the text between two commas, as Spark's text reader cuts it out of byte ranges, in order within a
    range. No valid escape reaches over a comma, so a range tells its quotes by itself."""
    return spark.read.option("lineSep", ",").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))


class _Scanner:
    """Follows strings and brackets through the texts of a range, from a state at its beginning: in a string or not, and a depth."""

    KINDS = np.zeros(256, np.int8)
    KINDS[[ord(x) for x in '"{[}],']] = (2, 1, 1, -1, -1, 3)

    def __init__(self, odd: int, depth: int):
        self.odd, self.depth = odd, depth

    def commas(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where commas outside of strings are, and how deep."""
        quote = kind == 2
        inside = (np.cumsum(quote) - quote + self.odd) % 2 == 1
        depth = self.depth + np.cumsum(np.where(~inside & (np.abs(kind) == 1), kind, 0))
        if len(at):
            self.odd, self.depth = int((self.odd + quote.sum()) % 2), int(depth[-1])
        found = (kind == 3) & ~inside
        return at[found], depth[found]

    @classmethod
    def marks(cls, texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The texts with a comma behind each, where quotes, brackets and commas are, and what is there."""
        joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(",", pa.large_string()))
        ends = np.frombuffer(joined.buffers()[1], np.int64)
        raw = joined.buffers()[2].to_pybytes()[ends[joined.offset] : ends[joined.offset + len(joined)]]
        data = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(cls.KINDS[data])
        kind = cls.KINDS[data[at]]
        slash = data == 92
        if slash.any():  # a quote behind an odd number of them is escaped
            last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
            before = np.maximum(at - 1, 0)
            keep = ~((kind == 2) & (at > 0) & slash[before] & ((before - last[before]) % 2 == 1))
            at, kind = at[keep], kind[keep]
        return raw, data, at, kind


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, block, texts) of the runs of one range in each batch."""
    for batch in batches:
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield int(file[a]), int(block[a]), batch.column("text").slice(a, b - a)


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's map: for either state that it may begin in, the state that it ends in, and how often commas outside of strings
    stand at a depth."""
    now, scanners, seen = None, [], []

    def done() -> pa.RecordBatch:
        rows = [{"file": now[0], "block": now[1], "begins": s, "odd": x.odd ^ s, "step": x.depth, "reached": depth, "n": n} for s, x in enumerate(scanners) for depth, n in [(None, 0), *seen[s].items()]]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.int64()), ("block", pa.int64()), ("begins", pa.int32()), ("odd", pa.int32()), ("step", pa.int32()), ("reached", pa.int32()), ("n", pa.int64())]))

    for file, block, texts in _ranges(batches):
        if now != (file, block):
            if now:
                yield done()
            now, scanners, seen = (file, block), [_Scanner(0, 0), _Scanner(1, 0)], [Counter(), Counter()]
        _, data, at, kind = _Scanner.marks(texts)
        for scanner, held in zip(scanners, seen, strict=True):
            _, depth = scanner.commas(data, at, kind)
            held.update(dict(zip(*(x.tolist() for x in np.unique(depth, return_counts=True)), strict=True)))
    if now:
        yield done()


def starts(rows: DataFrame) -> DataFrame:
    """(file, block, odd0, depth, cells, whole): the scanner's true state at the beginning of each range, the number of cells
    that end before it, and whether the file ends outside of everything: the ranges' maps, composed in order."""
    maps = rows.mapInArrow(_maps, "file long, block long, begins int, odd int, step int, reached int, n long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = maps.where("reached is null").groupBy("file", "block").agg(F.max("odd").alias("odd"), *[F.max(F.when(F.col("begins") == s, F.col("step"))).alias(f"step{s}") for s in (0, 1)])
    known = ends.withColumn("odd0", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    known = known.withColumn("step", F.when(F.col("odd0") == 0, F.col("step0")).otherwise(F.col("step1"))).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    cut = known.join(maps.where("reached is not null"), ["file", "block"], "left").groupBy("file", "block").agg(F.sum(F.when((F.col("begins") == F.col("odd0")) & (known["depth"] + F.col("reached") <= DEEPEST), F.col("n")).otherwise(0)).alias("cut"))
    every = Window.partitionBy("file")
    whole = (F.sum("odd").over(every) % 2 == 0) & (F.sum("step").over(every) == 0)
    return known.join(cut, ["file", "block"]).select("file", "block", "odd0", "depth", F.coalesce(F.sum("cut").over(before), F.lit(0)).alias("cells"), whole.alias("whole"))


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, cell, text, begins, ends, whole): the document cut at commas no deeper than DEEPEST, with the depth before and
    behind each cell. Only the first and last of a range meet others, as they may be parts of one."""
    rows = records(spark, path)
    known = {(r["file"], r["block"]): (r["odd0"], r["depth"], r["cells"], r["whole"]) for r in starts(rows).collect()}  # four numbers for each range
    sent = spark.sparkContext.broadcast(known)
    names = ["file", "block", "cell", "edge", "text", "begins", "ends", "whole"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scanner, cell, whole, first, open_, begins = None, None, 0, True, 0, b"", 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=names)
            out.clear()
            return made

        def close() -> None:
            if open_:
                out.append((*now, cell, True, open_[:-1].decode(), begins, scanner.depth, whole))

        for file, block, texts in _ranges(batches):
            if now != (file, block):
                close()
                odd, depth, cell, whole = sent.value[file, block]
                now, scanner, first, open_, begins = (file, block), _Scanner(odd, depth), cell, b"", depth
            raw, data, at, kind = _Scanner.marks(texts)
            where, depth = scanner.commas(data, at, kind)
            shallow = depth <= DEEPEST
            a = 0
            for b, deep in zip(where[shallow].tolist(), depth[shallow].tolist(), strict=True):
                out.append((*now, cell, cell == first, (open_ + raw[a:b]).decode(), begins, deep, whole))
                a, open_, begins, cell = b + 1, b"", deep, cell + 1
            open_ += raw[a:]
            if len(out) > 1000:
                yield batch()
        close()
        if out:
            yield batch()

    pieces = rows.mapInArrow(run, "file long, block long, cell long, edge boolean, text string, begins int, ends int, whole boolean")
    parts = F.sort_array(F.collect_list(F.struct("block", "text")))
    joined = pieces.where("edge").groupBy("file", "cell").agg(F.array_join(F.transform(parts, lambda x: x["text"]), ",").alias("text"), F.min_by("begins", "block").alias("begins"), F.max_by("ends", "block").alias("ends"), F.first("whole").alias("whole"))
    return pieces.where("not edge").select("file", "cell", "text", "begins", "ends", "whole").unionByName(joined)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(pos, m): every item in its order. A corrupt file, text behind the document or a duplicated key is an error; no array
    means no rows. A file is cut into byte ranges and items by Spark; no task and no row has the whole of it."""
    rows = cells(spark, path)
    text = F.when(F.col("cell") == 0, F.regexp_replace("text", r"\A\x{FEFF}?\s*\{", "")).otherwise(F.col("text"))
    opened = (F.col("cell") > 0) | F.col("text").rlike(r"\A\x{FEFF}?\s*\{")
    top = F.col("begins") < DEEPEST
    name, rest = F.regexp_extract("text", MEMBER, 1), F.regexp_extract("text", MEMBER, 2)
    empty = (F.col("cell") == 0) & (F.col("ends") == 0) & F.col("text").rlike(r"\A\s*\}\s*\z")
    sound = F.when(~F.col("whole"), _raise("the file ends within its document", "boolean")).when(~opened | ((F.col("begins") < 1) & (F.col("cell") > 0)), _raise("the file is not one JSON object", "boolean")).otherwise(True)
    rows = rows.where(sound).withColumn("text", text)
    rows = rows.where(F.when(top & ~empty & ~F.col("text").rlike(MEMBER), _raise("a member of the document has no name", "boolean")).otherwise(~empty))
    rows = rows.withColumns({"name": F.when(top, name), "text": F.when(top, rest).otherwise(F.col("text"))})
    # where the value named messages begins, and where the next one does
    heads = rows.where(top).select("file", "cell", "name", F.substring("text", 1, 1).alias("opens"), "ends")
    first = heads.where("name = 'messages'").groupBy("file").agg(F.min("cell").alias("first"), F.max("cell").alias("again"), F.min_by("opens", "cell").alias("opens"))
    later = heads.join(first, "file").where("cell > first").groupBy("file").agg(F.min("cell").alias("next"))
    asked = first.join(later, "file", "left")
    asked = spark.createDataFrame(asked.toArrow(), asked.schema)  # a row for each file
    found = rows.join(F.broadcast(asked), "file", "left")
    ours = (F.col("cell") >= F.col("first")) & (F.col("next").isNull() | (F.col("cell") < F.col("next")))
    open_ = F.when(top & F.col("text").rlike(r"\A[\[{]"), F.expr("substring(text, 2)")).otherwise(F.col("text"))
    inner = F.when(F.col("ends") >= DEEPEST, open_).when(F.col("ends") == 1, F.regexp_extract(open_, CLOSED[1], 1)).otherwise(F.regexp_extract(open_, CLOSED[0], 1))
    shut = (F.col("ends") >= DEEPEST) | F.when(F.col("ends") == 1, open_.rlike(CLOSED[1])).otherwise(open_.rlike(CLOSED[0]))
    blank = inner.rlike(r"\A\s*\z")
    none = F.col("text").rlike(r"\A\s*null\s*(\}\s*)?\z")
    item = (
        F.when(F.col("first") != F.col("again"), _raise("two members of the document are named messages"))
        .when(top & none, F.lit(None).cast("string"))
        .when((F.col("opens") != "[") | ~shut, _raise("messages is not an array, or something follows the document"))
        .when(blank & top & (F.col("ends") < DEEPEST), F.lit(None).cast("string"))
        .when(blank, _raise("an item of messages is empty")).otherwise(inner)
    )
    # other values are looked at a cell at a time: closed, as a value; open, as an item or a member
    most = F.regexp_replace(F.col("text"), r"[\]}]\s*\z", "")
    bare = F.when(top & (F.col("ends") >= DEEPEST), open_).when(top & (F.col("ends") == 1), F.col("text")).when(top, most)
    bare = bare.when(F.col("ends") >= DEEPEST, F.col("text")).when(F.col("ends") == 1, most).otherwise(F.regexp_replace(most, r"[\]}]\s*\z", ""))
    valid = F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))).isNotNull() | (F.try_parse_json(F.concat(F.lit("{"), bare, F.lit("}"))).isNotNull() & ~(top & (F.col("ends") < DEEPEST)))
    ours = F.coalesce(ours, F.lit(False))
    ours = F.when(~ours & ~valid, _raise("a member of the document is not valid JSON", "boolean")).otherwise(ours)
    items = found.where(ours).select("file", (F.col("cell") - F.col("first")).alias("pos"), item.alias("item")).where("item is not null")
    return items.select(F.col("pos").cast("int").alias("pos"), F.from_json(F.concat(F.lit('{"m":'), F.col("item"), F.lit("}")), "m variant", {"mode": "FAILFAST"})["m"].alias("m"))


def qualifying(items: DataFrame, period: str, chat_id: str, username: str) -> DataFrame:
    """Messages of the month with text. A date with an offset is an error, as zones are not compared."""
    get = lambda key, kind="string": F.try_variant_get("m", f"$.{key}", kind)
    date = F.when(get("date").rlike(OFFSET), F.raise_error(F.lit("a date carries an offset")).cast("string")).otherwise(get("date"))
    id_kind = F.schema_of_variant(F.variant_get("m", "$.id", "variant"))
    rows = items.where((get("type") == "message") & id_kind.isin("BIGINT", "BOOLEAN"))
    rows = rows.withColumn("date", date).where(F.col("date").rlike(ISO)).withColumn("at", F.expr("try_cast(date as timestamp_ntz)"))
    rows = rows.where(F.col("at").isNotNull() & in_month(F.col("at"), period))
    rows = rows.withColumn("source_text", T.strip(T.plain_text(F.variant_get("m", "$.text", "variant")))).where("source_text != ''")
    number = F.when(id_kind == "BOOLEAN", get("id", "boolean").cast("long")).otherwise(get("id", "long"))
    sender = F.when(F.variant_get("m", "$.from", "variant").isNull(), F.lit("")).otherwise(get("from"))
    return rows.select(
        "pos", F.lit(chat_id).alias("chat_id"), number.alias("message_id"), F.col("date").alias("published_at"), sender.alias("sender_name"), "source_text",
        T.source_url(username, number).alias("source_url"), get("media_type").alias("media_type"), get("media_group_id").alias("media_group_id"),
    )


def told(items: DataFrame, period: str, chat_id: str, zone: str) -> DataFrame:
    """What an export says of the month's messages, in the columns of the store's states, with pos, sender_name and media_type.

    Messages without text are kept. The month is that of the zone: ``date_unixtime`` counts where there is one, else ``date`` is
    a time of that zone. ``edited_unixtime`` or ``edited`` tell when the text was last changed, else it is as it was sent. An
    id counts as in :func:`qualifying`; a message whose date is none is left out, and a date with an offset is an error.
    """
    get = lambda key, kind="string": F.try_variant_get("m", f"$.{key}", kind)

    def instant(local: str, unix: str) -> Column:
        date = F.when(get(local).rlike(OFFSET), _raise("a date carries an offset")).when(get(local).rlike(ISO), get(local))
        return F.coalesce(F.timestamp_seconds(F.expr(f"try_cast(try_variant_get(m, '$.{unix}', 'string') as long)")), F.concat(date.try_cast("timestamp_ntz").cast("string"), F.lit(f" {zone}")).try_cast("timestamp"))

    id_kind = F.schema_of_variant(F.variant_get("m", "$.id", "variant"))
    rows = items.where((get("type") == "message") & id_kind.isin("BIGINT", "BOOLEAN")).withColumn("sent_at", instant("date", "date_unixtime")).where(in_month_of(F.col("sent_at"), period, zone))
    number = F.when(id_kind == "BOOLEAN", get("id", "boolean").cast("long")).otherwise(get("id", "long"))
    words = F.nullif(prepared(normalised(T.plain_text(F.variant_get("m", "$.text", "variant")))), F.lit(""))
    sender = F.when(F.variant_get("m", "$.from", "variant").isNull(), F.lit("")).otherwise(get("from"))
    return rows.select(
        F.lit(period).alias("period_key"), F.lit(chat_id).alias("chat_id"), number.alias("message_id"), "sent_at", F.coalesce(instant("edited", "edited_unixtime"), "sent_at").alias("at"), F.col("pos").cast("long").alias("update_id"),
        words.alias("words"), get("media_group_id").alias("media_group_id"), F.lit(False).alias("deleted"), "pos", sender.alias("sender_name"), get("media_type").alias("media_type"),
    )
