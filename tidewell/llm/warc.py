"""WARC archives: records written by Spark's own writer, and a splittable reader.

Every record is a gzip member of its own, and one follows the other at once, so any gzip tool reads the files. The writer
hands the members to Spark's text writer, whose line end is a zero byte, each without its own last byte: that is the high
byte of the member's length and zero below 16 MB; a longer record is followed by an empty member, which ends so. Thus any
file system that Spark knows will do, and its commit protocol covers lost executors. The files are then named
``*.warc.gz``.

The reader deals byte ranges to tasks. A task looks for gzip magic in its range, takes a candidate for a member only if
it decodes to a WARC header that states its length, and reads every record that starts inside its range, past its end
if need be. So each record has one owner, wherever ranges are cut. A payload that holds a whole gzipped WARC stored
without compression could be taken for a record if a range began inside it.

Of records with equal payloads of at least ``least`` bytes, that with the smallest id is a ``response`` and the others
are ``revisit`` records: their block is the HTTP header alone, whose Content-Length keeps the payload's length, and they
refer to the response. Only digests meet in the shuffle that finds equal payloads; the pages join the digests that occur
more than once (a written table: Spark broadcasts it only if its size is below the session's limit, else it joins by
shuffle and splits skewed keys).

Defined cases: a null html is an empty payload; a null url has no target URI; a null id is written and read as null and
never is the response of others; rows that repeat the smallest id are all responses; an empty table gives no records;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, ready, scratch, tidy

#: Format constants (fixed values).
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member of nothing (fixed value but for the machine's mark).
EMPTY = zlib.compress(b"", wbits=31)
#: The date of records whose pages have none.
DATE = "2024-01-01T00:00:00Z"
#: Bytes of a range, and of one read.
SPLIT_BYTES, READ_BYTES = 8 << 20, 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, target: str | None = None) -> bytes:
    """A gzip member with one response or, given the page it refers to, one revisit record."""
    clean = lambda u: quote(u, safe="!#$%&'()*+,/:;=?@[]~-._")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if target is not None:
            head.append(f"WARC-Refers-To-Target-URI: {clean(target)}")
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def line(member: bytes) -> bytes:
    """A member for the text writer: what comes before the zero byte that it adds."""
    return member[:-1] if member[-1] == 0 else member + EMPTY[:-1]


def write(pages: DataFrame, path: str, least: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Write archives of a table of pages to a folder."""
    spark = pages.sparkSession
    ready(spark)
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sum", F.when(F.octet_length("html") >= least, F.sha1("html")))
    light = rows.where("page_id is not null").groupBy("sum").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
    nulls = rows.where("page_id is null").groupBy("sum").agg(F.lit(None).cast("struct<page_id:long,url:string>").alias("first"), F.count("*").alias("n"))
    firsts = light.union(nulls).groupBy("sum").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1 and sum is not null and first is not null")
    firsts = cut(firsts.select("sum", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "payloads")
    joined = rows.join(firsts, "sum", "left").select("page_id", "url", "html", "first_id", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, html, first, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers = first if first is not None and first != page_id else None
                out.append(line(record(page_id, url, html.encode(), refers, target)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    joined.mapInArrow(tidy(run), "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)
    _name(spark, path)


def _name(spark: SparkSession, path: str) -> None:
    """Give the written parts the ending that archives have."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for each in fs.listStatus(folder):
        p = each.getPath()
        if p.getName().endswith(".txt"):
            fs.rename(p, jvm.org.apache.hadoop.fs.Path(folder, p.getName()[:-4] + ".warc.gz"))


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "file:///" + path[5:].lstrip("/")
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _member(f, buffer: bytes, at: int, base: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` of the buffer (read from ``base`` of the file), and its end; None if there's none."""
    unpack = zlib.decompressobj(31)
    try:
        out = [unpack.decompress(buffer[at : at + 4096])]
        if len(out[0]) >= 7 and not out[0].startswith(b"WARC/1."):
            return None
        out.append(unpack.decompress(buffer[at + 4096 :]))
        read = base + len(buffer)
        while not unpack.eof:
            more = f.read_at(READ_BYTES, read)
            if not more:
                return None
            read += len(more)
            out.append(unpack.decompress(more))
    except zlib.error:
        return None
    data = b"".join(out)
    return (data, read - len(unpack.unused_data)) if data.startswith(b"WARC/1.") else None


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a record; None if the header doesn't state the block's length."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not gap or not size.isdigit() or len(rest) < int(size):
        return None
    return fields, rest[: int(size)]


def records(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file that start in [start, end)."""
    with _opened(path) as f:
        base, buffer, at = start, f.read_at(READ_BYTES, start), 0
        while base + at < end and buffer:
            at = buffer.find(MAGIC, at)
            if at < 0 or at + 4096 > len(buffer):  # the magic may be cut, or the member's head
                keep = len(buffer) - 2 if at < 0 else at
                more = f.read_at(READ_BYTES, base + len(buffer))
                if not more and at < 0:
                    return
                if more:
                    base, buffer, at = base + max(0, keep), buffer[max(0, keep) :] + more, 0
                    continue
            if base + at >= end:
                return
            found = _member(f, buffer, at, base)
            got = parse(found[0]) if found else None
            if got is None:
                at += 1
                continue
            yield got
            if found[1] <= base + len(buffer):
                at = found[1] - base
            else:
                base, at = found[1], 0
                buffer = f.read_at(READ_BYTES, base)


def _number(uri: str) -> int | None:
    text = uri.strip("<>").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdigit() else None


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of the archives in a folder: page_id, url, payload_bytes, payload_digest, record_type, refers_to and,
    if asked for, the payload (null for a revisit). A response whose payload doesn't match its digest is an error."""
    ready(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    step = F.lit(split_bytes)
    splits = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step.cast("long"))).alias("start"))
    total = max(1, splits.count())
    splits = splits.select("path", "start", F.least(F.col("start") + step, F.col("length")).alias("end")).repartition(min(total, 100_000))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def rows(path: str, start: int, end: int) -> Iterator[tuple]:
        for fields, block in records(path, start, end):
            kind = fields.get("warc-type")
            if kind not in ("response", "revisit"):
                continue
            head, _, payload = block.partition(b"\r\n\r\n")
            stated = fields.get("warc-payload-digest", "").rpartition(":")[2]
            size = len(payload)
            if kind == "revisit":
                lengths = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                size, payload = int(lengths[0]), None
            elif payload_digest(payload) != stated:
                raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
            refers = _number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
            yield (_number(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), size, stated, kind, refers) + ((payload,) if with_payload else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        found, held = [], 0
        for x in batches:
            for each in zip(*(c.to_pylist() for c in x.columns), strict=True):
                for row in rows(*each):
                    found.append(row)
                    held += row[2] if with_payload else 100
                    if len(found) >= 4096 or held > 16 << 20:
                        yield batch(found)
                        found, held = [], 0
        if found:
            yield batch(found)

    return splits.mapInArrow(tidy(run), schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
