"""What the operators share: tables, the shared scratch folder, lineage cuts and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch sent to a Python worker; texts are long, so Spark's 10,000 rows are too many.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20
#: Bytes of text that the vectorised kernels take at once (a single longer text is taken whole).
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of this session: by bytes always, and by rows (more of them where rows are narrow)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Give a Python worker's free memory back to the machine; workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if release:
        release(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, whose worker gives memory back when a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``most`` bytes; a larger one stays as it is."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset and master and workers are one machine, as in tests, a
    temporary folder is set; on a cluster an unset folder is an error.
    """
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set(key, root)
    return f"{root.rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def spent(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cut a batch into parts of at most ``most`` bytes of text; a single longer text is a part of its own."""
    import numpy as np

    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    a, base = 0, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(a, b - a)
        a, base = b, int(ends[b - 1])
