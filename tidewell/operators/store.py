"""Set operators of the store, and the store: versions of tables, kept as immutable files by period."""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema

#: Rows of a cell in which rows are numbered together, and the most cells.
CELL_ROWS, MOST_CELLS = 1 << 20, 1000


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__x")).select(*keys, "__x.*")


def absent(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(target.select(*keys), keys, "left_anti")


def cell_of(rows: DataFrame, order: str, cell_rows: int = CELL_ROWS) -> tuple[Column, list]:
    """The number of a row's cell, from 0 up: the range of a numeric column is cut into cells of some ``cell_rows`` rows at
    approximate percentiles. And the bounds between cells, each the last value of its cell."""
    n = rows.count()
    cells = max(1, min(MOST_CELLS, -(-n // cell_rows)))
    bounds = sorted(set(rows.agg(F.percentile_approx(order, [i / cells for i in range(1, cells)], 10_000)).collect()[0][0])) if cells > 1 else []
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col(order))) if bounds else F.lit(0), bounds


def numbered(rows: DataFrame, after: int, order: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Surrogate ids after the highest so far, in the order of a numeric column without nulls or ties.

    Cells of some ``cell_rows`` rows are counted, and each
    numbers its rows after those of the cells before it. A cell's bounds are values of this call, so it holds the same rows
    whenever it is computed.
    """
    cell, bounds = cell_of(rows, order, cell_rows)
    celled = rows.withColumn("__cell", cell)
    held = {r["__cell"]: r["count"] for r in celled.groupBy("__cell").count().collect()} if bounds else {}
    before, at = [], after
    for i in range(len(bounds) + 1):
        before.append(at)
        at += held.get(i, 0)
    first = F.element_at(F.array(*map(F.lit, before)).cast("array<long>"), F.col("__cell") + 1)
    return celled.withColumn("id", first + F.row_number().over(Window.partitionBy("__cell").orderBy(order))).drop("__cell")


class Conflict(OSError):
    """Another writer committed first."""


class Store:
    """Versions of the tables ``messages``, ``entries``, ``actions``, ``results``, ``editions`` and ``states``.

    A version is a manifest: for each table and period the folder that holds its rows. Folders are never changed. A commit
    writes new folders for the periods that it changes, then the manifest that names them and all others, and takes the next version's
    number by renaming the manifest's folder; the rename fails where that number is taken, so a writer whose base is no longer
    the latest version changes nothing. Until the rename, and if anything fails, the version before stands. Reading a period
    reads its folders alone. The file system must rename a folder atomically and refuse to replace one that is not empty.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> dict[str, float]:
        """Names in a folder and when each was last changed."""
        at = self._at(f"{self.path}/{folder}")
        return {x.getPath().getName(): x.getModificationTime() / 1000 for x in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def _delete(self, *folders: str) -> None:
        for x in folders:
            self._fs.delete(self._at(f"{self.path}/{x}"), True)

    def version(self) -> int:
        """The latest; 0 is the empty store."""
        return max((int(x[1:]) for x in self._names("versions")), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """A row for each table and period: table_name, period_key, folder, rows, top (the highest id, of messages)."""
        version = self.version() if version is None else version
        return [r.asDict() for r in self.spark.read.schema(schema.MANIFEST).json(f"{self.path}/versions/v{version:012d}").collect()] if version else []

    def top(self, version: int | None = None) -> int:
        """The highest id of all messages, without reading them."""
        return max((r["top"] or 0 for r in self.manifest(version)), default=0)

    def read(self, table: str, period: str | None = None, version: int | None = None) -> DataFrame:
        """A table, or a period of it, as of a version."""
        kind = getattr(schema, table.upper())
        if table == "publications":
            found = [f"log/{table}"] if self._names("log").keys() & {table} else []
        else:
            found = [r["folder"] for r in self.manifest(version) if r["table_name"] == table and period in (None, r["period_key"])]
        rows = self.spark.read.schema(kind).parquet(*[f"{self.path}/{x}" for x in found]) if found else self.spark.createDataFrame([], kind)
        return rows.where(F.col("period_key") == period) if period and table == "publications" else rows

    def mark(self, stream: str, version: int | None = None) -> int:
        """The last batch of a stream that a version holds; -1 if none."""
        return max((r["rows"] for r in self.manifest(version) if r["table_name"] == "stream" and r["period_key"] == stream), default=-1)

    def commit(self, base: int, changes: dict[tuple[str, str], DataFrame], marks: dict[str, int] | None = None) -> int:
        """Replace the rows of some (table, period) by others, and set the last batch of some streams, as a version that follows
        ``base``; its number."""
        held = {(r["table_name"], r["period_key"]): r for r in self.manifest(base)}
        for stream, batch in (marks or {}).items():
            held["stream", stream] = {"table_name": "stream", "period_key": stream, "folder": "", "rows": batch, "top": None}
        unique, new = uuid.uuid4().hex, []
        stage = f"_{unique}"
        try:
            for (name, period), rows in changes.items():
                folder = f"data/{name}/{period}-{unique}"
                new.append(folder)
                rows.write.parquet(f"{self.path}/{folder}")
                n, top = self.spark.read.parquet(f"{self.path}/{folder}").agg(F.count("*"), F.max("id") if name == "messages" else F.lit(None)).collect()[0]
                held[name, period] = {"table_name": name, "period_key": period, "folder": folder, "rows": n, "top": top}
            self.spark.createDataFrame(list(held.values()), schema.MANIFEST).coalesce(1).write.json(f"{self.path}/{stage}")
            self._fs.mkdirs(self._at(f"{self.path}/versions"))
            to = self._at(f"{self.path}/versions/v{base + 1:012d}")
            # where a rename onto a folder moves into it, another writer's version must not be taken for this one
            if self._fs.exists(to) or not self._fs.rename(self._at(f"{self.path}/{stage}"), to) or self._fs.exists(self._at(to, stage)):
                self._fs.delete(self._at(to, stage), True)
                raise Conflict(f"version {base + 1} was not committed: another writer was first")
        except BaseException:
            self._delete(stage, *new)
            raise
        return base + 1

    def expire(self, keep: int = 10, older: float = 86_400) -> int:
        """Delete all versions but the latest ``keep``, and folders and stages that no version left names and that are older
        than so many seconds, as a writer may be about to name younger ones; how many were deleted."""
        now, last = time.time(), self.version()
        gone = [f"versions/{x}" for x in self._names("versions") if int(x[1:]) <= last - keep]
        self._delete(*gone)
        named = {r["folder"] for x in self._names("versions") for r in self.manifest(int(x[1:]))}
        loose = [(f"data/{t}/{x}", at) for t in self._names("data") for x, at in self._names(f"data/{t}").items()] + [(x, at) for x, at in self._names("").items() if x.startswith("_")]
        loose = [x for x, at in loose if x not in named and now - at >= older]
        self._delete(*loose)
        return len(gone) + len(loose)

    def sent(self, period: str, destination: str, part: int, message_id: int, html: str) -> None:
        """Add a part to the publications, which are a log beside the versions: an entry stands as soon as its part is sent."""
        row = self.spark.createDataFrame([(period, destination, part, message_id, html, datetime.now(UTC).isoformat())], schema.PUBLICATIONS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log/publications")
