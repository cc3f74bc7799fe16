"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Every stage takes the documents that the one before it kept, whole, and but for the last returns the columns of
``documents``. No stage samples or caps its input. Between stages documents are written and read again, so each begins
with short lineage.

A null text is kept by every stage. Rows are removed by a key of their own, so those with a null or a repeated doc_id are
judged by their own text; of copies that with the smallest id stays, null ids last. An empty table passes through and
packs to no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, packing, quality, secrets, similarity, toxicity
from tidewell.llm.shared import cut, table


ROW = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key for each row, written so that it stays the same."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def _without(keyed: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Documents whose row isn't listed. The list is written first: Spark sends it to every task only if its files' size is
    below the session's limit, and else joins by shuffle."""
    return keyed.join(cut(rows.distinct(), name), ROW, "left_anti").drop(ROW)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, 0.7, keep=True).where("__predicted = 0").select(docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents that with the smallest id stays."""
    keyed = _keyed(docs)
    groups = similarity.near_duplicates(keyed, ROW).select(F.col("doc_id").alias(ROW), "component_id")
    each = cut(groups.join(keyed.select(ROW, "doc_id"), ROW), "groups")
    first = each.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))[ROW].alias(ROW))
    return _without(keyed, each.select(ROW).join(first.select(ROW), ROW, "left_anti"), "copies").select(docs.columns)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed = _keyed(docs)
    leaks = decontamination.contained(keyed, table(spark, sf_dir, "benchmark"), ROW).select(F.col("doc_id").alias(ROW))
    return _without(keyed, leaks, "leaks").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows it."""
    out = secrets.redact(docs, secrets.learn(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_clean),
    ("near_duplicates", keep_one),
    ("decontamination", keep_unleaked),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: No SQL expresses the stages; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
