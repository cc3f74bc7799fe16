"""Quality classifier: supervised subword embeddings.

A document is the average of learnt vectors of its words, of the character 3- and 4-grams inside them, hashed to a fixed
number of rows, and of a mark for each word that repeats the one before; a softmax over it gives the class. Training is stochastic gradient descent in numpy on the driver,
over at most ``SAMPLE_ROWS`` labelled documents, whose features come from the executors. As the output is linear in the
average, scoring folds vectors and output weights into one number for each row, so each task holds one small table.

Defined cases: a null or empty text, having no words, gets the score of the bias alone; without labelled rows of both
classes every score is the share of label 1 (a half if there are none); repeated rows are scored each; a null doc_id is
kept and not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .labelled import held_out, sample
from .shared import ready, slices, tidy

#: The bound of the sample, the table's rows (a power of two), the vectors' length, and the descent.
SAMPLE_ROWS, BUCKETS, LENGTH, EPOCHS, RATE = 3000, 1 << 16, 8, 6, 0.5


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Row and text number of every word and n-gram, and row 0 wherever a word repeats the one before it."""
    data, ends = K.flat(texts)
    starts, stops, doc = K.words(data, ends)
    h = K.word_hashes(data, starts, stops)
    again = doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]
    rows = [(h & np.uint64(buckets - 1)).astype(np.int32), np.zeros(len(again), np.int32)]
    docs = [doc, again]
    for n in (3, 4):
        h, d = K.grams(data, ends, n)
        rows.append((h & np.uint32(buckets - 1)).astype(np.int32))
        docs.append(d)
    return np.concatenate(rows), np.concatenate(docs)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each row, towards label 1
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        row, doc = features(texts, len(self.weights))
        n = np.bincount(doc, minlength=len(texts))
        return np.bincount(doc, weights=self.weights[row], minlength=len(texts)) / np.maximum(n, 1) + self.bias


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, length: int = LENGTH, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Descend over (label, feature rows, their shares of the document)."""
    rng = np.random.default_rng(7)
    share = (sum(r[0] for r in rows) + 0.5) / (len(rows) + 1)
    prior = float(np.log(share / (1 - share)))
    if len({r[0] for r in rows}) < 2:
        return Model(np.zeros(buckets, np.float32), prior)
    vectors = rng.normal(0, 0.1, (buckets, length)).astype(np.float32)
    out = rng.normal(0, 0.1, (2, length)).astype(np.float32)
    bias = np.array([0, prior], dtype=np.float32)
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, idx, part = rows[i]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            mean = part @ vectors[idx] if len(idx) else np.zeros(length, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            pull = p @ out
            out -= now * np.outer(p, mean)
            bias -= now * np.float32(0.1) * p
            if len(idx):  # scaled so that frequent and rare rows move alike
                scale = part / np.maximum(part.max(), 1e-9)
                vectors[idx] -= now * np.outer(scale, pull)
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row, _ = features(batch.column("text").slice(i, 1), buckets)
                idx, n = np.unique(row, return_counts=True)
                out.append((idx.astype("<i4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
            if out:
                idx, part = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(idx, pa.binary()), pa.array(part, pa.binary())], names=["doc_id", "label", "idx", "part"])

    found = sample(docs, labels, label, rows, id_column, text_column).mapInArrow(tidy(run), "doc_id string, label int, idx binary, part binary").toArrow()
    found = found.sort_by("doc_id")
    held = [(y, np.frombuffer(i, "<i4"), np.frombuffer(p, "<f4")) for y, i, p in zip(*(found.column(c).to_pylist() for c in ("label", "idx", "part")), strict=True)]
    return fit(held, buckets)


def score(docs: DataFrame, model, threshold: float, id_column: str = "doc_id", text_column: str = "text", keep: bool = False) -> DataFrame:
    """Score every whole text: the id, score and predicted. ``model``: anything with ``logits(texts)``.

    ``keep``: all columns of ``docs`` stay instead, and the result's two are named ``__score`` and ``__predicted``.
    """
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(model)
    fields = docs.schema.fields if keep else [docs.schema[id_column]]
    names = [f.name for f in fields]
    mark = "__" if keep else ""
    source = docs.select(*[F.col(f"`{n}`") for n in names], F.col(text_column).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                z = np.clip(sent.value.logits(part.column("__text")), -500, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=[*names, mark + "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return source.mapInArrow(tidy(run), f"{kinds}, {mark}score double").withColumn(mark + "predicted", (F.col(mark + "score") >= threshold).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    ready(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, 0.5).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
