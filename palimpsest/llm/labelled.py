"""Bounded samples of labelled documents for training, and fitting in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are fitted on: those with the smallest hash of their id.
MAX_TRAIN = 16_000
#: Longer ones are scored but not fitted on, so that what one task gathers is bounded.
MAX_CHARS = 200_000


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int = MAX_TRAIN) -> DataFrame:
    """(rank, y, text) of the labelled documents outside the held-out fold, at most ``limit``.

    Labels without a value are not used; if an id has several, the largest counts; of rows with equal ids the
    smallest text is used. Texts of more than ``MAX_CHARS`` characters are left out.
    """
    clean = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(modulus) != held_out))
    one = clean.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("rank", F.xxhash64(F.col("doc_id").cast("string")))
    chosen = one.orderBy("rank", "doc_id").limit(limit)
    # bounded by ``limit`` rows of three numbers
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= MAX_CHARS).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("rank", "y", "doc_id").agg(F.min("text").alias("text")).select("rank", "y", "text")


def fit_in_one_task(examples: DataFrame, train: Callable[[list[pa.RecordBatch]], object]) -> object:
    """Gather a bounded number of encoded examples in one task, fit there, and return the model (a few MB at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(list(batches))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = examples.coalesce(1) if examples.rdd.getNumPartitions() == 1 else examples.repartition(1)
    return pickle.loads(rows.mapInArrow(run, "model binary").first()["model"])
