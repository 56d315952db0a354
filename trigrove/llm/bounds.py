"""Whole-number vectors and what two quantisers share: net displacements of entries since earlier rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are kept below this after scaling, so that a squared distance over 64 of them fits a long.
LARGEST = 1 << 27
#: What is added to a comparison of bounds, relative, against rounding: far more than double precision loses.
SLACK = 1e-9


def finite(v: Column, scale: int) -> Column:
    """Whether all components are there and finite, and below LARGEST when scaled."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST))


def scaled(vectors: DataFrame, scale: int, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``q``, the components as floor(scale * x); vectors that are not ``finite`` go."""
    return vectors.where(finite(F.col("embedding"), scale)).select(*keep, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"))


def moved_since(history: np.ndarray) -> np.ndarray:
    """``history[round, ..., entry, component]`` -> the distance of each entry from where it was in each round to where it is in the last.

    This is the norm of the summed moves. It is never more than the sum of the norms of the single moves, by
    which bounds are loosened when only the last round is known.
    """
    net = (history[-1] - history).astype(np.float64)
    return np.sqrt((net * net).sum(axis=-1)) * (1 + SLACK)


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances, in whole numbers."""
    d = points - entry
    return (d * d).sum(axis=-1)


def floor_means(sums: np.ndarray, counts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Means rounded down; entries without points stay."""
    return np.where(counts[..., None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[..., None]), entries)


def matrix(batch: pa.RecordBatch, column: str, dtype) -> np.ndarray:
    """An array column whose rows have one length, as rows of a matrix."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(values), -1)


def lists(values: np.ndarray) -> pa.Array:
    """A matrix as an array column."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1)))


def slot_sums(df: DataFrame, columns: list[str], slots: int, width: int, add) -> tuple[np.ndarray, np.ndarray]:
    """Sums (``slots`` rows of ``width`` numbers) and counts over all rows of ``df``.

    ``add(batch)`` gives slot, vector and count arrays of one batch of ``columns``. They are added up in each batch,
    then by Spark, so that a slot with most rows is one number a batch; ``slots`` rows at most come back.
    """

    def run(batches):
        for batch in batches:
            if len(batch):
                slot, vectors, n = add(batch)
                total, count = np.zeros((slots, width), np.int64), np.zeros(slots, np.int64)
                np.add.at(total, slot, vectors)
                np.add.at(count, slot, n)
                some = np.unique(slot).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(some), lists(total[some]), pa.array(count[some])], names=["slot", "s", "n"])

    sums, counts = np.zeros((slots, width), np.int64), np.zeros(slots, np.int64)
    partial = df.select(columns).mapInArrow(run, "slot long, s array<long>, n long").select("slot", "n", F.posexplode("s").alias("i", "x"))
    for r in partial.groupBy("slot", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        sums[r["slot"], r["i"]], counts[r["slot"]] = r["x"], r["n"]
    return sums, counts
