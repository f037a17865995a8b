"""Pieces of the vector operators: which vectors count, integer components, blocks of vectors, exact distances and sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component x counts as the integer floor(SCALE * x).
SCALE = 1024
#: The largest size of such an integer, so that squared distances of up to 500 components fit a long.
LARGEST = 1 << 26
#: Vectors that a block holds, and blocks of a file, of which a reader may hold all at once.
BLOCK, FILE_BLOCKS = 16_384, 8


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def integers(column: pa.Array, length: int) -> np.ndarray:
    """The rows' integer components as an (n, length) matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)
    floors = np.floor(values * SCALE)
    if np.abs(floors).max(initial=0) > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST // SCALE}")
    return floors.astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the smallest of the signed types of 2, 4 or 8 bytes that holds it."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def in_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, the last one with what is left."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch, held, n = batch.slice(part.num_rows), [*held, part], n + part.num_rows
            if n == size:
                yield pa.concat_batches(held)
                held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` from all ``centers``, both integers.

    Doubles hold them exactly while they are under 2^53, which all parts of the expanded square then are too.
    """
    most = max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:
        a, c = x.astype(np.float64), centers.astype(np.float64)
        return (a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (a @ c.T)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in centers.astype(np.int64)], axis=1)


def own_squared(x: np.ndarray, centers: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row from the center that ``label`` names."""
    return ((x.astype(np.int64) - centers[label]) ** 2).sum(axis=1)


def sums_by(label: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """For each of ``k`` labels the sums of its rows' components and, last, their number."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    if len(label):
        order = np.argsort(label, kind="stable")
        found, first = np.unique(label[order], return_index=True)
        out[found, :-1] = np.add.reduceat(x[order].astype(np.int64), first, axis=0)
        out[:, -1] = np.bincount(label, minlength=k)
    return out


def sum_rows(total: np.ndarray) -> pa.RecordBatch:
    """``total`` as rows (row, place, value) without zeros, for :func:`collected_sums`."""
    row, place = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(place, pa.int32()), pa.array(total[row, place], pa.int64())], names=["row", "place", "value"])


SUMS = "row int, place int, value long"


def collected_sums(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' :func:`sum_rows`; as many rows come to the driver as ``shape`` says at most."""
    out = np.zeros(shape, np.int64)
    for r in parts.groupBy("row", "place").agg(F.sum("value").alias("value")).collect():
        out[r["row"], r["place"]] = r["value"]
    return out


def moved(centers: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Componentwise floor of sum by count; centers without rows stay."""
    count = sums[:, -1:]
    return np.where(count > 0, sums[:, :-1] // np.maximum(count, 1), centers)


def commonest_length(vectors: DataFrame, vector: str) -> int | None:
    """The length that most vectors have, the larger one of equals; None without vectors."""
    top = vectors.groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return top[0]["length"] if top else None
