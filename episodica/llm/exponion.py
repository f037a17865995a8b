"""Centroid clustering by exponion search (Newling and Fleuret, 2016), exact in integers.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to any other.
A round moves the bounds by what the centroids moved.  A vector whose upper bound stays under the lower one, or under
half the gap between its centroid and the next one, keeps its centroid unread.  The others tighten the upper bound, and
those that still fail look only at the centroids inside the ball around their own one with radius twice the upper bound
plus that gap, taken from a list sorted by distance up to the next power of two.  The ball is closed and the tests are
strict, so ties, which go to the smaller number, are always seen.  Bounds are rounded outwards, distances are integers.

Blocks of vectors are the table's rows, with the bounds and the sums of each cluster beside them.  A round reads the
blocks once and writes the next ones to the shared folder (2 bytes a component where they fit, 20 for the bounds), then
adds up the sums, of which the driver gets one row for each cluster and component; the round before is deleted.  No
vector is shuffled in any round, no group is collected, and a lost executor costs its tasks of one round.

Defined cases: vectors that are null, of another length or with null or non-finite components have no result, nor has an
empty table; null ids hash as the empty text; repeated rows count each, and equal hashes go by the components; with
fewer vectors than clusters there are as many clusters as vectors; clusters that become empty stay where they are;
components over 65536 are an error; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import durable, forget

#: Share by which bounds are rounded outwards; over a thousand rounds, rounding errors stay far below it.
SLACK = 2.0**-36


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + SLACK


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - SLACK) - SLACK, 0.0)


@dataclass(frozen=True)
class Geometry:
    """What a round knows of its centroids: how far each moved, and for each the others sorted by their gap."""

    centroids: np.ndarray
    moves: np.ndarray
    others: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None = None) -> Geometry:
        k = len(centroids)
        gaps = np.sqrt(V.squared(centroids, centroids).astype(np.float64))
        np.fill_diagonal(gaps, -1.0)
        others = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        before = centroids if before is None else before
        moves = _up(np.sqrt(V.own_squared(centroids, before, np.arange(k)).astype(np.float64)))
        return cls(centroids, np.where((centroids == before).all(axis=1), 0.0, moves), others, np.take_along_axis(gaps, others, axis=1))


def _two_nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of exact squared distances: the place of each row's smallest, its root rounded up, and the next one's rounded down."""
    best = d.argmin(axis=1)[:, None]
    upper = _up(np.sqrt(np.take_along_axis(d, best, axis=1)[:, 0].astype(np.float64)))
    rest = np.full(d.shape, np.inf)
    np.copyto(rest, d)
    np.put_along_axis(rest, best, np.inf, axis=1)
    return best[:, 0], upper, _down(np.sqrt(rest.min(axis=1)))


def assign(x: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Label and bounds of each row after the centroids moved, and the number of distances taken."""
    k = len(at.centroids)
    if k == 1:
        return np.zeros_like(label), upper + at.moves[0], lower, 0
    label, upper = label.copy(), upper + at.moves[label]
    furthest = np.argsort(at.moves)
    lower = np.maximum(lower - np.where(label == furthest[-1], at.moves[furthest[-2]], at.moves[furthest[-1]]), 0.0)
    safe = np.maximum(lower, _down(at.gaps[:, 0] / 2)[label])
    open_ = np.flatnonzero(upper >= safe)
    upper[open_] = _up(np.sqrt(V.own_squared(x[open_], at.centroids, label[open_]).astype(np.float64)))
    taken = len(open_)
    open_ = open_[upper[open_] >= safe[open_]]
    own = label[open_]
    radius = _up(2 * upper[open_] + at.gaps[own, 0])
    for a in np.unique(own):
        rows, r = open_[own == a], radius[own == a]
        count = np.searchsorted(_down(at.gaps[a]), r, side="right")
        ring = np.minimum(1 << np.ceil(np.log2(count)).astype(int), k - 1)
        for m in np.unique(ring):
            mine = rows[ring == m]
            near = np.sort(np.append(at.others[a, :m], a))
            d = V.squared(x[mine], at.centroids[near])
            taken += d.size
            best, upper[mine], lower[mine] = _two_nearest(d)
            label[mine] = near[best]
    return label, upper, lower, taken


def first_assignment(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Labels and bounds from the distances of all rows from all centroids."""
    return *_two_nearest(V.squared(x, centroids)), len(x) * len(centroids)


_BLOCK = "ids array<{id}>, points binary, kind string, label binary, upper binary, lower binary, distance binary, sums binary, taken long"
_NAMES = ["ids", "points", "kind", "label", "upper", "lower", "distance", "sums", "taken"]


def _packed(ids: pa.Array, x: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray, taken: int, centroids: np.ndarray) -> pa.RecordBatch:
    """One block as a row; sums hold each cluster's components, squared distances and number."""
    distance = V.own_squared(x, centroids, label)
    sums = V.sums_by(label, np.column_stack([x, distance]), len(centroids))
    values = [x.tobytes(), x.dtype.str, label.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), distance.tobytes(), sums.tobytes(), taken]
    offsets = pa.array([0, len(ids)], pa.int32())
    kinds = [pa.binary(), pa.string(), *[pa.binary()] * 5, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, ids), *(pa.array([v], t) for v, t in zip(values, kinds, strict=True))], names=_NAMES)


def _unpacked(batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        raw = {c: batch.column(c)[i] for c in _NAMES}
        number = lambda c, kind, raw=raw: np.frombuffer(raw[c].as_buffer(), kind)
        yield raw["ids"].values, number("points", raw["kind"].as_py()).reshape(-1, length), number("label", np.int32).astype(np.int64), number("upper", float), number("lower", float), number("distance", np.int64)


def _totals(blocks: DataFrame, k: int, width: int) -> np.ndarray:
    """Sums of all blocks: only that column is read, each task adds up its own blocks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width), np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.frombuffer(value.as_buffer(), np.int64).reshape(k, width)
        yield V.sum_rows(total)

    return V.collected_sums(blocks.select("sums").mapInArrow(add, V.SUMS), (k, width))


@dataclass(frozen=True)
class Clustering:
    """The last assignment's blocks, the final centroids, and for each cluster its rows and squared distances."""

    blocks: DataFrame
    centroids: np.ndarray
    counts: list[int]
    inertia: list[int]

    def taken(self) -> int:
        """Distances that the last assignment took."""
        return self.blocks.agg(F.sum("taken")).first()[0]


def start(vectors: DataFrame, vec_id: str, vector: str, length: int, k: int, salt: str = "3") -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, in that order; vectors may have been dropped before."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(vec_id).cast("string"), F.lit("")))
    top = vectors.select(F.sha2(text, 256).alias("hash"), F.col(vector).alias("vector")).orderBy("hash", "vector").limit(k).collect()
    return np.floor(np.array([r["vector"] for r in top], np.float64).reshape(-1, length) * V.SCALE).astype(np.int64)


def cluster(vectors: DataFrame, vec_id: str, vector: str, length: int = 64, k: int = 8, rounds: int = 10, salt: str = "3", block: int = V.BLOCK) -> Clustering | None:
    """Lloyd's iteration from hashed starting vectors; None without vectors."""
    kept = vectors.where((F.size(vector) == length) & V.usable(F.col(vector))).select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    centroids = start(kept, "id", "vector", length, k, salt)
    k = len(centroids)
    if not k:
        return None
    schema = _BLOCK.format(id=dict(kept.dtypes)["id"])

    def begin(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for part in V.in_blocks(batches, block):
            x = V.narrow(V.integers(part.column("vector"), length))
            yield _packed(part.column("id"), x, *first_assignment(x, centroids), centroids)

    blocks = durable(kept.mapInArrow(begin, schema), "blocks", V.FILE_BLOCKS)
    for _ in range(rounds):
        totals = _totals(blocks, k, length + 2)
        after = V.moved(centroids, np.delete(totals, length, axis=1))
        at = Geometry.of(after, centroids)

        def again(batches: Iterator[pa.RecordBatch], at: Geometry = at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x, label, upper, lower, _ in _unpacked(batch, length):
                    yield _packed(ids, x, *assign(x, label, upper, lower, at), at.centroids)

        before, blocks, centroids = blocks, durable(blocks.mapInArrow(again, schema), "blocks", V.FILE_BLOCKS), after
        forget(before)
    totals = _totals(blocks, k, length + 2)
    return Clustering(blocks, centroids, totals[:, -1].tolist(), totals[:, length].tolist())


def members(found: Clustering) -> DataFrame:
    """``id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of each vector."""
    kind = found.blocks.schema["ids"].dataType.elementType.simpleString()
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    length, inertia = found.centroids.shape[1], found.inertia

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, label, _, _, distance in _unpacked(batch, length):
                columns = [ids, pa.array(label.astype(np.int32)), pa.array(distance), pa.array(np.array(inertia)[label]), pa.array(np.full(len(label), sum(inertia))), pa.array(np.array(hashes)[label])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return found.blocks.mapInArrow(rows, f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
