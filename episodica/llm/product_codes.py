"""Vector code compression: product codes whose codebooks are trained by the filtering form of Lloyd's iteration.

After Kanungo et al. (2002).  Every partition cuts its vectors' integer components into equal parts and builds, for blocks
of vectors and each part, a kd-tree by median splits of the widest component, whose nodes hold bounding box, sum and
count.  The trees are written to the shared folder once.  A round reads them and sends a node down with the entries that
may be nearest to something in its box: of these, the one nearest to the box's middle beats every other one that is
farther from even the corner of the box that favours it most (or as far, with a higher index).  Where one entry is left,
the whole subtree is its own, by the cached sum and count; leaves compare their points with the entries left.  All of a
level's nodes with the same nearest entry are tested by one matrix product.  Numbers are integers, so sums are exact.

A task returns the sums of its own trees, the driver one row for each entry and component; vectors are shuffled in no
round.  The last assignment takes labels from the same trees.  Sums of errors by label are added up before they are
shuffled, and joined by broadcast only while their file is small.

Defined cases: vectors that are null or hold null or non-finite components have no result, nor has an empty table; null
ids come last when the first entries are chosen; repeated rows count each; with fewer vectors than entries the codebooks
are as short; unused entries stay; null labels are one label.  Vectors must have the table's commonest length (the larger
of equals), which the parts must divide: others cannot be cut into these parts and have no result.  Components over
65536 are an error; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import durable, forget

#: Points that a leaf of a tree holds at most.
LEAF = 16


@dataclass(frozen=True)
class Tree:
    """A kd-tree as arrays over its nodes, parents first; a node's points stand together in ``points``.

    ``first`` is the left child's number, the right one follows; 0 marks a leaf.
    """

    order: np.ndarray
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, leaf: int = LEAF) -> Tree:
        order, spans, first = np.arange(len(x)), [(0, len(x))], []
        low, high = [], []
        for begin, end in spans:  # grows while it is read
            own = x[order[begin:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            wide = high[-1].astype(np.int64) - low[-1]
            if end - begin <= leaf or not wide.any():
                first.append(0)
                continue
            middle = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(own[:, wide.argmax()], middle)]
            first.append(len(spans))
            spans += [(begin, begin + middle), (begin + middle, end)]
        points, spans = x[order], np.array(spans)
        running = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(points.astype(np.int64), axis=0)])
        sums = running[spans[:, 1]] - running[spans[:, 0]]
        return cls(order.astype(np.int32), points, spans[:, 0].astype(np.int32), spans[:, 1].astype(np.int32), np.array(first, np.int32), V.narrow(np.array(low)), V.narrow(np.array(high)), V.narrow(sums))

    def filtered(self, entries: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """Sums and number of each entry's points; ``labels`` gets them in tree order.  Last, the subtrees assigned whole."""
        k, number = len(entries), np.arange(len(entries))
        total = np.zeros((k, entries.shape[1] + 1), np.int64)
        squares = (entries * entries).sum(axis=1)
        nodes, alive, whole = np.zeros(1, np.int64), np.ones((1, k), bool), 0
        while len(nodes):
            low, high = self.low[nodes].astype(np.int64), self.high[nodes].astype(np.int64)
            middle, width = low + high, high - low  # both doubled
            best = np.where(alive, V.squared(middle, 2 * entries).astype(np.float64), np.inf).argmin(axis=1)
            for b in np.unique(best):
                mine = np.flatnonzero(best == b)
                way = entries - entries[b]
                # By how much more the corner that favours an entry most is away from it than from the best one.
                more = (squares - squares[b])[None, :] - _product(middle[mine], way) - _product(width[mine], np.abs(way))
                alive[mine] &= (more < 0) | ((more == 0) & (number <= b))
            one, inner = alive.sum(axis=1) == 1, self.first[nodes] > 0
            for i in np.flatnonzero(one):
                if labels is not None:
                    labels[self.begin[nodes[i]] : self.end[nodes[i]]] = best[i]
            np.add.at(total, best[one], np.column_stack([self.sums[nodes[one]].astype(np.int64), self.end[nodes[one]] - self.begin[nodes[one]]]))
            whole += int((one & inner).sum())
            self._leaves(nodes, alive, best, np.flatnonzero(~one & ~inner), entries, total, labels)
            down = ~one & inner
            nodes, alive = (np.stack([self.first[nodes[down]], self.first[nodes[down]] + 1], axis=1).ravel().astype(np.int64), np.repeat(alive[down], 2, axis=0))
        return total, whole

    def _leaves(self, nodes: np.ndarray, alive: np.ndarray, best: np.ndarray, which: np.ndarray, entries: np.ndarray, total: np.ndarray, labels: np.ndarray | None) -> None:
        """Compare the points of leaves with the entries left to them; leaves with the same best entry share most of these."""
        for b in np.unique(best[which]):
            mine = which[best[which] == b]
            near = np.flatnonzero(alive[mine].any(axis=0))
            begin, size = self.begin[nodes[mine]].astype(np.int64), (self.end[nodes[mine]] - self.begin[nodes[mine]]).astype(np.int64)
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            # An entry that only other leaves of these keep is farther than one that is kept, or as far and later.
            found = near[V.squared(self.points[at], entries[near]).argmin(axis=1)]
            total += V.sums_by(found, self.points[at], len(entries))
            if labels is not None:
                labels[at] = found


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact ``a @ b.T`` of integers: in doubles while those hold it, else in longs."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    return a.astype(np.float64) @ b.T.astype(np.float64) if most < 1 << 53 else a @ b.T


@dataclass(frozen=True)
class Codes:
    """``id``, ``label``, ``codes`` (an index for each part) and ``error`` of each vector, and the final codebooks."""

    rows: DataFrame
    codebooks: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str, vector: str, label: str, parts: int = 4, entries: int = 256, rounds: int = 4, block: int = V.BLOCK) -> Codes | None:
    """Train ``parts`` codebooks of at most ``entries`` entries on all vectors and encode each one; None without vectors."""
    kept = vectors.where(V.usable(F.col(vector))).select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    length = V.commonest_length(kept, "vector")
    if length is None:
        return None
    if length % parts:
        raise ValueError(f"{parts} parts do not divide vectors of {length} components")
    kept = kept.where(F.size("vector") == length)
    kinds = dict(kept.dtypes)
    first = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.floor(np.array([r["vector"] for r in first], np.float64).reshape(len(first), parts, -1) * V.SCALE).astype(np.int64).transpose(1, 0, 2)
    if np.abs(books).max(initial=0) > V.LARGEST:
        raise ValueError(f"a component is larger than {V.LARGEST // V.SCALE}")
    k, width = books.shape[1:]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in V.in_blocks(batches, block):
            x = V.narrow(V.integers(part.column("vector"), length)).reshape(-1, parts, width)
            trees = [Tree.of(x[:, p]) for p in range(parts)]
            offsets = pa.array([0, part.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, part.column(c)) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(trees)], pa.binary())], names=["ids", "labels", "trees"])

    forest = durable(kept.mapInArrow(build, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees binary"), "trees", V.FILE_BLOCKS)
    for _ in range(rounds):

        def assign(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, k, width + 1), np.int64)
            for batch in batches:
                for value in batch.column(0):
                    for p, tree in enumerate(pickle.loads(value.as_buffer())):
                        total[p] += tree.filtered(books[p])[0]
            yield V.sum_rows(total.reshape(parts * k, width + 1))

        sums = V.collected_sums(forest.select("trees").mapInArrow(assign, V.SUMS), (parts * k, width + 1))
        books = V.moved(books.reshape(parts * k, width), sums).reshape(parts, k, width)

    def encode(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c)[i].values for c in ("ids", "labels"))
                codes, error = np.empty((len(ids), parts), np.int32), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(pickle.loads(batch.column("trees")[i].as_buffer())):
                    found = np.empty(len(ids), np.int64)
                    tree.filtered(books[p], found)
                    codes[tree.order, p] = found
                    error[tree.order] += V.own_squared(tree.points, books[p], found)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([ids, labels, lists, pa.array(error)], names=["id", "label", "codes", "error"])

    rows = durable(forest.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long"), "codes")
    forget(forest)
    return Codes(rows, books)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` of :class:`Codes` with ``label_error``, the sum of ``error`` over equal labels, nulls together."""
    sums = durable(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")


def hexadecimal(codes: str):
    """The codes' indexes in order, two hex digits each."""
    return F.lower(F.array_join(F.transform(F.col(codes), lambda c: F.lpad(F.hex(c), 2, "0")), ""))
