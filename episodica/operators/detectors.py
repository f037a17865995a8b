"""Healthy-only scorers as DataFrame expressions over long features (``episode``, ``feature``, ``value``).

A run is a (seed, commissioning size).  Its statistics are as many rows as the study's grid has runs times features,
which the caller states; up to ``BROADCAST_ROWS`` they are broadcast, beyond that the optimizer chooses the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import median
from .order import quantiles

#: Rows of a side up to which it is broadcast; 200,000 rows of statistics are some 10 MB.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` with a broadcast hint if its stated bound of rows allows one; a plain join otherwise."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def run_statistics(features: DataFrame, membership: DataFrame, episode: str, runs: list[str]) -> DataFrame:
    """Mean, population deviation, median and MAD of each feature over each run's commissioning episodes."""
    values = membership.select(*runs, episode).join(features, episode)
    cell = [*runs, "feature"]
    centered = values.withColumn("center", median("value").over(Window.partitionBy(*cell)))
    return centered.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.first("center").alias("center"), median(F.abs(F.col("value") - F.col("center"))).alias("mad"))


def diagonal_scores(features: DataFrame, statistics: DataFrame, episode: str, runs: list[str], cells: int | None = None, clip: float = 3.0) -> DataFrame:
    """``detector``, run keys, ``episode``, ``score`` of both diagonal detectors from one pass over the features.

    Diagonal: root of the summed squared z of the features that vary.  RobustDiagonal: the same with median and
    1.4826 MAD, each z clipped.  ``cells`` is the stated bound of rows of ``statistics``.
    """
    plain = (F.col("value") - F.col("mean")) / F.col("std")
    robust = F.least(F.greatest((F.col("value") - F.col("center")) / (F.col("mad") * 1.4826), F.lit(-clip)), F.lit(clip))
    root = lambda z, scale: F.round(F.sqrt(F.sum(F.when(scale > 1e-12, z * z))), 4)
    sums = features.join(bounded(statistics, cells), "feature").groupBy(*runs, episode).agg(root(plain, F.col("std")).alias("Diagonal"), root(robust, F.col("mad") * 1.4826).alias("RobustDiagonal"))
    return sums.unpivot([*runs, episode], ["Diagonal", "RobustDiagonal"], "detector", "score").where("score is not null")


def top_variance_features(features: DataFrame, k: int) -> DataFrame:
    """The k features of largest population variance, ties by name."""
    variance = features.groupBy("feature").agg(F.var_pop("value").alias("variance"))
    return variance.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance"), "feature"))).where(F.col("rank") <= k)


#: Vectors in one block of queries and of the reference; a task compares two blocks.
QUERY_BLOCK, REFERENCE_BLOCK = 1024, 8192
#: Queries that are compared with a block in one numpy step.
STEP_QUERIES = 256


def nearest(queries: DataFrame, reference: DataFrame, entity: str, vector: str, k: int) -> DataFrame:
    """``entity`` and ``near``: the k nearest reference rows as (distance, id), by distance and then by id.

    Queries are a stated set: each block of them meets each block of the reference in a task of its own, which keeps
    the k nearest of each query; these are merged by query.
    """
    q, r = (max(1, -(-n // size)) for n, size in ((queries.count(), QUERY_BLOCK), (reference.count(), REFERENCE_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64(entity, vector), F.lit(n)).cast("int")
    vectors = F.col(vector).cast("array<double>").alias("v")
    asked = queries.select(block(q).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"), F.lit(True).alias("asks"), F.col(entity).alias("entity"), vectors)
    known = reference.select(F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("q"), block(r).alias("r"), F.lit(False).alias("asks"), F.col(entity).alias("entity"), vectors)
    kind = dict(queries.dtypes)[entity]

    def least(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        rows = np.array(table.column("v").to_pylist(), float).reshape(len(asks), -1)
        ids = table.column("entity").to_numpy()
        x, y, names = rows[asks], rows[~asks], ids[~asks]
        order = np.argsort(names, kind="stable")
        y, names = y[order], names[order]
        near = []
        for at in range(0, len(x), STEP_QUERIES):
            part = x[at : at + STEP_QUERIES]
            square = (part**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * part @ y.T
            few = min(2 * k, len(y))
            taken = np.argpartition(square, few - 1, axis=1)[:, :few] if few else np.zeros((len(part), 0), int)
            for v, those in zip(part, taken, strict=True):
                # The few that are kept are measured again without cancellation.
                those = np.sort(those)
                d = np.sqrt(((v - y[those]) ** 2).sum(axis=1))
                best = np.argsort(d, kind="stable")[:k]
                near.append([{"distance": float(d[j]), "id": names[those[j]].item()} for j in best])
        kept = pa.list_(pa.struct([("distance", pa.float64()), ("id", table.schema.field("entity").type)]))
        return pa.table({"entity": table.column("entity").filter(pa.array(asks)), "near": pa.array(near, kept)})

    found = asked.unionByName(known).groupBy("q", "r").applyInArrow(least, f"entity {kind}, near array<struct<distance: double, id: {kind}>>")
    merged = found.groupBy("entity").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    return merged.select(F.col("entity").alias(entity), F.slice("near", 1, k).alias("near"))


def nearest_distances(queries: DataFrame, reference: DataFrame, entity: str, vector: str, k: int) -> DataFrame:
    """``entity``, ``score``: the distance to the k-th nearest reference vector (k at most their number)."""
    return nearest(queries, reference, entity, vector, k).select(entity, F.get(F.col("near")["distance"], F.size("near") - 1).alias("score"))


def robust_forensics(features: DataFrame, reference: DataFrame, episode: str, k: int, cells: int | None = None) -> DataFrame:
    """The k features of each episode with the largest robust z against the reference episodes.

    ``cells`` is the stated bound of the number of features.
    """
    center = quantiles(reference, ["feature"], "value", {"center": 0.5})
    apart = reference.join(bounded(center, cells), "feature").withColumn("apart", F.abs(F.col("value") - F.col("center")))
    scale = quantiles(apart, ["feature"], "apart", {"mad": 0.5}).join(center, "feature")
    z = F.when(F.col("mad") > 1e-12, 0.67448975 * (F.col("value") - F.col("center")) / F.col("mad")).otherwise(0.0)
    scored = features.join(bounded(scale, cells), "feature").withColumn("robust_z", z)
    place = F.row_number().over(Window.partitionBy(episode).orderBy(F.desc(F.abs("robust_z")), "feature"))
    return scored.withColumn("place", place).where(F.col("place") <= k).select(episode, "place", "feature", "value", "robust_z")
