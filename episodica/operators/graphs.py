"""Sparse precision graphs over moments: stability under subsampling, nulls, differences of domains, lending from a source.

Rows are read for moments only.  Each fit (a resample and a penalty, or one column of a constrained problem) is a row that
tasks share out; what they return is an edge table, ``a`` < ``b`` with the partial correlation and whether there is an
edge, and everything after that is joins, groups and windows over edges: a row for each pair of features at most.
Random choices are hashes of what is chosen, so that they can be repeated anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.lineage import cut
from .moments import FOLDS, PRIME, Moments, _frame, _types, collected, fold_of, moments, resample_hash
from .order import cumulated

#: An entry of a precision above this is an edge; an edge as likely as this is stable, a penalty as variable as that too dense.
EDGE, STABLE, INSTABILITY = 1e-3, 0.7, 0.05
#: Shared edges whose partial correlations differ by this much are different.
CHANGED = 0.10
SHARE, RESAMPLES = 0.8, 24


def subsample_counts(share: float):
    """Counts that take each row into a resample with the chance ``share``."""
    return lambda entities, replicates, seed: (resample_hash(entities.astype(np.int64)[:, None], np.arange(1, replicates + 1)[None, :] + seed * 1009) < share * PRIME).astype(float)


def edge_table(found: DataFrame, keys: list[str], penalties: tuple[float, ...], least_rows: int = 3) -> DataFrame:
    """``keys``, ``penalty``, ``a``, ``b``, ``partial``, ``edge`` of each pair of features in each group's graphical lasso.

    ``found`` has ``keys`` and packed ``moments``; groups of fewer than ``least_rows`` rows have no graph, and features that
    do not vary no edges.  Every group and penalty is a fit of its own.
    """
    kinds = [found.schema[k].dataType for k in keys]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for *key, data, penalty in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = Moments.unpacked(data)
                if m.n < least_rows:
                    continue
                cov = m.covariance()
                sd = np.sqrt(np.diag(cov))
                varies = sd > 1e-12
                scale = np.where(varies, sd, 1.0)
                corr = np.where(np.outer(varies, varies), cov / np.outer(scale, scale), 0.0)
                np.fill_diagonal(corr, 1.0)
                precision = L.sparse_precision(corr, penalty, 300, tolerance=1e-5)
                a, b = np.triu_indices(len(cov), 1)
                d = np.sqrt(np.maximum(np.diag(precision), 1e-12))
                partial, edge = -precision[a, b] / (d[a] * d[b]), np.abs(precision[a, b]) > EDGE
                columns = [*(pa.array([k] * len(a), to_arrow_type(t)) for k, t in zip(key, kinds, strict=True)), pa.array([penalty] * len(a)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(partial), pa.array(edge)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "penalty", "a", "b", "partial", "edge"])

    fits = found.select(*keys, "moments", F.explode(F.array(*[F.lit(float(p)) for p in penalties])).alias("penalty"))
    return fits.repartition(*keys, "penalty").mapInArrow(fit, f"{_types(found, keys)}, penalty double, a int, b int, partial double, edge boolean")


def edge_stability(rows: DataFrame, runs: list[str], penalties: tuple[float, ...], replicates: int = RESAMPLES, share: float = SHARE, seed: int = 42) -> DataFrame:
    """``probability`` of each pair's edge over subsamples at each penalty, and the whole group's ``partial`` and ``edge``."""
    found = moments(rows, runs, replicates=replicates, entity="episode", seed=seed, counts=subsample_counts(share))
    edges = edge_table(found, [*runs, "replicate"], penalties)
    drawn = F.col("replicate") > 0
    whole = lambda c: F.max(F.when(~drawn, F.col(c)))
    return edges.groupBy(*runs, "penalty", "a", "b").agg(F.avg(F.when(drawn, F.col("edge").cast("double"))).alias("probability"), whole("partial").alias("partial"), whole("edge").alias("edge"))


def penalty_profile(stability: DataFrame, runs: list[str], most: float = INSTABILITY, least: float = STABLE) -> DataFrame:
    """``stable_edges``, ``density``, ``instability`` of each penalty, what is ``chosen``, and its ``neighbour``s on the grid.

    The largest penalty with a stable edge and at most ``most`` instability; without one the least unstable that has a
    stable edge; without any the largest.
    """
    p, stable = F.col("probability"), F.col("probability") >= least
    found = stability.groupBy(*runs, "penalty").agg(F.avg(2 * p * (1 - p)).alias("instability"), F.count_if(stable).alias("stable_edges"), F.avg(stable.cast("double")).alias("density"))
    some = F.col("stable_edges") > 0
    tier = F.when(some & (F.col("instability") <= most), 0).when(some, 1).otherwise(2)
    ranked = found.withColumn("tier", tier).withColumn("unstable", F.when(F.col("tier") == 1, F.col("instability")).otherwise(0.0))
    grid = Window.partitionBy(*runs)
    first = F.row_number().over(grid.orderBy("tier", "unstable", F.desc("penalty"))) == 1
    marked = ranked.withColumn("chosen", first)
    beside = F.coalesce(F.lag("chosen").over(grid.orderBy("penalty")), F.lit(False)) | F.coalesce(F.lead("chosen").over(grid.orderBy("penalty")), F.lit(False))
    return marked.select(*runs, "penalty", "instability", "stable_edges", "density", "chosen", beside.alias("neighbour"))


def chosen_edges(stability: DataFrame, profile: DataFrame, runs: list[str], least: float = STABLE) -> DataFrame:
    """``a``, ``b``, ``probability``, ``partial`` and ``stable`` of all pairs at each run's chosen penalty."""
    at = profile.where("chosen").select(*runs, "penalty")
    return stability.join(at, [*runs, "penalty"]).select(*runs, "a", "b", "probability", "partial", (F.col("probability") >= least).alias("stable"))


def _paired(source: DataFrame, target: DataFrame, runs: list[str]) -> DataFrame:
    """Both graphs' rows of each pair of features, those that one side lacks included."""
    of = lambda df, mark: df.select(*runs, "a", "b", *[F.col(c).alias(f"{mark}_{c}") for c in ("probability", "partial", "stable")])
    both = of(source, "source").join(of(target, "target"), [*runs, "a", "b"], "full_outer")
    return both.na.fill({f"{m}_{c}": v for m in ("source", "target") for c, v in (("probability", 0.0), ("partial", 0.0), ("stable", False))})


def differential_edges(source: DataFrame, target: DataFrame, runs: list[str], changed: float = CHANGED) -> DataFrame:
    """Edges that are stable in one graph only (``support``), or in both with another partial correlation (``weight``)."""
    both = _paired(source, target, runs)
    kind = F.when(F.col("source_stable") != F.col("target_stable"), "support").when(F.col("source_stable") & F.col("target_stable") & (F.abs(F.col("target_partial") - F.col("source_partial")) >= changed), "weight")
    return both.withColumn("kind", kind).where("kind is not null")


def overlap(source: DataFrame, target: DataFrame, runs: list[str], changed: float = CHANGED) -> DataFrame:
    """Counts of stable, shared and differential edges, Jaccard and weighted overlap, agreement of partial correlations."""
    s, t = F.col("source_stable"), F.col("target_stable")
    shared, gap = s & t, F.abs(F.col("target_partial") - F.col("source_partial"))
    union = F.count_if(s | t)
    different = F.count_if((s != t) | (shared & (gap >= changed)))
    return _paired(source, target, runs).groupBy(*runs).agg(
        F.count_if(s).alias("source_edges"), F.count_if(t).alias("target_edges"), F.count_if(shared).alias("shared_edges"), different.alias("differential_edges"),
        F.when(union > 0, F.count_if(shared) / union).otherwise(1.0).alias("jaccard"), F.when(union > 0, different / union).otherwise(0.0).alias("differential_ratio"),
        (F.sum(F.least("source_probability", "target_probability")) / (F.sum(F.greatest("source_probability", "target_probability")) + 1e-12)).alias("weighted_overlap"),
        F.avg(F.when(shared, (F.signum("source_partial") == F.signum("target_partial")).cast("double"))).alias("sign_agreement"), F.percentile(F.when(shared, gap), 0.5).alias("median_partial_gap"),
    )


# -- nulls of the overlap, over the edge tables --------------------------------------------------------------------------


def _drawn(*parts: Column) -> Column:
    """What orders a random choice: the same for the same parts in every engine."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def _replicated(df: DataFrame, replicates: int) -> DataFrame:
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))


def _jaccards(draws: DataFrame, runs: list[str]) -> DataFrame:
    s, t = F.col("in_source"), F.col("in_target")
    return draws.groupBy(*runs, "replicate").agg(F.when(F.count_if(s | t) > 0, F.count_if(s & t) / F.count_if(s | t)).otherwise(1.0).alias("jaccard"))


def density_null(source: DataFrame, target: DataFrame, runs: list[str], replicates: int) -> DataFrame:
    """``jaccard`` of two random graphs with as many edges as the source and the target have, in each replicate."""
    both = _replicated(_paired(source, target, runs).withColumn("n_source", F.sum(F.col("source_stable").cast("int")).over(Window.partitionBy(*runs))).withColumn("n_target", F.sum(F.col("target_stable").cast("int")).over(Window.partitionBy(*runs))), replicates)
    place = lambda mark: F.row_number().over(Window.partitionBy(*runs, "replicate").orderBy(_drawn(F.col("a"), F.col("b"), F.col("replicate"), F.lit(mark))))
    drawn = both.select(*runs, "replicate", (place("s") <= F.col("n_source")).alias("in_source"), (place("t") <= F.col("n_target")).alias("in_target"))
    return _jaccards(drawn, runs)


def identity_null(source: DataFrame, target: DataFrame, runs: list[str], replicates: int) -> DataFrame:
    """``jaccard`` of the source's graph and the target's with its features renamed at random, in each replicate."""
    both = cut(_paired(source, target, runs))
    features = both.select(*runs, F.explode(F.array("a", "b")).alias("feature")).distinct()
    order = Window.partitionBy(*runs, "replicate").orderBy("feature")
    shuffled = Window.partitionBy(*runs, "replicate").orderBy(_drawn(F.col("feature"), F.col("replicate"), F.lit("f")))
    numbered = _replicated(features, replicates).select(*runs, "replicate", "feature", F.row_number().over(order).alias("in_order"), F.row_number().over(shuffled).alias("in_shuffle"))
    names = numbered.select(*runs, "replicate", F.col("feature"), "in_order").join(numbered.select(*runs, "replicate", F.col("feature").alias("renamed"), F.col("in_shuffle").alias("in_order")), [*runs, "replicate", "in_order"]).drop("in_order")
    one = lambda c, new: names.select(*runs, "replicate", F.col("feature").alias(c), F.col("renamed").alias(new))
    moved = both.where("target_stable").join(one("a", "x"), [*runs, "a"]).join(one("b", "y"), [*runs, "replicate", "b"])
    moved = moved.select(*runs, "replicate", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(True).alias("in_target"))
    pairs = _replicated(both, replicates).select(*runs, "replicate", "a", "b", F.col("source_stable").alias("in_source"))
    return _jaccards(pairs.join(moved, [*runs, "replicate", "a", "b"], "left").na.fill(False, ["in_target"]), runs)


def null_summary(observed: DataFrame, null: DataFrame, runs: list[str]) -> DataFrame:
    """The observed Jaccard beside its null: mean, deviation, 0.95 quantile, empirical p-value and effect size."""
    joined = null.join(observed.select(*runs, F.col("jaccard").alias("observed")), runs)
    out = joined.groupBy(*runs).agg(F.max("observed").alias("observed"), F.avg("jaccard").alias("null_mean"), F.stddev_samp("jaccard").alias("null_std"), F.percentile("jaccard", 0.95).alias("null_q95"), ((1 + F.count_if(F.col("jaccard") >= F.col("observed"))) / (F.count(F.lit(1)) + 1)).alias("empirical_p"))
    return out.withColumn("effect_size", (F.col("observed") - F.col("null_mean")) / (F.col("null_std") + 1e-12))


# -- p-values of edges ---------------------------------------------------------------------------------------------------


def permuted_rows(rows: DataFrame, runs: list[str], replicates: int, vector: str = "v") -> DataFrame:
    """``runs``, ``replicate``, ``episode`` and ``v`` with each feature's values in an order of its own.

    A value's new row is the rank of its hash among those of its feature, so that runs of any size are permuted in ranges.
    """
    long = rows.select(*runs, "episode", F.posexplode(vector).alias("place", "x"))
    keys = [*runs, "replicate", "place"]
    hashed = cut(_replicated(long, replicates).withColumn("h", F.xxhash64("episode", "replicate", "place")))
    ranks = cumulated(hashed, keys, "h").select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("value_at").alias("at_h"), F.col("rows_below").alias("row"))
    moved = hashed.join(ranks, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys] + [F.col("h") == F.col("at_h")])
    lists = moved.groupBy(*runs, "replicate", F.col("row").alias("episode")).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("cells"))
    return lists.select(*runs, "replicate", "episode", F.transform("cells", lambda c: c["x"]).alias("v"))


def edge_p_values(rows: DataFrame, runs: list[str], penalty: float, replicates: int) -> DataFrame:
    """``partial`` and empirical ``p_value`` of each pair of features against graphs of rows whose features are permuted."""
    found = edge_table(moments(rows, runs), runs, (penalty,)).select(*runs, "a", "b", "partial", "edge")
    null = edge_table(moments(permuted_rows(rows, runs, replicates), [*runs, "replicate"]), [*runs, "replicate"], (penalty,)).select(*runs, "a", "b", F.col("partial").alias("null_partial"))
    larger = F.count_if(F.abs("null_partial") >= F.abs("partial") - 1e-12)
    return null.join(found, [*runs, "a", "b"]).groupBy(*runs, "a", "b", "partial", "edge").agg(((1 + larger) / (F.count(F.lit(1)) + 1)).alias("p_value"))


# -- lending a sparse precision from a source ------------------------------------------------------------------------------


def constrained_columns(sigma: np.ndarray, right: np.ndarray, bound: float, rounds: int = 20_000, tolerance: float = 1e-9) -> np.ndarray:
    """For each column b of ``right`` the vector x of least absolute sum with every entry of sigma x - b within ``bound``.

    Alternating directions on the pair (x, sigma x), over-relaxed.
    """
    p = len(sigma)
    inverse = np.linalg.inv(np.eye(p) + sigma @ sigma)
    w, z = np.zeros_like(right), np.zeros_like(right)
    u, v = np.zeros_like(right), np.zeros_like(right)
    for _ in range(rounds):
        x = inverse @ (w - u + sigma @ (z - v))
        product = sigma @ x
        x, product = 1.6 * x - 0.6 * w, 1.6 * product - 0.6 * z
        w_new = np.sign(x + u) * np.maximum(np.abs(x + u) - 0.1, 0)
        z_new = right + np.clip(product + v - right, -bound, bound)
        u, v = u + x - w_new, v + product - z_new
        done = max(np.abs(w_new - w).max(), np.abs(z_new - z).max(), np.abs(sigma @ w_new - z_new).max()) < tolerance
        w, z = w_new, z_new
        if done:
            break
    return w


#: Above this violation of its constraint a column has no solution.
SOLVED = 1e-4


def _scaled_columns(cov: np.ndarray, right: np.ndarray, columns: np.ndarray, bound: float) -> tuple[np.ndarray, float, int]:
    """Constrained columns in correlation scale, each rescaled so that its own equation holds.

    Columns without a solution are 0; also the largest violation of the others, and how many have none.
    """
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = cov / np.outer(sd, sd)
    x = constrained_columns(corr, right[:, columns], bound)
    violation = np.maximum(np.abs(corr @ x - right[:, columns]).max(axis=0) - bound, 0.0)
    solved = violation <= SOLVED
    x = np.where(solved, x / np.outer(sd, sd[columns]), 0.0)
    for k, j in enumerate(columns):
        reached, wanted = float(cov[j] @ x[:, k]), float(right[j, j])
        if abs(reached) > 1e-12 and abs(wanted) > 1e-12:
            x[:, k] *= wanted / reached
    return x, float(violation[solved].max(initial=0.0)), int((~solved).sum())


def _solved(spark, problems: dict[tuple, tuple[np.ndarray, np.ndarray, float]], columns_at_once: int) -> tuple[dict[tuple, np.ndarray], dict[tuple, tuple[float, int]]]:
    """All columns of all problems (covariance, right side, bound), some columns to a task; violations and unsolved columns."""
    shared = spark.sparkContext.broadcast(list(problems.values()))
    keys = list(problems)
    todo = [(i, c) for i, (cov, _, _) in enumerate(problems.values()) for c in range(0, len(cov), columns_at_once)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cov, right, bound = shared.value[i]
                columns = np.arange(c, min(c + columns_at_once, len(cov)))
                x, violation, unsolved = _scaled_columns(cov, right, columns, bound)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([c], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([violation]), pa.array([unsolved], pa.int32())], names=["problem", "first", "x", "violation", "unsolved"])

    found = spark.createDataFrame(todo, "problem int, first int").repartition(max(1, min(len(todo), 4096)), "problem", "first").mapInArrow(solve, "problem int, first int, x binary, violation double, unsolved int")
    out, worst = {k: np.zeros_like(problems[k][0]) for k in keys}, dict.fromkeys(keys, (0.0, 0))
    for r in found.collect():  # a run's matrices, whose moments the driver has already
        x = np.frombuffer(bytes(r["x"])).reshape(len(out[keys[r["problem"]]]), -1)
        out[keys[r["problem"]]][:, r["first"] : r["first"] + x.shape[1]] = x
        violation, unsolved = worst[keys[r["problem"]]]
        worst[keys[r["problem"]]] = max(violation, r["violation"]), unsolved + r["unsolved"]
    return out, worst


def lent_precisions(rows: DataFrame, runs: list[str], bound: float, lending: float = 1.0, folds: int = FOLDS, floor: float = 1e-6, seed: int = 42, columns_at_once: int = 8) -> dict[tuple, dict]:
    """Cross-fitted sparse precisions of each run's target, column by column from the target alone or through the source.

    On the rows outside a fold, constrained columns of the target's covariance give a first precision; what the source's
    covariance leaves of the identity under it, cut to what exceeds the noise, corrects the right side of the source's own
    problem.  The fold's rows choose for each column between the two by their quadratic risk.  The folds' choices are
    averaged, made symmetric and projected to eigenvalues of at least ``floor``.

    A run's result has ``precision``, ``raw``, ``lent`` (the share of columns through the source), ``violation`` (of a
    solved column's constraint), ``unsolved`` (columns without a solution, which count as 0), ``least_eigenvalue`` before the projection and ``change`` by it.
    """
    spark = rows.sparkSession
    source = collected(moments(rows.where("role = 'source'"), runs), runs)
    parts = collected(moments(fold_of(rows.where("role = 'target'"), runs, "episode", folds, seed), [*runs, "fold"]), [*runs, "fold"])
    splits = {}
    for k, s in source.items():
        own = {f: m for f in range(folds) if (m := parts.get((*k, f))) is not None}
        for f, held in own.items():
            rest = [m for g, m in own.items() if g != f]
            if held.n >= 2 and sum(m.n for m in rest) >= 2 and s.n >= 2:
                whole = rest[0]
                for m in rest[1:]:
                    whole = whole + m
                splits[*k, f] = (whole, held, s)
    base, worst = _solved(spark, {k: (t.covariance(), np.eye(len(t.center)), bound) for k, (t, _, _) in splits.items()}, columns_at_once)
    second = {}
    for k, (t, _, s) in splits.items():
        p = len(t.center)
        noise = float(np.abs(base[k]).sum(axis=0).mean()) * math.sqrt(math.log(max(p, 2)) / t.n)
        rest = np.eye(p) - base[k].T @ s.covariance()
        # The column of least absolute sum within the noise of ``rest`` is what of it exceeds the noise.
        delta = np.sign(rest) * np.maximum(np.abs(rest) - noise, 0)
        second[k] = (s.covariance(), np.eye(p) - delta.T, 2 * lending * math.sqrt(math.log(max(p, 2)) / s.n))
    transferred, worse = _solved(spark, second, columns_at_once)
    chosen: dict[tuple, list] = {}
    for k, (_, held, _) in splits.items():
        cov = held.covariance() * held.n / (held.n - 1)
        risk = [np.einsum("ij,ik,kj->j", x, cov, x) - 2 * np.diag(x) for x in (base[k], transferred[k])]
        through = risk[1] < risk[0]
        chosen.setdefault(k[:-1], []).append((np.where(through, transferred[k], base[k]), through.mean(), max(worst[k][0], worse[k][0]), worst[k][1] + worse[k][1]))
    out = {}
    for k, found in chosen.items():
        raw = np.mean([x for x, *_ in found], axis=0)
        symmetric = (raw + raw.T) / 2
        projected = L.floored(symmetric, floor)
        out[k] = {
            "precision": projected, "raw": raw, "lent": float(np.mean([share for _, share, *_ in found])), "violation": max(v for _, _, v, _ in found), "unsolved": sum(n for *_, n in found),
            "least_eigenvalue": float(np.linalg.eigvalsh(symmetric).min()), "change": float(np.linalg.norm(projected - symmetric) / max(np.linalg.norm(symmetric), 1e-12)),
        }
    return out


def lent_edges(rows: DataFrame, runs: list[str], bound: float, **options) -> DataFrame:
    """``a``, ``b``, ``partial``, ``edge`` of each run's :func:`lent_precisions`, with what these say of themselves."""
    found = {}
    for k, r in lent_precisions(rows, runs, bound, **options).items():
        p, d = r["precision"], np.sqrt(np.diag(r["precision"]))
        found[k] = [(i, j, float(-p[i, j] / (d[i] * d[j])), bool(abs(p[i, j]) > EDGE), r["lent"], r["violation"], r["unsolved"], r["change"]) for i in range(len(p)) for j in range(i + 1, len(p))]
    return _frame(rows.sparkSession, runs, rows, found, "a int, b int, partial double, edge boolean, lent double, violation double, unsolved int, change double")
