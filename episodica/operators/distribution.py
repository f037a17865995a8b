"""Comparisons of distributions, correlation and robust summaries, by group and in SQL operators only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import correlation, median, robust_z
from ..functions.linalg import fisher_exact, ks_exact
from ..functions.lineage import cut
from .order import average_ranks, cumulated, quantiles

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def quantile_block(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Count, mean, deviation, quantiles and largest value of each group, of which there are few and large ones."""
    moments = scores.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.max(value).alias("max"))
    q = quantiles(scores, keys, value, {f"q{round(100 * x):02d}": x for x in QUANTILES})
    return moments.join(q, keys).select(*keys, "n", "mean", "std", *[f"q{round(100 * x):02d}" for x in QUANTILES], "max")


def two_sample(rows: DataFrame, keys: list[str], value: str, second: str, ties: bool = False) -> DataFrame:
    """Kolmogorov-Smirnov distance, Wasserstein distance and Mann-Whitney U of two samples marked by ``second``.

    With ``ties`` also the sum of t^3 - t over the distinct values.

    Both distribution functions come from one running count over the pooled, distinct values.
    """
    steps = rows.groupBy(*keys, F.col(value).alias("x")).agg(F.count_if(F.col(second)).alias("b"), F.count_if(~F.col(second)).alias("a"))
    up = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("x")
    run = steps.select(*keys, "x", "a", "b", F.sum("a").over(up).alias("ca"), F.sum("b").over(up).alias("cb"), F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"), F.lead("x").over(ordered).alias("next"))
    gap = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    # U counts the pairs in which the second sample is larger, ties as half.
    u = F.sum(F.col("b") * (F.col("ca") - F.col("a") / 2.0))
    size = (F.col("a") + F.col("b")).cast("double")
    tied = F.sum(size * size * size - size)
    return run.groupBy(*keys).agg(F.max("na").alias("n_first"), F.max("nb").alias("n_second"), F.max(gap).alias("ks"), F.coalesce(F.sum(gap * (F.col("next") - F.col("x"))), F.lit(0.0)).alias("wasserstein"), u.alias("mann_whitney_u"), *([tied.alias("ties")] if ties else []))


def mann_whitney_p(u: Column, n1: Column, n2: Column, ties: Column | float = 0.0) -> Column:
    """Two-sided p-value by the normal approximation with continuity correction.

    ``ties``: the sum of t^3 - t over the pooled distinct values, each of t rows.
    """
    n = (n1 + n2).cast("double")
    z = (F.abs(u - n1 * n2 / 2.0) - 0.5) / F.sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1))))
    return F.least(F.lit(1.0), _erfc(F.greatest(z, F.lit(0.0)) / F.sqrt(F.lit(2.0))))


def _erfc(x: Column) -> Column:
    """Complementary error function to 1.2e-7 by a rational exponent (the usual Chebyshev fit)."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def ks_p(d: Column, n1: Column, n2: Column, terms: int = 40) -> Column:
    """Asymptotic two-sided p-value of the Kolmogorov-Smirnov distance."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * d
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def robust_scales(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n_rows``, ``center``, ``mad_scale`` and ``iqr_scale`` of each group, of any size.

    The first scale is 1.4826 median absolute deviations, 1 where that vanishes; the second the interquartile range over
    1.349, else the sample deviation, else 1.
    """
    sums = rows.groupBy(*keys).agg(F.count(value).alias("n_rows"), F.stddev_samp(value).alias("std"))
    q = cut(quantiles(rows, keys, value, {"center": 0.5, "low": 0.25, "high": 0.75}))
    named = q.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("center").alias("about"))
    away = rows.join(named, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]).select(*keys, F.abs(F.col(value) - F.col("about")).alias("away"))
    mads = quantiles(away, keys, "away", {"mad": 0.5})
    vary = lambda x: F.when(x > 1e-12, x)
    return sums.join(q, keys).join(mads, keys).select(
        *keys, "n_rows", "center", F.coalesce(vary(1.4826 * F.col("mad")), F.lit(1.0)).alias("mad_scale"), F.coalesce(vary((F.col("high") - F.col("low")) / 1.349), vary(F.col("std")), F.lit(1.0)).alias("iqr_scale")
    )


def blended_scales(target: DataFrame, source: DataFrame, keys: list[str], prior: float = 60.0) -> DataFrame:
    """``center`` and ``scale`` between two domains' :func:`robust_scales`: the target weighs n / (n + ``prior``).

    Centers are averaged and interquartile scales by their logarithms.
    """
    other = source.select(*keys, F.col("center").alias("source_center"), F.col("iqr_scale").alias("source_scale"))
    w = F.col("n_rows") / (F.col("n_rows") + F.lit(prior))
    return target.join(other, keys).select(*keys, w.alias("target_weight"), (w * F.col("center") + (1 - w) * F.col("source_center")).alias("center"), F.exp(w * F.ln("iqr_scale") + (1 - w) * F.ln("source_scale")).alias("scale"))


def contingency(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square of independence of two categorical columns, with its degrees of freedom."""
    cells = rows.groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    marked = cells.select("r", "c", "n", F.sum("n").over(Window.partitionBy("r")).alias("nr"), F.sum("n").over(Window.partitionBy("c")).alias("nc"))
    total = marked.agg(F.sum("n").alias("total"), F.count_distinct("r").alias("rows"), F.count_distinct("c").alias("columns"), F.sum(F.col("n") * F.col("n") / (F.col("nr") * F.col("nc"))).alias("s"))
    return total.select(F.col("total").alias("n"), (F.col("total") * (F.col("s") - 1)).alias("chi_square"), ((F.col("rows") - 1) * (F.col("columns") - 1)).alias("degrees"))


def robust_scores(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the robust z of ``value`` in its group; the two medians come from counts of values, not from windows."""
    center = quantiles(rows, keys, value, {"center": 0.5})
    centered = rows.join(center, keys).withColumn("deviation", F.abs(F.col(value) - F.col("center")))
    mad = quantiles(centered, keys, "deviation", {"mad": 0.5})
    return centered.join(mad, keys).withColumn("robust_z", robust_z(F.col(value), F.col("center"), F.col("mad"))).select(*rows.columns, "center", "mad", "robust_z")


def effect_sizes(features: DataFrame, keys: list[str], value: str, anomaly: str) -> DataFrame:
    """Pooled-deviation effect size of each feature; +-inf where the groups differ without any spread."""
    a, h = F.when(F.col(anomaly), F.col(value)), F.when(~F.col(anomaly), F.col(value))
    s = features.groupBy(*keys).agg(F.count(a).alias("na"), F.count(h).alias("nh"), F.avg(a).alias("ma"), F.avg(h).alias("mh"), F.var_samp(a).alias("va"), F.var_samp(h).alias("vh"))
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nh") - 1) * F.col("vh")) / (F.col("na") + F.col("nh") - 2))
    difference = F.col("ma") - F.col("mh")
    size = F.when(pooled > 0, difference / pooled).when(difference == 0, 0.0).otherwise(F.signum(difference) * float("inf"))
    return s.select(*keys, "na", "nh", size.alias("effect_size"))


def correlations(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation; null under three rows or without variation."""
    both = rows.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_ranks(average_ranks(both, keys, "x", "rx"), keys, "y", "ry")
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), correlation("x", "y").alias("p"), correlation("rx", "ry").alias("s"))
    known = (F.col("n") >= 3) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return out.select(*keys, "n", F.when(known, F.col("p")).alias("pearson"), F.when(known, F.col("s")).alias("spearman"))


def kendall(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-a, the number of pairs and the discordant ones.

    Ranges of x and of y (by counts, see :mod:`order`) make a grid.  Pairs in different ranges of both are counted from
    the grid's cells; the others share a range of x, or else one of y, and are counted inside it by merge sort.
    """
    plain = cut(rows.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null"))
    placed = plain
    for c in ("x", "y"):
        rank = cumulated(plain, keys, c).select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("value_at").alias("of_x"), F.floor(F.col("rows_below") * GRID / F.col("rows_in_group")).cast("int").alias(f"{c}_range"))
        placed = placed.join(rank, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys] + [F.col(c) == F.col("of_x")]).drop("of_x", *[f"of_{k}" for k in keys])
    placed = cut(placed)
    kinds = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)

    def inside(by: str, other: str):
        def count(key: tuple, part: pa.Table) -> pa.Table:
            agree, differ = concordance(part.column(by).to_numpy().astype(float), part.column(other).to_numpy().astype(float))
            return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=False)}, "agree": [agree], "differ": [differ]})

        return count

    schema = f"{kinds}, agree long, differ long"
    same_x = placed.groupBy(*keys, "x_range").applyInArrow(inside("x", "y"), schema)
    # By the ranges of x, pairs of one range of x are ties here and not counted again.
    same_y = placed.groupBy(*keys, "y_range").applyInArrow(inside("x_range", "y"), schema)
    cells = placed.groupBy(*keys, "x_range", "y_range").agg(F.count(F.lit(1)).alias("n"))
    right = cells.select(*keys, F.col("x_range").alias("i"), F.col("y_range").alias("j"), F.col("n").alias("m"))
    apart = cells.join(right, keys).where("x_range < i and y_range <> j").select(*keys, F.when(F.col("y_range") < F.col("j"), F.col("n") * F.col("m")).otherwise(0).alias("agree"), F.when(F.col("y_range") > F.col("j"), F.col("n") * F.col("m")).otherwise(0).alias("differ"))
    sums = same_x.unionByName(same_y).unionByName(apart).groupBy(*keys).agg(F.sum("agree").alias("agree"), F.sum("differ").alias("differ"))
    sizes = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2"))
    return sizes.join(sums, keys, "left").where("pairs > 0").select(*keys, "pairs", ((F.col("agree") - F.col("differ")) / F.col("pairs")).alias("tau"), F.col("differ").alias("discordant"))


#: Ranges of each variable in the grid of :func:`kendall`; a group's cells are at most its square.
GRID = 16


def concordance(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Concordant and discordant pairs; ties in either are neither.  Inversions by merging sorted halves in numpy."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]

    def tied(*columns: np.ndarray) -> int:
        n = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
        return int((n * (n - 1) // 2).sum())

    rank = np.unique(y, return_inverse=True)[1]
    inversions, size, n = 0, 1, len(rank)
    top = int(rank.max(initial=0)) + 1
    while size < n:
        # Pairs of neighbouring sorted runs, all at once: the key puts each pair of runs apart from the next.
        pair = np.arange(n) // (2 * size)
        left = (np.arange(n) // size) % 2 == 0
        keyed = pair * top + rank
        ends = np.searchsorted(keyed[left], (pair + 1)[~left] * top)
        inversions += int((ends - np.searchsorted(keyed[left], keyed[~left], "right")).sum())
        rank = rank[np.argsort(keyed, kind="stable")]
        size *= 2
    whole = n * (n - 1) // 2
    # Sorted by x and then y, pairs tied in x are never inverted.
    return whole - tied(x) - tied(y) + tied(x, y) - inversions, inversions


def linear_agreement(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R2 of y on x, and the median ratio y / x."""
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), median(F.when(F.col(x) != 0, F.col(y) / F.col(x))).alias("median_ratio"))


def score_equivalence(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``r2``, ``spearman``, ``discordant`` pairs, and whether all three say that the scores are equivalent."""
    fit = rows.groupBy(*keys).agg(F.regr_r2(y, x).alias("r2"))
    ranks = correlations(rows, keys, x, y).select(*keys, "spearman")
    pairs = kendall(rows, keys, x, y).select(*keys, "pairs", "discordant")
    few = F.col("discordant") <= F.greatest(F.lit(1.0), 0.001 * F.col("pairs"))
    return fit.join(ranks, keys).join(pairs, keys).select(*keys, "r2", "spearman", "discordant", ((F.col("r2") >= 0.9999) & (F.col("spearman") >= 0.999) & few).alias("equivalent"))


def with_exact_ks(distances: DataFrame) -> DataFrame:
    """Rows with ``n_first``, ``n_second`` and ``ks``, and their exact ``ks_p``; a row costs the product of its sizes and ``ks`` at most, in the memory of one sample."""
    added = T.StructType([*distances.schema.fields, T.StructField("ks_p", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, d = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_first", "n_second", "ks"))
            p = [None if x is None or not a or not b else ks_exact(a, b, x) for a, b, x in zip(n, m, d, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "ks_p"])

    return distances.mapInArrow(run, added)


def fisher(rows: DataFrame, keys: list[str], first: Column, second: Column) -> DataFrame:
    """``keys``, the four counts of two conditions and Fisher's exact two-sided ``p``."""
    of = lambda a, b: F.count_if((first if a else ~first) & (second if b else ~second))
    counts = rows.groupBy(*keys).agg(of(True, True).alias("both"), of(True, False).alias("first_only"), of(False, True).alias("second_only"), of(False, False).alias("neither"))
    added = T.StructType([*counts.schema.fields, T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(*(c.to_pylist() for c in batch.columns[-4:]), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([fisher_exact(*c) for c in cells], pa.float64())], names=[*batch.schema.names, "p"])

    return counts.mapInArrow(run, added)
