"""Split-conformal thresholds and the facts about their ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at_most, conformal_rank


def conformal_thresholds(calibration: DataFrame, keys: list[str], alpha: float, score: str = "score") -> DataFrame:
    """``threshold``: the k-th smallest score, k clipped to n; ``strict_threshold``: +inf where k exceeds n."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(score))
    ranked = calibration.select(*keys, F.col(score).alias("score"), place.alias("place"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    raw = conformal_rank(F.col("n"), alpha)
    picked = ranked.withColumn("raw_rank", raw).where(F.col("place") == F.least("raw_rank", F.col("n")))
    feasible = F.col("raw_rank") <= F.col("n")
    return picked.select(
        *keys, F.col("n").alias("n_calibration"), "raw_rank", feasible.alias("feasible"), F.col("score").alias("threshold"),
        F.when(feasible, F.col("score")).otherwise(F.lit(float("inf"))).alias("strict_threshold"), (1.0 / (F.col("n") + 1)).alias("min_alpha"),
    )


def rank_table(sizes: DataFrame, m: str, alphas: Sequence[float]) -> DataFrame:
    """Rank of the threshold for each calibration size in the column ``m`` and each level, and whether it is finite or the maximum."""
    rows = sizes.select(F.col(m).cast("long").alias("m"), F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.ceil((F.col(m) + 1) * F.lit(1 - a)).cast("long").alias("rank")) for a in alphas])).alias("r"))
    m, rank = F.col("m"), F.col("r.rank")
    return rows.select("m", F.col("r.alpha").alias("alpha"), rank.alias("rank"), (rank <= m).alias("finite"), (rank == m).alias("is_maximum"))


def floors(alpha: Column) -> tuple[Column, Column]:
    """Calibration sizes from which the threshold is finite, and from which it is below the maximum."""
    slack = 1e-9
    return (F.ceil(1 / alpha - slack) - 1).cast("long"), F.ceil(2 / alpha - 1 - slack).cast("long")


def threshold_methods(calibration: DataFrame, keys: list[str], alpha: float, score: str = "score") -> DataFrame:
    """Maximum, finite-sample and trimmed (without the largest hundredth, one at least) thresholds side by side."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score)))
    ranked = calibration.select(*keys, F.col(score).alias("score"), place.alias("place"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    drop = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * 0.01))
    k = F.least(conformal_rank(F.col("n"), alpha), F.col("n"))
    return ranked.groupBy(*keys).agg(
        F.max("score").alias("max_score"),
        F.max(F.when(F.col("n") - F.col("place") + 1 == k, F.col("score"))).alias("finite_sample"),
        F.max(F.when(F.col("place") == drop + 1, F.col("score"))).alias("trimmed"),
    )


def tail_geometry(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Largest and second score, their gap and ratios, median and upper quantiles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score)))
    ranked = scores.select(*keys, F.col(score).alias("score"), place.alias("place"))
    tail = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("largest"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"),
        F.percentile("score", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("q"),
    )
    safe = lambda a, b: F.when(b != 0, a / b)
    return tail.select(
        *keys, "n", "largest", "second", (F.col("largest") - F.col("second")).alias("gap"), safe(F.col("largest"), F.col("second")).alias("largest_to_second"),
        safe(F.col("largest"), F.col("q")[0]).alias("largest_to_median"), F.col("q")[0].alias("median"), F.col("q")[1].alias("q95"), F.col("q")[2].alias("q99"),
    )


def threshold_setters(calibration: DataFrame, keys: list[str], entity: str, group: str, score: str = "score") -> DataFrame:
    """How often each entity has its run's largest score, how often it took part, and its share of the group's runs."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), entity))
    ranked = calibration.select(*keys, entity, place.alias("place"))
    counts = ranked.groupBy(group, entity).agg(F.count(F.lit(1)).alias("exposures"), F.count_if(F.col("place") == 1).alias("times_largest"))
    share = F.col("times_largest") / F.sum("times_largest").over(Window.partitionBy(group))
    return counts.withColumn("exposure_rate", F.col("times_largest") / F.col("exposures")).withColumn("setter_share", share)


def star(summary: DataFrame, keys: list[str], size: str, recall_low: str, fpr_high: str, recall: float, alpha: float, boundary_safe: bool = False) -> DataFrame:
    """Smallest size whose recall bound and false-alert bound both hold, else censored beyond the largest."""
    if boundary_safe:
        holds = (F.col(recall_low) >= recall - 1e-12) & at_most(F.col(fpr_high), alpha)
    else:
        holds = (F.col(recall_low) >= recall) & (F.col(fpr_high) <= alpha)
    return summary.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(holds, F.col(size))).cast("string"), F.concat(F.lit("Censored (>"), F.max(size).cast("string"), F.lit(")"))).alias("n_star")
    )
