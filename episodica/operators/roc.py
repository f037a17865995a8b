"""Ranking metrics of healthy against anomalous scores, as windows over sorted scores instead of theta joins.

Inputs have ``keys``, ``score`` and ``is_anomaly``; an alert is a score strictly above the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, conformal_rank


def auroc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Probability that an anomaly outscores a healthy row, ties counting half; and without credit for ties."""
    ranked = scores.select(*keys, "score", "is_anomaly", average_rank(keys, "score").alias("r"), F.rank().over(Window.partitionBy(*keys).orderBy("score")).alias("low"), F.count_if(F.col("is_anomaly")).over(Window.partitionBy(*keys, "score")).alias("peers"))
    # Rows below an anomaly's score, less the anomalies among them, are what it strictly beats.
    below = F.count_if(F.col("is_anomaly")).over(Window.partitionBy(*keys).orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("peers")
    counted = ranked.withColumn("beats", F.when(F.col("is_anomaly"), F.col("low") - 1 - below))
    sums = counted.groupBy(*keys).agg(F.count_if("is_anomaly").alias("n_anomaly"), F.count_if(~F.col("is_anomaly")).alias("n_healthy"), F.sum(F.when(F.col("is_anomaly"), F.col("r"))).alias("ranks"), F.sum("beats").alias("beats"))
    a, h = F.col("n_anomaly"), F.col("n_healthy")
    return sums.select(*keys, a, h, F.when((a > 0) & (h > 0), (F.col("ranks") - a * (a + 1) / 2.0) / (a * h)).alias("auroc"), F.when((a > 0) & (h > 0), F.col("beats") / (a * h)).alias("auroc_strict"))


def _by_threshold(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct scores from high to low with the counts at or above each."""
    one = scores.groupBy(*keys, "score").agg(F.count_if("is_anomaly").alias("a"), F.count_if(~F.col("is_anomaly")).alias("h"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return one.select(*keys, "score", "a", "h", F.sum("a").over(down).alias("tp"), F.sum("h").over(down).alias("fp"), F.sum("a").over(whole).alias("na"), F.sum("h").over(whole).alias("nh"))


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over distinct scores of the step in recall times the precision there."""
    return _by_threshold(scores, keys).groupBy(*keys).agg(F.sum(F.when(F.col("na") > 0, F.col("a") / F.col("na") * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"))


def partial_auroc(scores: DataFrame, keys: list[str], max_fpr: float) -> DataFrame:
    """Area under the ROC curve up to ``max_fpr``, standardized so that chance is 1/2 and perfection 1."""
    before = Window.partitionBy(*keys).orderBy(F.desc("score"))
    points = _by_threshold(scores, keys).select(
        *keys, (F.col("fp") / F.col("nh")).alias("x1"), (F.col("tp") / F.col("na")).alias("y1"),
        F.coalesce(F.lag(F.col("fp") / F.col("nh")).over(before), F.lit(0.0)).alias("x0"), F.coalesce(F.lag(F.col("tp") / F.col("na")).over(before), F.lit(0.0)).alias("y0"),
    )
    end = F.least(F.col("x1"), F.lit(max_fpr))
    y_end = F.when(F.col("x1") > F.col("x0"), F.col("y0") + (F.col("y1") - F.col("y0")) * (end - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.col("y1"))
    area = F.sum(F.when(F.col("x0") < max_fpr, (end - F.col("x0")) * (F.col("y0") + y_end) / 2).otherwise(0.0))
    low = 0.5 * max_fpr * max_fpr
    return points.groupBy(*keys).agg((0.5 * (1 + (area - low) / (max_fpr - low))).alias("partial_auroc"))


def oracle_feasibility(scores: DataFrame, keys: list[str], alpha: float, recall: float) -> DataFrame:
    """Best recall at a false-alert rate of at most ``alpha``, and least rate at ``recall`` or more, over all thresholds.

    Thresholds are the distinct scores (alerts are what lies strictly above), and minus infinity.
    """
    steps = _by_threshold(scores, keys)
    above = steps.select(*keys, "score", ((F.col("tp") - F.col("a")) / F.col("na")).alias("recall"), ((F.col("fp") - F.col("h")) / F.col("nh")).alias("fpr"))
    everything = scores.select(*keys).distinct().select(*keys, F.lit(float("-inf")).alias("score"), F.lit(1.0).alias("recall"), F.lit(1.0).alias("fpr"))
    candidates = above.unionByName(everything)
    # Ties: largest recall, then least rate, then largest threshold.
    best = F.max(F.when(F.col("fpr") <= alpha + 1e-12, F.struct("recall", (-F.col("fpr")).alias("f"), "score")))
    least = F.min(F.when(F.col("recall") >= recall - 1e-12, F.struct("fpr", (-F.col("recall")).alias("r"), (-F.col("score")).alias("s"))))
    found = candidates.groupBy(*keys).agg(best.alias("b"), least.alias("l"))
    return found.select(
        *keys, F.col("b.recall").alias("max_recall"), (F.lit(0.0) - F.col("b.f")).alias("fpr_there"), F.col("b.score").alias("threshold_there"),
        F.col("l.fpr").alias("min_fpr"), (F.col("b.recall") >= recall - 1e-12).alias("feasible"), (F.lit(recall) - F.col("b.recall")).alias("recall_gap"),
    )


def oracle_thresholds(healthy: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """Two published rules for the healthy score at a false-alert level: floor and ceiling of the index."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("score"))
    ranked = healthy.select(*keys, "score", place.alias("place"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    floor_rule = F.greatest(F.col("n") - F.floor(F.col("n") * F.lit(alpha)), F.lit(1))
    ceiling_rule = F.least(F.greatest(F.ceil(F.col("n") * F.lit(1 - alpha)), F.lit(1)), F.col("n"))
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("place") == floor_rule, F.col("score"))).alias("floor_rule"), F.max(F.when(F.col("place") == ceiling_rule, F.col("score"))).alias("ceiling_rule"))


def count_sensitivity(scores: DataFrame, keys: list[str], false_alerts: list[int]) -> DataFrame:
    """Best recall that a given number of false alerts admits."""
    steps = _by_threshold(scores, keys).select(*keys, (F.col("fp") - F.col("h")).alias("fp"), ((F.col("tp") - F.col("a")) / F.col("na")).alias("recall"))
    grid = steps.withColumn("allowed", F.explode(F.array(*[F.lit(k) for k in false_alerts])))
    return grid.groupBy(*keys, "allowed").agg(F.max(F.when(F.col("fp") <= F.col("allowed"), F.col("recall"))).alias("max_recall"))


def score_ordering(scores: DataFrame, keys: list[str]) -> DataFrame:
    """How far the groups separate: anomalies above every healthy score, healthy above the anomalies' median."""
    whole = Window.partitionBy(*keys)
    marked = scores.select(*keys, "score", "is_anomaly", F.max(F.when(~F.col("is_anomaly"), F.col("score"))).over(whole).alias("top_healthy"), F.min(F.when(F.col("is_anomaly"), F.col("score"))).over(whole).alias("low_anomaly"))
    return marked.groupBy(*keys).agg(
        F.count_if(F.col("is_anomaly") & (F.col("score") > F.col("top_healthy"))).alias("anomalies_above_all_healthy"),
        F.count_if(~F.col("is_anomaly") & (F.col("score") >= F.col("low_anomaly"))).alias("healthy_above_an_anomaly"),
        F.percentile(F.when(F.col("is_anomaly"), F.col("score")), 0.5).alias("median_anomaly"), F.percentile(F.when(~F.col("is_anomaly"), F.col("score")), 0.5).alias("median_healthy"),
    )


def conformal_metrics(scores: DataFrame, keys: list[str], alpha: float, recall: float) -> DataFrame:
    """One row for each run from a score table with partitions: threshold, false-alert rate, recall, success.

    The threshold is an aggregate of the calibration scores, found in the same pass over the run's rows.
    """
    calibration = F.col("partition") == "calibration"
    place = F.row_number().over(Window.partitionBy(*keys, "partition").orderBy("score"))
    n = F.count_if(calibration).over(Window.partitionBy(*keys))
    ranked = scores.select(*keys, "partition", "score", "label", place.alias("place"), n.alias("n"))
    k = F.least(conformal_rank(F.col("n"), alpha), F.col("n"))
    threshold = F.max(F.when(calibration & (F.col("place") == k), F.col("score"))).over(Window.partitionBy(*keys))
    decided = ranked.select(*keys, "partition", "label", threshold.alias("threshold"), (F.col("score") > threshold).cast("double").alias("alert"))
    rate = lambda p: F.avg(F.when(F.col("partition") == p, F.col("alert")))
    out = decided.groupBy(*keys).agg(F.max("threshold").alias("threshold"), rate("evaluation").alias("false_positive_rate"), rate("anomaly").alias("recall"))
    return out.withColumn("success", (F.col("recall") >= recall) & (F.col("false_positive_rate") <= alpha))
