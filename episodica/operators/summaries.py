"""Summaries of run tables: bootstrap intervals, rollups, pairings, decision ladders, set overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, correlation, wilson


def _draws(size: Column, replicate: Column, use) -> Column:
    """``use(place)`` of each of ``size`` draws with replacement; MD5 of replicate and draw names the place."""
    hashed = lambda i: F.conv(F.substring(F.md5(F.concat(replicate.cast("string"), F.lit(":"), i.cast("string"))), 1, 8), 16, 10)
    return F.transform(F.sequence(F.lit(1), size), lambda i: use(F.pmod(hashed(i).cast("long"), size).cast("int")))


def _resampled(runs: DataFrame, keys: list[str], metrics: list[str], replicates: int, statistic, confidence: float) -> DataFrame:
    """``v_`` (all values in order), ``low_`` and ``high_`` of each metric.

    Groups are runs of a study (some twenty rows), gathered into one array each before they are resampled.
    """
    rows = runs.groupBy(*keys).agg(*[F.array_sort(F.collect_list(m)).alias(f"v_{m}") for m in metrics])
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    sampled = drawn.select(*keys, *[F.when(F.size(f"v_{m}") > 0, statistic(_draws(F.size(f"v_{m}"), F.col("b"), lambda k, m=m: F.get(F.col(f"v_{m}"), k)))).alias(f"s_{m}") for m in metrics])
    low = (1 - confidence) / 2
    bounds = sampled.groupBy(*keys).agg(*[F.percentile(f"s_{m}", F.array(F.lit(low), F.lit(1 - low))).alias(f"q_{m}") for m in metrics])
    return rows.join(bounds, keys).select(*keys, *[f"v_{m}" for m in metrics], *[c for m in metrics for c in (F.col(f"q_{m}")[0].alias(f"low_{m}"), F.col(f"q_{m}")[1].alias(f"high_{m}"))])


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _median(values: Column) -> Column:
    def middle(v: Column) -> Column:
        at = (F.size(v) - 1) / 2.0
        low = F.get(v, F.floor(at).cast("int"))
        return low + (F.get(v, F.ceil(at).cast("int")) - low) * (at - F.floor(at))

    return F.get(F.transform(F.array(F.array_sort(values)), middle), F.lit(0))


def bootstrap_mean(runs: DataFrame, keys: list[str], value: str, replicates: int, confidence: float = 0.95) -> DataFrame:
    """Mean with a percentile bootstrap interval."""
    out = _resampled(runs.where(F.col(value).isNotNull()), keys, [value], replicates, _mean, confidence)
    return out.select(*keys, F.size(f"v_{value}").alias("n"), _mean(F.col(f"v_{value}")).alias("mean"), F.col(f"low_{value}").alias("ci_low"), F.col(f"high_{value}").alias("ci_high"))


def bootstrap_median(runs: DataFrame, keys: list[str], value: str, replicates: int, confidence: float = 0.95) -> DataFrame:
    """Median with a percentile bootstrap interval."""
    out = _resampled(runs.where(F.col(value).isNotNull()), keys, [value], replicates, _median, confidence)
    return out.select(*keys, F.size(f"v_{value}").alias("n"), _median(F.col(f"v_{value}")).alias("median"), F.col(f"low_{value}").alias("ci_low"), F.col(f"high_{value}").alias("ci_high"))


def commissioning_summary(runs: DataFrame, keys: list[str], metrics: list[str], replicates: int, confidence: float = 0.95) -> DataFrame:
    """Seeds, success rate, and of each metric the mean with its bootstrap interval, for each detector and size."""
    intervals = _resampled(runs, keys, metrics, replicates, _mean, confidence)
    means = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("seeds"), F.avg(F.col("success").cast("double")).alias("success_rate"))
    columns = [c for m in metrics for c in (_mean(F.col(f"v_{m}")).alias(f"{m}_mean"), F.col(f"low_{m}").alias(f"{m}_ci_low"), F.col(f"high_{m}").alias(f"{m}_ci_high"))]
    return means.join(intervals, keys).select(*keys, "seeds", "success_rate", *columns)


def cluster_bootstrap_spearman(runs: DataFrame, keys: list[str], cluster: str, x: str, y: str, replicates: int, confidence: float = 0.95) -> DataFrame:
    """Interval of the rank correlation of ``x`` and ``y`` when whole clusters are drawn with replacement."""
    clusters = runs.groupBy(*keys).agg(F.array_sort(F.collect_set(cluster)).alias("v"))
    drawn = clusters.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    picked = drawn.select(*keys, "b", F.explode(_draws(F.size("v"), F.col("b"), lambda k: F.get("v", k))).alias(cluster))
    rows = picked.join(runs.select(*keys, cluster, F.col(x).alias("x"), F.col(y).alias("y")), [*keys, cluster])
    one = [*keys, "b"]
    ranked = rows.select(*one, average_rank(one, "x").alias("rx"), average_rank(one, "y").alias("ry"))
    varied = ranked.groupBy(*one).agg(correlation("rx", "ry").alias("c")).where("c is not null")
    low = (1 - confidence) / 2
    found = varied.groupBy(*keys).agg(F.count(F.lit(1)).alias("replicates"), F.percentile("c", F.array(F.lit(low), F.lit(1 - low))).alias("q"))
    return found.select(*keys, "replicates", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def transfer_gate(deltas: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """An ordered ladder over paired improvements: harm first, then acceptance, then lack of gain."""
    d = F.col(delta)
    s = deltas.groupBy(*keys).agg(F.avg(d).alias("mean_delta"), F.avg((d > 0).cast("double")).alias("better"), F.avg((d < 0).cast("double")).alias("worse"))
    gate = F.when(F.col("worse") > 0.5, "reject_harmful").when((F.col("mean_delta") > 0) & (F.col("better") >= 0.5), "accept").when(F.col("mean_delta") >= 0, "inconclusive").otherwise("reject_no_gain")
    return s.withColumn("gate", gate)


def rollup_summary(runs: DataFrame, keys: list[str], level: str, metrics: list[str], total: str = "all") -> DataFrame:
    """Means of the metrics for each key and level, and over all levels, by grouping sets in one pass."""
    aggregates = [F.avg(m).alias(f"mean_{m}") for m in metrics]
    sets = runs.groupingSets([[*map(F.col, keys), F.col(level)], [*map(F.col, keys)]], *map(F.col, keys), F.col(level))
    grouped = sets.agg(F.count(F.lit(1)).alias("runs"), *aggregates, F.grouping(level).alias("g"))
    return grouped.withColumn(level, F.when(F.col("g") == 1, total).otherwise(F.col(level).cast("string"))).drop("g")


def paired_delta(runs: DataFrame, keys: list[str], role: str, first: str, second: str, metrics: list[str]) -> DataFrame:
    """Metric differences second - first for each key that has both roles; a conditional aggregate, no join."""
    of = lambda r, m: F.max(F.when(F.col(role) == r, F.col(m)))
    both = runs.groupBy(*keys).agg(F.count_if(F.col(role) == first).alias("a"), F.count_if(F.col(role) == second).alias("b"), *[(of(second, m) - of(first, m)).alias(f"delta_{m}") for m in metrics])
    return both.where("a = 1 and b = 1").drop("a", "b")


def reproduction_check(recomputed: DataFrame, saved: DataFrame, keys: list[str], metrics: list[str], tolerance: float) -> DataFrame:
    """Full outer comparison of two run tables: side, largest difference, PASS or FAIL."""
    left = recomputed.select(*keys, *[F.col(m).alias(f"l_{m}") for m in metrics], F.lit(True).alias("l"))
    right = saved.select(*keys, *[F.col(m).alias(f"r_{m}") for m in metrics], F.lit(True).alias("r"))
    both = left.join(right, keys, "full_outer")
    gaps = [F.abs(F.col(f"l_{m}") - F.col(f"r_{m}")) for m in metrics]
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    side = F.when(F.col("l").isNull(), "saved_only").when(F.col("r").isNull(), "recomputed_only").otherwise("both")
    return both.select(*keys, side.alias("side"), worst.alias("largest_difference"), F.when((side == "both") & (worst <= tolerance), "PASS").otherwise("FAIL").alias("status"))


def fault_recall_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Recall of each fault with its Wilson interval, from rows with a boolean ``prediction``."""
    counted = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("prediction").alias("detected"))
    low, high = wilson(F.col("detected"), F.col("n"))
    return counted.select(*keys, "n", "detected", (F.col("detected") / F.col("n")).alias("recall"), low.alias("wilson_low"), high.alias("wilson_high"))


def decision(summary: DataFrame, recall: str, fpr: str, target: float, alpha: float) -> DataFrame:
    """An ordered ladder of findings about each row."""
    r, f = F.col(recall), F.col(fpr)
    return summary.withColumn(
        "finding", F.when(r.isNull() | f.isNull(), "incomplete").when((r >= target) & (f <= alpha), "meets_both").when(f > 2 * alpha, "false_alerts_dominate").when(r < 0.5, "low_recall").otherwise("partial")
    )


def overlap_of_selections(selected: DataFrame, run: str, item: str) -> DataFrame:
    """Jaccard and overlap coefficient of each two runs' selections (two empty sets are equal)."""
    sets = selected.groupBy(run).agg(F.collect_set(item).alias("s"))
    a, b = sets.select(F.col(run).alias("run_a"), F.col("s").alias("sa")), sets.select(F.col(run).alias("run_b"), F.col("s").alias("sb"))
    both, union = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    pairs = a.join(b, F.col("run_a") < F.col("run_b"))  # runs of a study, not rows of the data
    return pairs.select("run_a", "run_b", both.alias("common"), F.when(union == 0, 1.0).otherwise(both / union).alias("jaccard"), F.when(F.least(F.size("sa"), F.size("sb")) == 0, 1.0).otherwise(both / F.least(F.size("sa"), F.size("sb"))).alias("overlap"))


def support_changes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Symmetric difference of two edge sets with the side that has each edge."""
    a, b = left.select(*keys).distinct().withColumn("l", F.lit(1)), right.select(*keys).distinct().withColumn("r", F.lit(1))
    return a.join(b, keys, "full_outer").where("l is null or r is null").select(*keys, F.when(F.col("r").isNull(), "lost").otherwise("gained").alias("change"))


def recurrence(setters: DataFrame, group: str, entity: str, size: str) -> DataFrame:
    """How often and at which sizes each entity recurs, with its share of the group's rows."""
    counts = setters.groupBy(group, entity).agg(F.count(F.lit(1)).alias("times"), F.array_join(F.transform(F.array_sort(F.collect_set(size)), lambda x: x.cast("string")), ",").alias("sizes"))
    return counts.withColumn("share", F.col("times") / F.sum("times").over(Window.partitionBy(group)))


def elevation_flags(runs: DataFrame, keys: list[str], value: str, recall: str, factor: float = 10.0) -> DataFrame:
    """Runs whose threshold exceeds ``factor`` times its cell's median, or whose recall is under a tenth."""
    middle = F.percentile(value, 0.5).over(Window.partitionBy(*keys))
    return runs.withColumn("cell_median", middle).withColumn("ratio", F.when(F.col("cell_median") != 0, F.col(value) / F.col("cell_median"))).withColumn("elevated", F.col("ratio") > factor).withColumn("collapsed", F.col(recall) < 0.1)


def replace_member(members: DataFrame, entity: str, removed: int | Column, replacement: int) -> DataFrame:
    """A same-size intervention: one member's place goes to another."""
    return members.withColumn(entity, F.when(F.col(entity) == removed, F.lit(replacement)).otherwise(F.col(entity)))


def against_reference(runs: DataFrame, keys: list[str], size: str, reference_size: int, value: str, factor: float = 10.0) -> DataFrame:
    """Each run's value beside its key's median at the reference size: ratio, and whether it exceeds the factor."""
    of = runs.where(F.col(size) == reference_size).groupBy(*keys).agg(F.percentile(value, 0.5).alias("reference"))
    ratio = F.when(F.col("reference") != 0, F.col(value) / F.col("reference"))
    return runs.join(of, keys).withColumn("ratio", ratio).withColumn("elevated", F.col("ratio") > factor).select(*runs.columns, "reference", "ratio", "elevated")
