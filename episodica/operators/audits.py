"""Audits of score and run tables: shifts, separation, counterfactuals, drift, contexts and robustness of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .order import cumulated

from ..functions.columns import ratio
from .roc import oracle_feasibility

#: Quantiles whose shift between two healthy samples is reported.
SHIFTED = (0.5, 0.95, 0.99)


def _of(partition: str, value: Column | str = "score") -> Column:
    return F.when(F.col("partition") == partition, F.col(value) if isinstance(value, str) else value)


def superiority(scores: DataFrame, keys: list[str], first: Column) -> DataFrame:
    """``keys`` and ``superiority``: the chance that a row with ``first`` outscores one without, ties counting half."""
    steps = scores.groupBy(*keys, "score").agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    below = F.coalesce(F.sum("b").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = steps.select(*keys, "a", "b", (F.col("a") * (below + F.col("b") / 2.0)).alias("won"))
    return won.groupBy(*keys).agg((F.sum("won") / (F.sum("a") * F.sum("b"))).alias("superiority"))


def healthy_shift(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """How far each run's healthy evaluation scores moved from its calibration scores, also by its threshold."""
    healthy = scores.where("partition in ('calibration', 'evaluation')")
    q = lambda p: F.percentile(_of(p), F.array(*[F.lit(x) for x in SHIFTED]))
    s = healthy.groupBy(*keys).agg(
        F.avg(_of("evaluation")).alias("me"), F.avg(_of("calibration")).alias("mc"), q("evaluation").alias("qe"), q("calibration").alias("qc"), (F.max(_of("evaluation")) - F.max(_of("calibration"))).alias("max_shift")
    )
    above = superiority(healthy, keys, F.col("partition") == "evaluation")
    shift = F.col("me") - F.col("mc")
    return s.join(thresholds.select(*keys, "threshold"), keys).join(above, keys).select(
        *keys, shift.alias("mean_shift"), ratio(shift, F.col("threshold")).alias("mean_shift_by_threshold"),
        *[(F.col("qe")[i] - F.col("qc")[i]).alias(f"q{round(100 * x)}_shift") for i, x in enumerate(SHIFTED)], "max_shift", "superiority",
    )


def fault_separation(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Margins between each fault's scores and the run's healthy evaluation scores."""
    healthy = scores.where("partition = 'evaluation'")
    level = healthy.groupBy(*keys).agg(F.count("score").alias("healthy_count"), F.avg("score").alias("hm"), F.percentile("score", F.array(F.lit(0.5), F.lit(0.95))).alias("hq"))
    faults = scores.where("partition = 'anomaly'").join(thresholds.select(*keys, "threshold"), keys)
    quartiles = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    by_fault = faults.groupBy(*keys, "label").agg(
        F.count("score").alias("fault_count"), F.avg("score").alias("fm"), quartiles.alias("fq"), F.max("threshold").alias("threshold"), F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("exceedance_rate")
    )
    # Each healthy score stands beside every fault of its run, of which the study has a few.
    named = faults.select(*keys, "label").distinct()
    both = healthy.select(*keys, "score").join(named, keys).withColumn("faulty", F.lit(False))
    both = both.unionByName(faults.select(*keys, "score", "label").withColumn("faulty", F.lit(True)))
    above = superiority(both, [*keys, "label"], F.col("faulty"))
    over = lambda c, name: ratio(c, F.col("threshold")).alias(name)
    return by_fault.join(level, keys).join(above, [*keys, "label"]).select(
        *keys, "label", "healthy_count", "fault_count", (F.col("fm") - F.col("hm")).alias("mean_margin"), (F.col("fq")[1] - F.col("hq")[0]).alias("median_margin"),
        (F.col("fq")[0] - F.col("hq")[1]).alias("q25_over_healthy_q95"), over(F.col("hq")[0], "healthy_median_by_threshold"), over(F.col("fq")[1], "fault_median_by_threshold"), "exceedance_rate", "superiority",
    )


def counterfactual_recall(marked: DataFrame, keys: list[str], entity: str, named: Column, alpha: float, recall: float) -> DataFrame:
    """Best recall without a false alert: of all healthy rows, without the named episode, without the highest one.

    ``named`` marks the rows of the episode.  Ties of the highest score go to the smaller id.
    """
    place = F.row_number().over(Window.partitionBy(*keys, "is_anomaly").orderBy(F.desc("score"), entity))
    ranked = marked.withColumn("place", place)
    highest = ranked.where("not is_anomaly and place = 1").select(*keys, F.col(entity).alias("highest_episode"))
    best = lambda rows, budget, name: oracle_feasibility(rows, keys, budget, recall).select(*keys, F.col("max_recall").alias(name))
    out = best(ranked, alpha, "recall_at_budget").join(best(ranked, 0.0, "recall_at_zero"), keys)
    out = out.join(best(ranked.where(F.col("is_anomaly") | ~named), 0.0, "recall_without_named"), keys)
    return out.join(best(ranked.where("is_anomaly or place > 1"), 0.0, "recall_without_highest"), keys).join(highest, keys)


def paired_drift(runs: DataFrame, pair: list[str], size: str, start: int, end: int, metrics: list[str]) -> DataFrame:
    """Each pair's run at two sizes side by side (one to one, else an error), with the changes of the metrics."""
    one = F.when(F.col("copies") > 1, F.raise_error(F.lit("a run is repeated"))).otherwise(F.lit(True))

    def side(value: int, name: str) -> DataFrame:
        part = runs.where(F.col(size) == value).groupBy(*pair).agg(F.count(F.lit(1)).alias("copies"), *[F.max(m).alias(f"{m}_{name}") for m in metrics])
        return part.where(one).drop("copies")

    both = side(start, "start").join(side(end, "end"), pair)
    return both.select(*pair, *[(F.col(f"{m}_end") - F.col(f"{m}_start")).alias(f"delta_{m}") for m in metrics])


def lookup(rows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a reference that has each key once (else an error), with ``found``; null keys are never found."""
    copies = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    once = reference.withColumn("found", F.when(copies > 1, F.raise_error(F.lit("a key is repeated")).cast("boolean")).otherwise(F.lit(True)))
    return rows.join(once, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def against_control(runs: DataFrame, keys: list[str], role: str, control: str, metrics: list[str]) -> DataFrame:
    """Every other role's run beside the control's run of the same key; null where the control has none."""
    of = runs.where(F.col(role) == control).select(*keys, *[F.col(m).alias(f"control_{m}") for m in metrics])
    return lookup(runs.where(F.col(role) != control).select(*keys, role, *metrics), of, keys).drop("found")


def wide_outcomes(runs: DataFrame, keys: list[str], role: str, roles: list[str], metrics: list[str], *others: DataFrame) -> DataFrame:
    """One row for each key with a column for each metric and role, and the other tables' columns by key."""
    wide = runs.groupBy(*keys).pivot(role, roles).agg(*[F.max(m).alias(m) for m in metrics])
    names = {f"{r}_{m}": f"{m}_{r}" for r in roles for m in metrics}
    out = wide.select(*keys, *[F.col(a).alias(b) for a, b in (names.items() if len(metrics) > 1 else {r: f"{metrics[0]}_{r}" for r in roles}.items())])
    for other in others:
        out = lookup(out, other, keys).drop("found")
    return out


def context_scores(scores: DataFrame, keys: list[str], context: str) -> DataFrame:
    """Scores within each context: moments, quantiles, the largest two and the share of alerts (``prediction``)."""
    cell = [*keys, context]
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("score")))
    g = scores.withColumn("place", place).groupBy(*cell).agg(
        F.count("score").alias("episodes"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std"), F.percentile("score", F.array(F.lit(0.5), F.lit(0.9))).alias("q"),
        F.max("score").alias("largest"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"), F.avg(F.col("prediction").cast("double")).alias("alert_rate"),
    )
    return g.select(*cell, "episodes", "mean", "std", F.col("q")[0].alias("median"), F.col("q")[1].alias("q90"), "largest", (F.col("largest") - F.col("second")).alias("gap"), "alert_rate")


def assignment_shift(members: DataFrame, context: str, partition: str = "partition") -> DataFrame:
    """Share of each context among calibration, evaluation and anomalous episodes, and the differences."""
    parts = ("calibration", "evaluation", "anomaly")
    n = members.groupBy(context).agg(*[F.count_if(F.col(partition) == p).alias(p) for p in parts])
    whole = Window.partitionBy()
    # As many rows as there are contexts.
    share = n.select(context, *[(F.col(p) / F.sum(p).over(whole)).alias(f"p_{p}") for p in parts])
    return share.select("*", (F.col("p_anomaly") - F.col("p_calibration")).alias("anomaly_minus_calibration"), (F.col("p_evaluation") - F.col("p_calibration")).alias("evaluation_minus_calibration"))


def context_conditional(queries: DataFrame, calibration: DataFrame, entity: str, context: str, score: str, neighbours: int, rank: int) -> DataFrame:
    """``threshold`` of each query: the ``rank``-th smallest score of its nearest calibration episodes by context.

    Ties of distance go to the smaller id, so of a context's calibration episodes the ``neighbours`` smallest ids can be
    near, and in the order of context and id the nearest lie among ``neighbours`` behind and twice as many before: the last
    context reached before may be cut by its ids.  How many episodes lie before a context comes from ranges of it, so that
    no window holds them all.  A query with fewer calibration episodes takes the largest score of those.
    """
    inside = F.row_number().over(Window.partitionBy(context).orderBy(entity))
    calibration = calibration.where(F.col(context).isNotNull()).withColumn("inside", inside).where(F.col("inside") <= neighbours)
    rows = calibration.select(F.col(context).alias("at"), F.lit(True).alias("is_known")).unionByName(queries.select(F.col(context).alias("at"), F.lit(False).alias("is_known")))
    below = cut(cumulated(rows, [], "at", {"known": F.count_if("is_known")}).select(F.col("value_at").alias("of"), F.col("low_known").alias("below")))
    known = F.struct(F.col(context).alias("c"), F.col(entity).alias("e"), F.col(score).alias("s"))
    listed = calibration.join(below, F.col(context) == F.col("of")).select((F.col("below") + F.col("inside")).alias("place"), known.alias("known"))
    numbered = queries.join(below, F.col(context) == F.col("of")).select(F.col(entity).cast("string").alias("asked"), F.col(context).alias("at"), F.col("below").alias("nth"))
    asked = numbered.select("asked", "at", F.explode(F.sequence(F.col("nth") - 2 * neighbours + 1, F.col("nth") + neighbours)).alias("place"))
    near = asked.join(listed, "place").groupBy("asked", "at").agg(F.collect_list(F.struct(F.abs(F.col("known.c") - F.col("at")).alias("d"), F.col("known.e").alias("e"), F.col("known.s").alias("s"))).alias("near"))
    taken = F.array_sort(F.transform(F.slice(F.array_sort("near"), 1, neighbours), lambda x: x["s"]))
    return near.select(F.col("asked").cast(dict(queries.dtypes)[entity]).alias(entity), F.get(taken, F.least(F.lit(rank), F.size(taken)) - 1).alias("threshold"))


def flattened_moments(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and median of each metric under names of metric and statistic."""
    return runs.groupBy(*keys).agg(*[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.percentile(m, 0.5).alias(f"{m}_median"))])


def finite_extremes(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Least, median and largest finite value of each metric, as rows."""
    long = rows.unpivot(keys, metrics, "metric", "value").where("not isnan(value) and abs(value) < double('inf')")
    return long.groupBy(*keys, "metric").agg(F.min("value").alias("least"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("largest"), F.count("value").alias("n"))


def tercile_regimes(runs: DataFrame, pair: list[str], metric: str) -> DataFrame:
    """``runs`` with ``regime``: low, moderate or high by the terciles of the metric over distinct pairs."""
    pairs = runs.select(*pair, metric).distinct()
    cuts = pairs.agg(F.percentile(metric, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cuts"))  # one row
    label = F.when(F.col(metric) <= F.col("cuts")[0], "low").when(F.col(metric) <= F.col("cuts")[1], "moderate").otherwise("high")
    return runs.crossJoin(F.broadcast(cuts)).withColumn("regime", label).drop("cuts")


def robust_distance(features: DataFrame, target: DataFrame, entity: str, runs: list[str], clip: float = 8.0) -> DataFrame:
    """Root mean square of each episode's clipped robust z against each run's target episodes, by long features.

    ``target`` has run keys and long features; a vanishing scale takes the median of the run's others, or one.
    """
    cell = [*runs, "feature"]
    centered = target.withColumn("center", F.percentile("value", 0.5).over(Window.partitionBy(*cell)))
    scale = centered.groupBy(*cell).agg(F.first("center").alias("center"), (1.4826 * F.percentile(F.abs(F.col("value") - F.col("center")), 0.5)).alias("scale"))
    others = F.percentile(F.when(F.col("scale") > 1e-6, F.col("scale")), 0.5).over(Window.partitionBy(*runs))
    usable = scale.withColumn("scale", F.when(F.col("scale") > 1e-6, F.col("scale")).otherwise(F.greatest(F.coalesce(others, F.lit(1.0)), F.lit(1e-6))))
    z = F.least(F.greatest((F.col("value") - F.col("center")) / F.col("scale"), F.lit(-clip)), F.lit(clip))
    return features.join(usable, "feature").groupBy(*runs, entity).agg(F.sqrt(F.avg(z * z)).alias("distance"))


def source_regimes(distances: DataFrame, runs: list[str], entity: str, most: int = 100) -> DataFrame:
    """``regime`` near, moderate or high: windows of the distance order, of a third of it and at most ``most`` each."""
    counted = cumulated(distances, runs, "distance").select(*[F.col(c).alias(f"of_{c}") for c in runs], F.col("value_at").alias("of_distance"), "rows_below", F.col("rows_in_group").alias("n"))
    joined = distances.join(counted, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in runs] + [F.col("distance") == F.col("of_distance")])
    inside = F.row_number().over(Window.partitionBy(*runs, "distance").orderBy(entity))
    ranked = joined.select(*runs, entity, "distance", (F.col("rows_below") + inside).alias("place"), "n")
    size = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("n") / 3)))
    first = F.floor((F.col("n") - size) / 2)
    in_regime = F.array_compact(F.array(F.when(F.col("place") <= size, "near"), F.when((F.col("place") > first) & (F.col("place") <= first + size), "moderate"), F.when(F.col("place") > F.col("n") - size, "high")))
    return ranked.withColumn("regime", F.explode(in_regime)).select(*runs, "regime", entity, "place", "distance")


def monotone(rows: DataFrame, keys: list[str], order: str, value: str, slack: float = 1e-10) -> DataFrame:
    """Whether the value never falls along the order by more than the slack."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.select(*keys, step.alias("step")).groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("step") >= -slack, F.lit(True))).alias("monotone"), F.min("step").alias("least_step"))


def robustness(deltas: DataFrame, pair: list[str], seed: str, metric: str, delta: str) -> DataFrame:
    """``check``, ``n``, ``mean``: all runs, without the extreme twentieths of the metric, by pair, leaving each seed out."""
    cut = deltas.agg(F.percentile(metric, F.array(F.lit(0.05), F.lit(0.95))).alias("cut"))  # one row
    row = lambda rows, name, value=F.avg(delta): rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"), value.alias("mean"))
    trimmed = deltas.crossJoin(F.broadcast(cut)).where(F.col(metric).between(F.col("cut")[0], F.col("cut")[1]))
    by_pair = deltas.groupBy(*pair).agg(F.avg(delta).alias(delta))
    # The mean without a seed follows from the sums of each.
    sums = deltas.groupBy(seed).agg(F.sum(delta).alias("s"), F.count(delta).alias("k"))
    whole = Window.partitionBy()
    left = sums.select(((F.sum("s").over(whole) - F.col("s")) / (F.sum("k").over(whole) - F.col("k"))).alias("m"))
    out = row(deltas, "all_runs").unionByName(row(trimmed, "without_extremes")).unionByName(row(by_pair, "by_pair"))
    return out.unionByName(row(left, "leave_one_seed_min", F.min("m"))).unionByName(row(left, "leave_one_seed_max", F.max("m")))


def disagreeing_flags(runs: DataFrame, flag: str, recall: str, fpr: str, target: float, alpha: float) -> DataFrame:
    """Rows whose reported success differs from what their rates say."""
    return runs.where(F.col(flag) != ((F.col(recall) >= target) & (F.col(fpr) <= alpha)))


def unpaired_splits(hashes: DataFrame, keys: list[str], role: str, roles: int) -> DataFrame:
    """For each key the number of different member sets and of roles, and whether all roles share one set."""
    counted = hashes.groupBy(*keys).agg(F.count_distinct("members_sha256").alias("member_sets"), F.count_distinct(role).alias("roles"))
    return counted.withColumn("paired", (F.col("member_sets") == 1) & (F.col("roles") == roles))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order, which must not tie."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("place = 1").drop("place")
