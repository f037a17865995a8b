"""Episodes to features: six statistics of each signal, scalar statistics, inventories and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATISTICS = ("mean", "std", "median", "q25", "q75", "total_variation")


def episode_features(telemetry: DataFrame, episode: str, order: list[str], signals: list[str]) -> DataFrame:
    """Wide: one row for each episode, ``signal__statistic`` columns; episodes of one row have null std.

    The lag window and the aggregate share one exchange on the episode; only the named columns are scanned.
    """
    by_time = Window.partitionBy(episode).orderBy(*order)
    steps = telemetry.select(episode, *signals, *[F.abs(F.col(s) - F.lag(s).over(by_time)).alias(f"{s}__step") for s in signals])
    aggregates: list[Column] = []
    for s in signals:
        aggregates += [F.avg(s).alias(f"{s}__mean"), F.stddev_samp(s).alias(f"{s}__std"), F.percentile(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{s}__q"), F.coalesce(F.sum(f"{s}__step"), F.lit(0.0)).alias(f"{s}__total_variation")]
    wide = steps.groupBy(episode).agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)
    columns = [c for s in signals for c in (F.col(f"{s}__mean"), F.col(f"{s}__std"), F.col(f"{s}__q")[1].alias(f"{s}__median"), F.col(f"{s}__q")[0].alias(f"{s}__q25"), F.col(f"{s}__q")[2].alias(f"{s}__q75"), F.col(f"{s}__total_variation"))]
    return wide.select(episode, "n_rows", *columns)


def long_features(wide: DataFrame, episode: str) -> DataFrame:
    """``episode``, ``signal``, ``statistic``, ``value`` from wide features, in one pass."""
    names = [c for c in wide.columns if "__" in c]
    long = wide.unpivot([episode], names, "feature", "value")
    return long.select(episode, F.split_part("feature", F.lit("__"), F.lit(1)).alias("signal"), F.split_part("feature", F.lit("__"), F.lit(2)).alias("statistic"), "value")


def cycle_scalars(telemetry: DataFrame, episode: str, order: list[str], signals: list[str]) -> DataFrame:
    """Length, largest magnitude, grand mean and deviation (population), channel deviations and total variation."""
    n = len(signals)
    wide = episode_features(telemetry, episode, order, signals).select(episode, *[f"{s}__total_variation" for s in signals])
    basic = telemetry.groupBy(episode).agg(
        F.count(F.lit(1)).alias("length"),
        reduce(F.greatest, [F.max(F.abs(s)) for s in signals]).alias("abs_max") if n > 1 else F.max(F.abs(signals[0])).alias("abs_max"),
        *[F.avg(s).alias(f"m_{s}") for s in signals],
        *[F.stddev_pop(s).alias(f"d_{s}") for s in signals],
    )
    total = lambda p: reduce(lambda a, b: a + b, [F.col(f"{p}{s}") for s in signals])
    squares = reduce(lambda a, b: a + b, [F.col(f"d_{s}") * F.col(f"d_{s}") + F.col(f"m_{s}") * F.col(f"m_{s}") for s in signals])
    variations = [F.col(f"{s}__total_variation") for s in signals]
    mean = total("m_") / n
    return basic.join(wide, episode).select(
        episode, "length", "abs_max", mean.alias("global_mean"), F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))).alias("global_std"), (total("d_") / n).alias("channel_std_mean"),
        (F.greatest(*[F.col(f"d_{s}") for s in signals]) if n > 1 else F.col(f"d_{signals[0]}")).alias("channel_std_max"),
        reduce(lambda a, b: a + b, variations).alias("tv_sum"), (reduce(lambda a, b: a + b, variations) / n).alias("tv_mean"),
    )


def episode_inventory(telemetry: DataFrame, episode: str, seconds: str, order: list[str], label: str) -> DataFrame:
    """One audit row for each episode: span, steps of time by sign, contiguity of the label, its set of labels."""
    by_time = Window.partitionBy(episode).orderBy(*order)
    rows = telemetry.select(
        episode, F.col(seconds).alias("t"), F.col(label).alias("label"), (F.col(seconds) - F.lag(seconds).over(by_time)).alias("step"),
        F.when(F.lag(label).over(by_time).isNull() | (F.lag(label).over(by_time) != F.col(label)), 1).otherwise(0).alias("new_segment"),
    )
    positive = F.when(F.col("step") > 0, F.col("step"))
    return rows.groupBy(episode).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.count_if(F.col("step") < 0).alias("steps_back"), F.count_if(F.col("step") == 0).alias("steps_zero"), F.count_if(F.col("step") > 0).alias("steps_forward"),
        F.avg(positive).alias("mean_step"), F.stddev_pop(positive).alias("std_step"), F.min(positive).alias("min_step"), F.max(positive).alias("max_step"),
        F.sum("new_segment").alias("label_segments"), F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ";").alias("labels"),
    )


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each numeric column: counts, missing, finite, extremes, moments, distinct values, constancy.

    One scan adds up everything but distinct values; those are the rows of distinct pairs of column and value, so that what
    is shuffled is a pair and never all columns together.
    """
    def finite(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    def of(c: str) -> Column:
        x = finite(c)
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.count(x).alias("finite"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        )

    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), finite(c).alias("x")) for i, c in enumerate(columns)])).alias("p")).select("p.*")
    distinct = pairs.where("x is not null").distinct().groupBy("place").agg(F.count(F.lit(1)).alias("distinct_values"))
    one = df.agg(F.array(*[of(c) for c in columns]).alias("p")).select(F.posexplode("p").alias("at", "p"))
    # As many rows on both sides as there are columns.
    both = one.join(F.broadcast(distinct), F.col("at") == F.col("place"), "left")
    return both.select("p.*", F.coalesce("distinct_values", F.lit(0).cast("long")).alias("distinct_values")).withColumn("is_constant", F.col("distinct_values") <= 1)


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(F.col(column).alias("value")).count().orderBy(F.desc("count"), "value").limit(k)


def sessions(events: DataFrame, keys: list[str], order: list[str], time: str, label: str) -> DataFrame:
    """Segments that begin wherever time falls against the row before: span and rows of each, with its label counts."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    reset = F.when(F.col(time) < F.lag(time).over(ordered), 1).otherwise(0)
    marked = events.withColumn("reset", reset)
    numbered = marked.withColumn("segment", F.sum("reset").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"), F.count_distinct(label).alias("labels"))


def session_labels(events: DataFrame, keys: list[str], order: list[str], time: str, label: str, labels: list[str]) -> DataFrame:
    """The segments of :func:`sessions` with the number of rows of each label as columns."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    marked = events.withColumn("reset", F.when(F.col(time) < F.lag(time).over(ordered), 1).otherwise(0))
    numbered = marked.withColumn("segment", F.sum("reset").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(label) == x).alias(x) for x in labels])


def label_lengths(telemetry: DataFrame, episode: str, label: str) -> DataFrame:
    """Episodes, rows and lengths of each label, a null label being one of its own."""
    n = telemetry.groupBy(episode, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(label).agg(F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("n_rows"), F.min("n").alias("shortest"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("longest"))


def metadata_audit(table: DataFrame, episode: str, columns: list[str]) -> DataFrame:
    """One row: rows, different episodes, repeated ones, and missing values of each column."""
    one = table.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(episode).alias("episodes"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns])
    return one.withColumn("duplicates", F.col("n_rows") - F.col("episodes"))


def phase_resampled(telemetry: DataFrame, episode: str, order: list[str], signal: str, bins: int) -> DataFrame:
    """The signal at ``bins`` evenly spaced phases of each episode, linear between rows."""
    by_time = Window.partitionBy(episode).orderBy(*order)
    rows = telemetry.select(episode, F.col(signal).alias("x"), (F.row_number().over(by_time) - 1).alias("i"), F.lead(signal).over(by_time).alias("next"), F.count(F.lit(1)).over(Window.partitionBy(episode)).alias("n"))
    # A row answers for the bins whose phase falls between it and the next one.
    last = F.col("n") - 1
    low = F.ceil(F.col("i") * (bins - 1) / F.greatest(last, F.lit(1))).cast("int")
    high = F.when(F.col("i") >= last, F.lit(bins - 1)).otherwise(F.ceil((F.col("i") + 1) * (bins - 1) / last).cast("int") - 1)
    hit = rows.where(low <= high).withColumn("bin", F.explode(F.sequence(low, high)))
    at = F.col("bin") * last / (bins - 1) - F.col("i")
    return hit.select(episode, "bin", F.when(F.col("next").isNull(), F.col("x")).otherwise(F.col("x") + (F.col("next") - F.col("x")) * at).alias("value"))


def standardizer(features: DataFrame, keys: list[str], value: str = "value", floor: float = 1e-12) -> DataFrame:
    """Population mean and deviation of each feature whose variance exceeds the floor."""
    return features.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("variance")).where(F.col("variance") > floor)
