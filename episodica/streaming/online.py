"""Online use of a commissioned detector: features over session windows, scores against frozen statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_features(events: DataFrame, episode: str, time: str, value: str, gap: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Mean, deviation and extremes of each session that a gap ends; state is dropped behind the watermark."""
    timed = events.withColumn("event_time", F.col(time).cast("timestamp")).withWatermark("event_time", lateness)
    return timed.groupBy(episode, F.session_window("event_time", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def score_stream(features: DataFrame, statistics: DataFrame, threshold: float, feature: str = "mean") -> DataFrame:
    """Absolute z of each session against one frozen row of ``mean`` and ``std``, with its alert."""
    frozen = statistics.select(F.lit(1).alias("one"), F.col("mean").alias("frozen_mean"), F.col("std").alias("frozen_std"))
    joined = features.withColumn("one", F.lit(1)).join(F.broadcast(frozen), "one").drop("one")  # a single row
    score = F.when(F.col("frozen_std") > 0, F.abs(F.col(feature) - F.col("frozen_mean")) / F.col("frozen_std"))
    return joined.withColumn("score", score).withColumn("alert", F.coalesce(F.col("score") > threshold, F.lit(False)))
