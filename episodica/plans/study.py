"""The study that the catalogue's queries share: events as telemetry, users as episodes, and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import detectors, features, membership

SEEDS = (0, 1, 2, 3, 4)
SIZES = (10, 25, 50)
ALPHA, RECALL = 0.1, 0.9
RUN = ["detector", "commissioning_n", "seed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.episode_features(events(spark, sf_dir), "user_id", ["ts", "event_id"], ["value"])


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.long_features(wide_features(spark, sf_dir), "user_id").select("user_id", F.col("statistic").alias("feature"), "value")


def labelled(users: DataFrame) -> DataFrame:
    """Users with their labels: a fifth of them are anomalous, of three kinds."""
    return users.withColumn("label", F.when(F.col("user_id") % 5 == 0, 1 + F.expr("user_id div 5") % 3).otherwise(0).cast("long"))


def dealt(labels: DataFrame) -> DataFrame:
    return membership.fixed_partitions(labels.where("label = 0"), "user_id", 0.3, 0.25)


def drawn(parts: DataFrame) -> DataFrame:
    return membership.nested_commissioning(parts.where("partition = 'reservoir'"), "user_id", SEEDS, SIZES)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user of the telemetry with its label."""
    return labelled(events(spark, sf_dir).select("user_id").distinct())


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(episodes(spark, sf_dir))


def commissioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(partitions(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detector, commissioning_n, seed, user_id, partition, label, score.

    The telemetry is read once, for its features; partitions and statistics follow from the feature table.
    """
    wide = cut(wide_features(spark, sf_dir))
    long = features.long_features(wide, "user_id").select("user_id", F.col("statistic").alias("feature"), "value")
    labels = labelled(wide.select("user_id"))
    parts = cut(dealt(labels))
    statistics = detectors.run_statistics(long, drawn(parts), "user_id", ["seed", "commissioning_n"])
    scored = parts.where("partition <> 'reservoir'").select("user_id", "partition", F.lit(0).cast("long").alias("label"))
    roles = scored.unionByName(labels.where("label > 0").select("user_id", F.lit("anomaly").alias("partition"), "label"))
    cells = len(SEEDS) * len(SIZES) * len(features.STATISTICS)
    both = detectors.diagonal_scores(long.join(roles.select("user_id"), "user_id"), statistics, "user_id", ["seed", "commissioning_n"], cells)
    return both.join(roles, "user_id").select(*RUN, "user_id", "partition", "label", "score")


FEATURES_SQL = """
step_rows AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events),
wide AS (SELECT user_id, count(*) AS n_rows, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75, coalesce(sum(step), 0) AS total_variation FROM step_rows GROUP BY user_id),
feats AS (SELECT user_id, 'mean' AS feature, mean AS value FROM wide UNION ALL SELECT user_id, 'std', std FROM wide UNION ALL SELECT user_id, 'median', median FROM wide
  UNION ALL SELECT user_id, 'q25', q25 FROM wide UNION ALL SELECT user_id, 'q75', q75 FROM wide UNION ALL SELECT user_id, 'total_variation', total_variation FROM wide)"""
MEMBERS_SQL = """
episodes AS (SELECT user_id, CAST(CASE WHEN user_id % 5 = 0 THEN 1 + (user_id // 5) % 3 ELSE 0 END AS BIGINT) AS label FROM (SELECT DISTINCT user_id FROM events)),
ranked AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat(user_id, ':42')), user_id) AS rank, count(*) OVER () AS n FROM episodes WHERE label = 0),
parts AS (SELECT user_id, rank, CASE WHEN rank <= floor(n * 0.3) THEN 'calibration' WHEN rank <= floor(n * 0.3) + floor(n * 0.25) THEN 'evaluation' ELSE 'reservoir' END AS partition FROM ranked),
com0 AS (SELECT seed, user_id, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(user_id, ':', seed)), user_id) AS selection_rank
  FROM parts, (SELECT unnest([0, 1, 2, 3, 4]) AS seed) WHERE partition = 'reservoir'),
com AS (SELECT seed, commissioning_n, selection_rank, user_id FROM com0, (SELECT unnest([10, 25, 50]) AS commissioning_n) WHERE selection_rank <= commissioning_n)"""
SCORES_SQL = (
    FEATURES_SQL
    + ","
    + MEMBERS_SQL
    + """,
cen AS (SELECT seed, commissioning_n, feature, value, quantile_cont(value, 0.5) OVER (PARTITION BY seed, commissioning_n, feature) AS center FROM com JOIN feats USING (user_id)),
st AS (SELECT seed, commissioning_n, feature, avg(value) AS mean, stddev_pop(value) AS std, max(center) AS center, quantile_cont(abs(value - center), 0.5) AS mad FROM cen GROUP BY ALL),
roles AS (SELECT user_id, partition, CAST(0 AS BIGINT) AS label FROM parts WHERE partition <> 'reservoir' UNION ALL SELECT user_id, 'anomaly', label FROM episodes WHERE label > 0),
z AS (SELECT seed, commissioning_n, user_id, partition, label, std, mad, (value - mean) / nullif(std, 0) AS zd, greatest(-3.0, least(3.0, (value - center) / nullif(mad * 1.4826, 0))) AS zr
  FROM feats JOIN roles USING (user_id) JOIN st USING (feature)),
scores AS (SELECT 'Diagonal' AS detector, commissioning_n, seed, user_id, partition, label, round(sqrt(sum(zd * zd)), 4) AS score FROM z WHERE std > 1e-12 GROUP BY ALL
  UNION ALL SELECT 'RobustDiagonal', commissioning_n, seed, user_id, partition, label, round(sqrt(sum(zr * zr)), 4) FROM z WHERE mad * 1.4826 > 1e-12 GROUP BY ALL)"""
)
RUNS_SQL = (
    SCORES_SQL
    + """,
cal AS (SELECT detector, commissioning_n, seed, score, row_number() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score) AS rn, count(*) OVER (PARTITION BY detector, commissioning_n, seed) AS n
  FROM scores WHERE partition = 'calibration'),
thr AS (SELECT detector, commissioning_n, seed, score AS threshold FROM cal WHERE rn = least(n, CAST(ceil((n + 1) * (1 - 0.1)) AS BIGINT))),
runs AS (SELECT detector, commissioning_n, seed, any_value(threshold) AS threshold,
  avg(CASE WHEN partition = 'evaluation' THEN CAST(score > threshold AS DOUBLE) END) AS false_positive_rate,
  avg(CASE WHEN partition = 'anomaly' THEN CAST(score > threshold AS DOUBLE) END) AS recall
  FROM scores JOIN thr USING (detector, commissioning_n, seed) GROUP BY detector, commissioning_n, seed)"""
)
