"""Queries over the driver's tables, one for each operator, each beside the SQL that DuckDB runs for it.

Floats are rounded to six digits and integers widened on both sides, since engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lineage import cut
from ..operators import conformal, detectors, distribution, features, guards, kernels, matrix_detectors, membership, moments, roc, summaries, transfer_detectors  # noqa: F401  (registers its scorers)
from . import study
from .study import ALPHA, FEATURES_SQL, MEMBERS_SQL, RECALL, RUN, RUNS_SQL, SCORES_SQL, events, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
KEYS_SQL = "detector, commissioning_n, seed"


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to six digits, integers as long."""
    kinds = dict(df.dtypes)
    of = {"double": lambda c: F.round(c, 6), "int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long")}
    return df.select(*[of.get(kinds[c], lambda x: x)(F.col(c)).alias(c) for c in df.columns])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation and anomaly scores with ``is_anomaly``."""
    return study.scores(spark, sf_dir).where("partition <> 'calibration'").withColumn("is_anomaly", F.col("partition") == "anomaly")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.scores(spark, sf_dir).where("partition = 'calibration'")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roc.conformal_metrics(study.scores(spark, sf_dir), RUN, ALPHA, RECALL)


MARKED_SQL = SCORES_SQL + ", m AS (SELECT *, partition = 'anomaly' AS a FROM scores WHERE partition <> 'calibration')"

# -- sources, projections, guards ------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n_rows, min(event_type) AS first_type, max(event_type) AS last_type, count(DISTINCT event_type) + max(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END) AS n_types FROM events GROUP BY user_id")
def s3_cycle_metadata(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_type").alias("first_type"), F.max("event_type").alias("last_type"), (F.count_distinct("event_type") + F.max(F.col("event_type").isNull().cast("int"))).alias("n_types"))


@query("WITH " + MEMBERS_SQL + " SELECT e.user_id, e.event_id, round(e.value, 6) AS value FROM events e WHERE user_id IN (SELECT user_id FROM parts WHERE partition = 'calibration')")
def s1_protocol_scan(spark, sf_dir):
    wanted = study.partitions(spark, sf_dir).where("partition = 'calibration'").select("user_id")
    return events(spark, sf_dir).select("user_id", "event_id", "value").join(wanted, "user_id", "left_semi")


@query("SELECT l_partkey, l_quantity, l_tax FROM lineitem WHERE l_partkey BETWEEN 100 AND 140")
def s7_span_scan(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_partkey BETWEEN 100 AND 140").select("l_partkey", "l_quantity", "l_tax")


@query("SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS name, count(*) AS n FROM part GROUP BY 1")
def p2_normalized_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(C.normalized_name(F.col("p_name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def p3_json_projection(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, reason, reason = '' AS eligible FROM (SELECT user_id, concat_ws(';', CASE WHEN types > 4 THEN 'multiple_labels' END, CASE WHEN n < 60 THEN 'short' END, CASE WHEN low < 0.5 THEN 'low_value' END) AS reason
FROM (SELECT user_id, count(DISTINCT event_type) AS types, count(*) AS n, min(value) AS low FROM events GROUP BY user_id))""")
def p4_exclusion_reasons(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("event_type").alias("types"), F.count(F.lit(1)).alias("n"), F.min("value").alias("low"))
    reason = F.concat_ws(";", F.when(F.col("types") > 4, "multiple_labels"), F.when(F.col("n") < 60, "short"), F.when(F.col("low") < 0.5, "low_value"))
    return e.select("user_id", reason.alias("reason"), (reason == "").alias("eligible"))


@query("SELECT CAST(p.pos AS BIGINT) AS place, c.c_custkey, CAST(c.c_nationkey AS BIGINT) AS c_nationkey FROM (SELECT unnest([7, 3, 11, 5]) AS id, unnest([0, 1, 2, 3]) AS pos) p JOIN customer c ON c.c_custkey = p.id")
def p5_requested_order(spark, sf_dir):
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in (7, 3, 11, 5)])).alias("place", "c_custkey"))
    return table(spark, sf_dir, "customer").join(wanted, "c_custkey").select("place", "c_custkey", "c_nationkey")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def p8_repeated_keys(spark, sf_dir):
    return guards.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, value FROM events WHERE value IS NULL OR isnan(value) OR isinf(value)")
def p8_not_finite(spark, sf_dir):
    return guards.not_finite(events(spark, sf_dir).select("event_id", "value"), ["value"])


@query("WITH " + MEMBERS_SQL + ", s AS (SELECT user_id, list_sort(list(DISTINCT partition)) AS p FROM (SELECT user_id, partition FROM parts UNION ALL SELECT user_id, 'commissioning' FROM com) GROUP BY user_id), "
       "x AS (SELECT unnest(p) AS partition_a, p FROM s), y AS (SELECT partition_a, unnest(p) AS partition_b FROM x) SELECT partition_a, partition_b, count(*) AS shared FROM y WHERE partition_a <= partition_b GROUP BY ALL")  # fmt: skip
def p9_partition_overlaps(spark, sf_dir):
    both = study.partitions(spark, sf_dir).select("user_id", "partition").unionByName(study.commissioning(spark, sf_dir).select("user_id", F.lit("commissioning").alias("partition")))
    return guards.overlap_counts(both, "user_id", "partition")


@query("WITH " + MEMBERS_SQL + " SELECT CAST(seed AS BIGINT) AS seed, CAST(commissioning_n AS BIGINT) AS commissioning_n, user_id FROM com WHERE false")
def p10_nestedness(spark, sf_dir):
    return guards.not_nested(study.commissioning(spark, sf_dir), "user_id", ["seed"], "commissioning_n").select("seed", "commissioning_n", "user_id")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) <> 1")
def p11_not_constant(spark, sf_dir):
    return guards.not_constant(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag"])


@query("SELECT s_suppkey, CASE WHEN lower(s_name) SIMILAR TO '.*(1|2|3)$' THEN 'calibration' WHEN lower(s_name) SIMILAR TO '.*(4|5|6)$' THEN 'evaluation' ELSE 'other' END AS partition FROM supplier")
def p15_partition_inference(spark, sf_dir):
    n = F.lower("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(n.rlike("(1|2|3)$"), "calibration").when(n.rlike("(4|5|6)$"), "evaluation").otherwise("other").alias("partition"))


# -- features, profiles, inventories ---------------------------------------------------------------------------------

SIGNALS = ["l_quantity", "l_extendedprice"]


@query("WITH " + FEATURES_SQL + " SELECT user_id, feature, round(value, 6) AS value FROM feats")
def a1_episode_features(spark, sf_dir):
    return study.long_features(spark, sf_dir)


@query("""WITH steps AS (SELECT l_partkey, abs(l_quantity - lag(l_quantity) OVER w) AS q, abs(l_tax - lag(l_tax) OVER w) AS t FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_tax)),
v AS (SELECT l_partkey, coalesce(sum(q), 0) + coalesce(sum(t), 0) AS tv FROM steps GROUP BY 1) SELECT lineitem.l_partkey, round(any_value(tv), 6) AS tv_sum, round(any_value(tv) / 2, 6) AS tv_mean, count(*) AS length, max(greatest(abs(l_quantity), abs(l_tax))) AS abs_max, round((avg(l_quantity) + avg(l_tax)) / 2, 6) AS global_mean,
round(sqrt(greatest((var_pop(l_quantity) + avg(l_quantity) * avg(l_quantity) + var_pop(l_tax) + avg(l_tax) * avg(l_tax)) / 2 - ((avg(l_quantity) + avg(l_tax)) / 2) * ((avg(l_quantity) + avg(l_tax)) / 2), 0)), 6) AS global_std,
round((stddev_pop(l_quantity) + stddev_pop(l_tax)) / 2, 6) AS channel_std_mean, round(greatest(stddev_pop(l_quantity), stddev_pop(l_tax)), 6) AS channel_std_max FROM lineitem JOIN v ON v.l_partkey = lineitem.l_partkey GROUP BY 1""")
def a2_cycle_scalars(spark, sf_dir):
    return features.cycle_scalars(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_tax"], ["l_quantity", "l_tax"])


@query("""WITH r AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_type, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS step, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS new_segment
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS row_count, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, count(*) FILTER (step < 0) AS steps_back, count(*) FILTER (step = 0) AS steps_zero, count(*) FILTER (step > 0) AS steps_forward,
round(avg(step) FILTER (step > 0), 3) AS mean_step, round(stddev_pop(step) FILTER (step > 0), 3) AS std_step, round(min(step) FILTER (step > 0), 3) AS min_step, round(max(step) FILTER (step > 0), 3) AS max_step, CAST(sum(new_segment) AS BIGINT) AS label_segments, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS labels FROM r GROUP BY user_id""")
def a3_episode_inventory(spark, sf_dir):
    timed = events(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    out = features.episode_inventory(timed, "user_id", "t", ["ts", "event_id"], "event_type")
    return out.withColumns({c: F.round(c, 3) for c in ("mean_step", "std_step", "min_step", "max_step")})


def _profile_sql(c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS missing, count({c}) AS finite, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) <= 1 AS is_constant FROM lineitem"


@query(" UNION ALL ".join(map(_profile_sql, SIGNALS)))
def a4_column_profile(spark, sf_dir):
    return features.column_profile(table(spark, sf_dir, "lineitem"), SIGNALS)


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def o4_top_values(spark, sf_dir):
    return features.top_values(events(spark, sf_dir), "event_type", 3)


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS episodes, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median,
round(quantile_cont(n, 0.01), 6) AS p01, round(quantile_cont(n, 0.99), 6) AS p99 FROM n""")
def a6_length_audit(spark, sf_dir):
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("episodes"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.01).alias("p01"), F.percentile("n", 0.99).alias("p99"))


@query("""WITH r AS (SELECT *, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS reset FROM events),
s AS (SELECT *, CAST(sum(reset) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM r)
SELECT user_id, segment, count(*) AS rows, min(value) AS first, max(value) AS last, count(DISTINCT event_type) AS labels FROM s GROUP BY 1, 2""")
def w5_sessions(spark, sf_dir):
    return features.sessions(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", "event_type")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER w - 1 AS i, lead(value) OVER w AS nxt, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT user_id, n, unnest(range(0, 20)) AS bin FROM (SELECT DISTINCT user_id, n FROM r)), k AS (SELECT user_id, bin, bin * (n - 1) / 19.0 AS pos, (bin * (n - 1)) // 19 AS i FROM b)
SELECT user_id, bin, round(CASE WHEN nxt IS NULL THEN value ELSE value + (nxt - value) * (pos - i) END, 6) AS value FROM k JOIN r USING (user_id, i)""")
def f_phase_resampling(spark, sf_dir):
    return features.phase_resampled(events(spark, sf_dir), "user_id", ["ts", "event_id"], "value", 20)


@query("WITH " + FEATURES_SQL + " SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 6) AS variance FROM feats GROUP BY 1 HAVING var_pop(value) > 1e-12")
def m1_standardizer(spark, sf_dir):
    return features.standardizer(study.long_features(spark, sf_dir), ["feature"])


# -- membership ------------------------------------------------------------------------------------------------------


@query("WITH " + MEMBERS_SQL + " SELECT user_id, rank, partition FROM parts")
def x3_fixed_partitions(spark, sf_dir):
    return study.partitions(spark, sf_dir)


@query("WITH " + MEMBERS_SQL + " SELECT CAST(seed AS BIGINT) AS seed, CAST(commissioning_n AS BIGINT) AS commissioning_n, selection_rank, user_id FROM com")
def x3_nested_commissioning(spark, sf_dir):
    return study.commissioning(spark, sf_dir)


@query("WITH " + MEMBERS_SQL + """, g AS (SELECT * FROM (VALUES (10, 20), (15, 15), (20, 10)) t(fit, cal)) SELECT CAST(seed AS BIGINT) AS seed, CAST(fit AS BIGINT) AS fit, CAST(cal AS BIGINT) AS cal, selection_rank, user_id, CASE WHEN selection_rank <= fit THEN 'fit' ELSE 'calibration' END AS role
FROM com0, g WHERE selection_rank <= fit + cal""")
def x5_budget_split(spark, sf_dir):
    return membership.budget_split(study.partitions(spark, sf_dir).where("partition = 'reservoir'"), "user_id", study.SEEDS, ((10, 20), (15, 15), (20, 10)))


@query("WITH " + MEMBERS_SQL + " SELECT user_id, CAST((row_number() OVER (ORDER BY md5(concat(user_id, ':9')), user_id) - 1) % 5 AS BIGINT) AS fold FROM parts WHERE partition = 'reservoir'")
def x6_kfold(spark, sf_dir):
    return membership.kfold(study.partitions(spark, sf_dir).where("partition = 'reservoir'").select("user_id"), "user_id", 5, 9)


@query("WITH " + MEMBERS_SQL + " SELECT CAST(seed AS BIGINT) AS seed, CAST(commissioning_n AS BIGINT) AS commissioning_n, sha256(array_to_string(list_sort(list(user_id)), chr(10))) AS members_sha256, count(*) AS members FROM com GROUP BY 1, 2")
def u6_set_hash(spark, sf_dir):
    return membership.set_hash(study.commissioning(spark, sf_dir), ["seed", "commissioning_n"], "user_id")


@query("WITH " + RUNS_SQL + ", g AS (SELECT * FROM (SELECT unnest(['Diagonal', 'RobustDiagonal']) AS detector), (SELECT unnest([10, 25, 50]) AS commissioning_n), (SELECT unnest(range(0, 5)) AS seed)) SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed FROM g ANTI JOIN (SELECT * FROM runs WHERE false_positive_rate <= 0.1) USING (detector, commissioning_n, seed)")
def s13_remaining_runs(spark, sf_dir):
    """Runs of the study's grid that have no result with at most a tenth of false alerts yet."""
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(n).alias("commissioning_n"), F.lit(k).alias("seed")) for d in ("Diagonal", "RobustDiagonal") for n in study.SIZES for k in study.SEEDS]))
    grid = spark.range(1).select(cells.alias("c")).select("c.*")
    return membership.remaining_runs(grid, runs(spark, sf_dir).where("false_positive_rate <= 0.1"), RUN)


@query("WITH " + MEMBERS_SQL + """ SELECT partition, NULL::BIGINT AS seed, NULL::BIGINT AS commissioning_n, count(*) AS members FROM parts GROUP BY 1
UNION ALL SELECT 'commissioning', seed, commissioning_n, count(*) FROM com GROUP BY seed, commissioning_n""")
def a8_protocol_summary(spark, sf_dir):
    fixed = study.partitions(spark, sf_dir).groupBy("partition").agg(F.count(F.lit(1)).alias("members"))
    nested = study.commissioning(spark, sf_dir).groupBy(F.col("seed").cast("long"), F.col("commissioning_n").cast("long")).agg(F.count(F.lit(1)).alias("members")).withColumn("partition", F.lit("commissioning"))
    return fixed.unionByName(nested.toDF("seed", "commissioning_n", "members", "partition"), allowMissingColumns=True).select("partition", "seed", "commissioning_n", "members")


@query("WITH " + MEMBERS_SQL + " SELECT selection_rank, CASE WHEN user_id = (SELECT min(user_id) FROM com0 WHERE seed = 0 AND selection_rank <= 10) THEN -1 ELSE user_id END AS user_id FROM com0 WHERE seed = 0 AND selection_rank <= 10")
def u5_replace_member(spark, sf_dir):
    members = study.commissioning(spark, sf_dir).where("seed = 0 and commissioning_n = 10").select("selection_rank", "user_id")
    return summaries.replace_member(members, "user_id", members.agg(F.min("user_id")).scalar(), -1)


# -- scores, thresholds, ranking metrics -----------------------------------------------------------------------------


@query("WITH " + SCORES_SQL + " SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed, user_id, partition, label, score FROM scores")
def d10_score_table(spark, sf_dir):
    return study.scores(spark, sf_dir)


@query("WITH " + RUNS_SQL + " SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed, threshold, round(false_positive_rate, 6) AS false_positive_rate, round(recall, 6) AS recall, recall >= 0.9 AND false_positive_rate <= 0.1 AS success FROM runs")
def e2e_commissioning(spark, sf_dir):
    return runs(spark, sf_dir)


@query("WITH " + SCORES_SQL + """, c AS (SELECT detector, commissioning_n, seed, score, row_number() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score) AS rn, count(*) OVER (PARTITION BY detector, commissioning_n, seed) AS n FROM scores WHERE partition = 'calibration'),
k AS (SELECT *, CAST(ceil((n + 1) * (1 - 0.01)) AS BIGINT) AS raw_rank FROM c) SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed, n AS n_calibration, raw_rank, raw_rank <= n AS feasible, score AS threshold,
CASE WHEN raw_rank <= n THEN score ELSE CAST('inf' AS DOUBLE) END AS strict_threshold, round(1.0 / (n + 1), 6) AS min_alpha FROM k WHERE rn = least(raw_rank, n)""")
def st15_conformal_thresholds(spark, sf_dir):
    return conformal.conformal_thresholds(calibration(spark, sf_dir), RUN, 0.01)


@query("WITH g AS (SELECT DISTINCT n AS m FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)), a AS (SELECT unnest([0.005, 0.01, 0.02, 0.05]) AS alpha) SELECT CAST(m AS BIGINT) AS m, CAST(alpha AS DOUBLE) AS alpha, CAST(ceil((m + 1) * (1 - alpha)) AS BIGINT) AS rank, ceil((m + 1) * (1 - alpha)) <= m AS finite, ceil((m + 1) * (1 - alpha)) = m AS is_maximum FROM g, a")
def st16_rank_table(spark, sf_dir):
    """Ranks for every number of events that a user has, as if these calibrated."""
    sizes = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("m")).select("m").distinct()
    return conformal.rank_table(sizes, "m", (0.005, 0.01, 0.02, 0.05))


@query("SELECT CAST(l_discount AS DOUBLE) AS alpha, CAST(ceil(1 / CAST(l_discount AS DOUBLE) - 1e-9) - 1 AS BIGINT) AS feasibility, CAST(ceil(2 / CAST(l_discount AS DOUBLE) - 1 - 1e-9) AS BIGINT) AS interiority, count(*) AS n_rows FROM lineitem WHERE l_discount > 0 GROUP BY l_discount")
def st16_floors(spark, sf_dir):
    """The least calibration sizes for every discount of the table, taken as a level, and its rows."""
    levels = table(spark, sf_dir, "lineitem").where("l_discount > 0").groupBy(F.col("l_discount").cast("double").alias("alpha")).agg(F.count(F.lit(1)).alias("n_rows"))
    low, inner = conformal.floors(F.col("alpha"))
    return levels.select("alpha", low.alias("feasibility"), inner.alias("interiority"), "n_rows")


@query("WITH " + SCORES_SQL + """, c AS (SELECT *, row_number() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY detector, commissioning_n, seed) AS n FROM scores WHERE partition = 'calibration')
SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed, max(score) AS max_score, max(CASE WHEN n - rn + 1 = least(n, CAST(ceil((n + 1) * (1 - 0.1)) AS BIGINT)) THEN score END) AS finite_sample,
max(CASE WHEN rn = greatest(1, CAST(floor(n * 0.01) AS BIGINT)) + 1 THEN score END) AS trimmed FROM c GROUP BY ALL""")
def st17_threshold_methods(spark, sf_dir):
    return conformal.threshold_methods(calibration(spark, sf_dir), RUN, ALPHA)


@query("WITH " + SCORES_SQL + """, c AS (SELECT *, row_number() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score DESC) AS rn FROM scores WHERE partition = 'calibration')
SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed, count(*) AS n, max(score) AS largest, max(CASE WHEN rn = 2 THEN score END) AS second, round(max(score) - max(CASE WHEN rn = 2 THEN score END), 6) AS gap,
round(max(score) / nullif(max(CASE WHEN rn = 2 THEN score END), 0), 6) AS largest_to_second, round(max(score) / nullif(quantile_cont(score, 0.5), 0), 6) AS largest_to_median, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95), 6) AS q95, round(quantile_cont(score, 0.99), 6) AS q99 FROM c GROUP BY ALL""")
def a17_tail_geometry(spark, sf_dir):
    return conformal.tail_geometry(calibration(spark, sf_dir), RUN)


@query("WITH " + SCORES_SQL + """, c AS (SELECT *, row_number() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score DESC, user_id) AS rn FROM scores WHERE partition = 'calibration'),
g AS (SELECT detector, user_id, count(*) AS exposures, count(*) FILTER (rn = 1) AS times_largest FROM c GROUP BY ALL)
SELECT *, round(times_largest / exposures, 6) AS exposure_rate, round(times_largest / sum(times_largest) OVER (PARTITION BY detector), 6) AS setter_share FROM g""")
def a18_threshold_setters(spark, sf_dir):
    return conformal.threshold_setters(calibration(spark, sf_dir), RUN, "user_id", "detector")


@query("WITH " + MARKED_SQL + """, r AS (SELECT *, rank() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score) + (count(*) OVER (PARTITION BY detector, commissioning_n, seed, score) - 1) / 2.0 AS ar FROM m),
s AS (SELECT detector, commissioning_n, seed, count(*) FILTER (a) AS n_anomaly, count(*) FILTER (NOT a) AS n_healthy, sum(ar) FILTER (a) AS ranks FROM r GROUP BY ALL),
p AS (SELECT x.detector, x.commissioning_n, x.seed, avg(CAST(x.score > y.score AS DOUBLE)) AS strict FROM m x JOIN m y USING (detector, commissioning_n, seed) WHERE x.a AND NOT y.a GROUP BY ALL)
SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed, n_anomaly, n_healthy, round((ranks - n_anomaly * (n_anomaly + 1) / 2.0) / (n_anomaly * n_healthy), 6) AS auroc, round(strict, 6) AS auroc_strict FROM s JOIN p USING (detector, commissioning_n, seed)""")
def st8_auroc(spark, sf_dir):
    return roc.auroc(marked(spark, sf_dir), RUN)


_STEPS_SQL = MARKED_SQL + """, d AS (SELECT detector, commissioning_n, seed, score, count(*) FILTER (a) AS a, count(*) FILTER (NOT a) AS h FROM m GROUP BY ALL),
steps AS (SELECT *, sum(a) OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score DESC) AS tp, sum(h) OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score DESC) AS fp, sum(a) OVER (PARTITION BY detector, commissioning_n, seed) AS na, sum(h) OVER (PARTITION BY detector, commissioning_n, seed) AS nh FROM d)"""
_RUN_SQL = "detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed"


@query("WITH " + _STEPS_SQL + f" SELECT {_RUN_SQL}, round(sum(a / na * tp / (tp + fp)), 6) AS average_precision FROM steps GROUP BY detector, commissioning_n, seed")
def st9_average_precision(spark, sf_dir):
    return roc.average_precision(marked(spark, sf_dir), RUN)


@query("WITH " + _STEPS_SQL + f""", pts AS (SELECT detector, commissioning_n, seed, fp / nh AS x1, tp / na AS y1, coalesce(lag(fp / nh) OVER w, 0) AS x0, coalesce(lag(tp / na) OVER w, 0) AS y0 FROM steps WINDOW w AS (PARTITION BY detector, commissioning_n, seed ORDER BY score DESC)),
ar AS (SELECT *, least(x1, 0.1) AS e, CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (least(x1, 0.1) - x0) / (x1 - x0) ELSE y1 END AS ye FROM pts WHERE x0 < 0.1)
SELECT {_RUN_SQL}, round(0.5 * (1 + (sum((e - x0) * (y0 + ye) / 2) - 0.005) / (0.1 - 0.005)), 6) AS partial_auroc FROM ar GROUP BY detector, commissioning_n, seed""")
def st10_partial_auroc(spark, sf_dir):
    return roc.partial_auroc(marked(spark, sf_dir), RUN, 0.1)


@query("WITH " + _STEPS_SQL + f""", c AS (SELECT detector, commissioning_n, seed, score, (tp - a) / na AS recall, (fp - h) / nh AS fpr FROM steps UNION ALL SELECT DISTINCT detector, commissioning_n, seed, CAST('-inf' AS DOUBLE), 1, 1 FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY recall DESC, fpr, score DESC) AS k FROM c WHERE fpr <= 0.1 + 1e-12),
l AS (SELECT detector, commissioning_n, seed, min(fpr) AS min_fpr FROM c WHERE recall >= 0.9 - 1e-12 GROUP BY ALL)
SELECT {_RUN_SQL}, round(recall, 6) AS max_recall, round(fpr, 6) AS fpr_there, score AS threshold_there, round(min_fpr, 6) AS min_fpr, recall >= 0.9 - 1e-12 AS feasible, round(0.9 - recall, 6) AS recall_gap FROM b JOIN l USING (detector, commissioning_n, seed) WHERE k = 1""")
def st12_oracle_feasibility(spark, sf_dir):
    return roc.oracle_feasibility(marked(spark, sf_dir), RUN, 0.1, 0.9)


@query("WITH " + MARKED_SQL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score) AS rn, count(*) OVER (PARTITION BY detector, commissioning_n, seed) AS n FROM m WHERE NOT a)
SELECT {_RUN_SQL}, max(CASE WHEN rn = greatest(n - CAST(floor(n * 0.1) AS BIGINT), 1) THEN score END) AS floor_rule, max(CASE WHEN rn = least(greatest(CAST(ceil(n * (1 - 0.1)) AS BIGINT), 1), n) THEN score END) AS ceiling_rule FROM r GROUP BY detector, commissioning_n, seed""")
def st11_oracle_thresholds(spark, sf_dir):
    return roc.oracle_thresholds(marked(spark, sf_dir).where("not is_anomaly"), RUN, 0.1)


@query("WITH " + _STEPS_SQL + f", g AS (SELECT unnest([0, 1, 2]) AS allowed) SELECT {_RUN_SQL}, CAST(allowed AS BIGINT) AS allowed, round(max(CASE WHEN fp - h <= allowed THEN (tp - a) / na END), 6) AS max_recall FROM steps, g GROUP BY detector, commissioning_n, seed, allowed")
def st13_count_sensitivity(spark, sf_dir):
    return roc.count_sensitivity(marked(spark, sf_dir), RUN, [0, 1, 2])


@query("WITH " + MARKED_SQL + f""", x AS (SELECT *, max(CASE WHEN NOT a THEN score END) OVER (PARTITION BY detector, commissioning_n, seed) AS th, min(CASE WHEN a THEN score END) OVER (PARTITION BY detector, commissioning_n, seed) AS la FROM m)
SELECT {_RUN_SQL}, count(*) FILTER (a AND score > th) AS anomalies_above_all_healthy, count(*) FILTER (NOT a AND score >= la) AS healthy_above_an_anomaly, round(quantile_cont(score, 0.5) FILTER (a), 6) AS median_anomaly, round(quantile_cont(score, 0.5) FILTER (NOT a), 6) AS median_healthy FROM x GROUP BY detector, commissioning_n, seed""")
def st14_score_ordering(spark, sf_dir):
    return roc.score_ordering(marked(spark, sf_dir), RUN)


# -- summaries, stars, pairs -----------------------------------------------------------------------------------------


@query("WITH " + RUNS_SQL + """ SELECT detector, coalesce(CAST(commissioning_n AS VARCHAR), 'all') AS commissioning_n, count(*) AS runs, round(avg(recall), 6) AS mean_recall, round(avg(false_positive_rate), 6) AS mean_false_positive_rate FROM runs GROUP BY GROUPING SETS ((detector, commissioning_n), (detector))""")
def a9_rollup_summary(spark, sf_dir):
    return summaries.rollup_summary(runs(spark, sf_dir), ["detector"], "commissioning_n", ["recall", "false_positive_rate"]).select("detector", "commissioning_n", "runs", "mean_recall", "mean_false_positive_rate")


_BOOT_SQL = RUNS_SQL + """, g AS (SELECT detector, commissioning_n, list_sort(list(recall)) AS v FROM runs GROUP BY ALL), b AS (SELECT *, unnest(range(1, 201)) AS b FROM g), d AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM b),
p AS (SELECT detector, commissioning_n, b, avg(v[1 + CAST(('0x' || substr(md5(concat(b, ':', i)), 1, 8))::BIGINT % len(v) AS INTEGER)]) AS m FROM d GROUP BY ALL),
boot AS (SELECT detector, commissioning_n, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM p GROUP BY ALL)"""


@query("WITH " + _BOOT_SQL + " SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(len(v) AS BIGINT) AS n, round(list_sum(v) / len(v), 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM g JOIN boot USING (detector, commissioning_n)")
def st1_bootstrap_mean(spark, sf_dir):
    return summaries.bootstrap_mean(runs(spark, sf_dir), ["detector", "commissioning_n"], "recall", 200)


@query("WITH " + _BOOT_SQL.replace("range(1, 201)", "range(1, 10001)") + " SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(len(v) AS BIGINT) AS n, round(list_sum(v) / len(v), 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM g JOIN boot USING (detector, commissioning_n)")
def st1_bootstrap_mean_10000(spark, sf_dir):
    """With the reference's number of replicates."""
    return summaries.bootstrap_mean(runs(spark, sf_dir), ["detector", "commissioning_n"], "recall", 10_000)


@query("WITH " + RUNS_SQL + " SELECT CAST(x.commissioning_n AS BIGINT) AS commissioning_n, CAST(x.seed AS BIGINT) AS seed, round(y.recall - x.recall, 6) AS delta_recall, round(y.false_positive_rate - x.false_positive_rate, 6) AS delta_false_positive_rate FROM runs x JOIN runs y USING (commissioning_n, seed) WHERE x.detector = 'Diagonal' AND y.detector = 'RobustDiagonal'")
def j5_paired_delta(spark, sf_dir):
    return summaries.paired_delta(runs(spark, sf_dir), ["commissioning_n", "seed"], "detector", "Diagonal", "RobustDiagonal", ["recall", "false_positive_rate"])


@query("WITH " + RUNS_SQL + f""", l AS (SELECT * FROM runs WHERE seed < 4), r AS (SELECT detector, commissioning_n, seed, recall + CASE WHEN seed = 2 THEN 0.01 ELSE 0 END AS recall FROM runs WHERE seed > 0)
SELECT {_RUN_SQL}, CASE WHEN l.recall IS NULL THEN 'saved_only' WHEN r.recall IS NULL THEN 'recomputed_only' ELSE 'both' END AS side, round(abs(l.recall - r.recall), 6) AS largest_difference,
CASE WHEN abs(l.recall - r.recall) <= 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM l FULL JOIN r USING (detector, commissioning_n, seed)""")
def j4_reproduction_check(spark, sf_dir):
    r = runs(spark, sf_dir)
    saved = r.where("seed > 0").withColumn("recall", F.col("recall") + F.when(F.col("seed") == 2, 0.01).otherwise(0.0))
    return summaries.reproduction_check(r.where("seed < 4"), saved, RUN, ["recall"], 1e-9)


_PRED_SQL = RUNS_SQL + ", pr AS (SELECT s.*, s.score > r.threshold AS prediction, r.threshold FROM scores s JOIN runs r USING (detector, commissioning_n, seed))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = study.scores(spark, sf_dir)
    t = conformal.conformal_thresholds(s.where("partition = 'calibration'"), RUN, ALPHA).select(*RUN, "threshold")
    return s.join(detectors.bounded(t, 2 * len(study.SEEDS) * len(study.SIZES)), RUN).withColumn("prediction", F.col("score") > F.col("threshold"))


@query("WITH " + _PRED_SQL + """, g AS (SELECT detector, commissioning_n, label, count(*) AS n, count(*) FILTER (prediction) AS detected FROM pr WHERE partition = 'anomaly' GROUP BY ALL)
SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, label, n, detected, round(detected / n, 6) AS recall,
round(greatest((detected / n + 3.8414588206941236 / (2 * n)) / (1 + 3.8414588206941236 / n) - 1.959963984540054 * sqrt(detected / n * (1 - detected / n) / n + 3.8414588206941236 / (4 * n * n)) / (1 + 3.8414588206941236 / n), 0), 6) AS wilson_low,
round(least((detected / n + 3.8414588206941236 / (2 * n)) / (1 + 3.8414588206941236 / n) + 1.959963984540054 * sqrt(detected / n * (1 - detected / n) / n + 3.8414588206941236 / (4 * n * n)) / (1 + 3.8414588206941236 / n), 1), 6) AS wilson_high FROM g""")
def st4_fault_recall(spark, sf_dir):
    return summaries.fault_recall_precision(predictions(spark, sf_dir).where("partition = 'anomaly'"), ["detector", "commissioning_n", "label"])


@query("WITH " + RUNS_SQL + f", s AS (SELECT {_RUN_SQL}, recall AS r, false_positive_rate AS f FROM runs) SELECT detector, commissioning_n, seed, round(r, 6) AS recall, round(f, 6) AS false_positive_rate, CASE WHEN r IS NULL OR f IS NULL THEN 'incomplete' WHEN r >= 0.9 AND f <= 0.1 THEN 'meets_both' WHEN f > 0.2 THEN 'false_alerts_dominate' WHEN r < 0.5 THEN 'low_recall' ELSE 'partial' END AS finding FROM s")
def a26_decision(spark, sf_dir):
    return summaries.decision(runs(spark, sf_dir).select(*RUN, "recall", "false_positive_rate"), "recall", "false_positive_rate", 0.9, 0.1)


@query("WITH " + RUNS_SQL + f", e AS (SELECT *, quantile_cont(threshold, 0.5) OVER (PARTITION BY detector, commissioning_n) AS cm FROM runs) SELECT {_RUN_SQL}, round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(cm, 6) AS cell_median, round(threshold / nullif(cm, 0), 6) AS ratio, threshold / nullif(cm, 0) > 1.1 AS elevated, recall < 0.1 AS collapsed FROM e")
def st27_elevation_flags(spark, sf_dir):
    return summaries.elevation_flags(runs(spark, sf_dir).select(*RUN, "threshold", "recall"), ["detector", "commissioning_n"], "threshold", "recall", 1.1)


@query("WITH " + MEMBERS_SQL + """, s AS (SELECT seed, list(DISTINCT user_id) AS s FROM com WHERE commissioning_n = 25 GROUP BY 1) SELECT CAST(x.seed AS BIGINT) AS run_a, CAST(y.seed AS BIGINT) AS run_b, CAST(len(list_intersect(x.s, y.s)) AS BIGINT) AS common,
round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS jaccard, round(len(list_intersect(x.s, y.s)) / least(len(x.s), len(y.s)), 6) AS overlap FROM s x JOIN s y ON x.seed < y.seed""")
def u4_selection_overlap(spark, sf_dir):
    return summaries.overlap_of_selections(study.commissioning(spark, sf_dir).where("commissioning_n = 25"), "seed", "user_id")


@query("WITH " + MEMBERS_SQL + """, a AS (SELECT user_id FROM com WHERE seed = 0 AND commissioning_n = 25), b AS (SELECT user_id FROM com WHERE seed = 1 AND commissioning_n = 25)
SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM a) THEN 'lost' ELSE 'gained' END AS change FROM ((SELECT user_id FROM a EXCEPT SELECT user_id FROM b) UNION ALL (SELECT user_id FROM b EXCEPT SELECT user_id FROM a))""")
def u3_support_changes(spark, sf_dir):
    c = study.commissioning(spark, sf_dir).where("commissioning_n = 25")
    return summaries.support_changes(c.where("seed = 0"), c.where("seed = 1"), ["user_id"])


@query("WITH " + SCORES_SQL + """, c AS (SELECT *, row_number() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score DESC, user_id) AS rn FROM scores WHERE partition = 'calibration'),
g AS (SELECT detector, user_id, count(*) AS times, array_to_string(list_sort(list(DISTINCT commissioning_n)), ',') AS sizes FROM c WHERE rn = 1 GROUP BY ALL) SELECT *, round(times / sum(times) OVER (PARTITION BY detector), 6) AS share FROM g""")
def a22_recurrence(spark, sf_dir):
    top = calibration(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("score"), "user_id"))).where("rn = 1")
    return summaries.recurrence(top, "detector", "user_id", "commissioning_n")


# -- distributions ---------------------------------------------------------------------------------------------------


@query("WITH " + SCORES_SQL + """ SELECT detector, partition, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(quantile_cont(score, 0.1), 6) AS q10, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50,
round(quantile_cont(score, 0.75), 6) AS q75, round(quantile_cont(score, 0.9), 6) AS q90, round(quantile_cont(score, 0.95), 6) AS q95, round(quantile_cont(score, 0.99), 6) AS q99, max(score) AS max FROM scores GROUP BY 1, 2""")
def a16_quantile_block(spark, sf_dir):
    return distribution.quantile_block(study.scores(spark, sf_dir), ["detector", "partition"])


_TWO_SQL = SCORES_SQL + """, t AS (SELECT *, partition = 'evaluation' AS b FROM scores WHERE partition IN ('calibration', 'evaluation')), d AS (SELECT detector, commissioning_n, seed, score AS x, count(*) FILTER (b) AS nb1, count(*) FILTER (NOT b) AS na1 FROM t GROUP BY ALL),
r AS (SELECT *, sum(na1) OVER w AS ca, sum(nb1) OVER w AS cb, sum(na1) OVER k AS na, sum(nb1) OVER k AS nb, lead(x) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY detector, commissioning_n, seed ORDER BY x), k AS (PARTITION BY detector, commissioning_n, seed))"""


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = study.scores(spark, sf_dir).where("partition in ('calibration', 'evaluation')").withColumn("second", F.col("partition") == "evaluation")
    return distribution.two_sample(pooled, RUN, "score", "second")


@query("WITH " + _TWO_SQL + f" SELECT {_RUN_SQL}, CAST(max(na) AS BIGINT) AS n_first, CAST(max(nb) AS BIGINT) AS n_second, round(max(abs(ca / na - cb / nb)), 6) AS ks, round(coalesce(sum(abs(ca / na - cb / nb) * (nxt - x)), 0), 6) AS wasserstein, round(sum(nb1 * (ca - na1 / 2.0)), 6) AS mann_whitney_u FROM r GROUP BY detector, commissioning_n, seed")
def st18_two_sample(spark, sf_dir):
    return _shifted(spark, sf_dir)


@query("""WITH c AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY r) AS nr, sum(n) OVER (PARTITION BY c) AS nc FROM c)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n) * (sum(n * n / (nr * nc)) - 1), 6) AS chi_square, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS BIGINT) AS degrees FROM x""")
def st21_contingency(spark, sf_dir):
    return distribution.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def a25_crosstab(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


@query("""WITH a AS (SELECT event_id, event_type, value, quantile_cont(value, 0.5) OVER (PARTITION BY event_type) AS center FROM events), b AS (SELECT *, quantile_cont(abs(value - center), 0.5) OVER (PARTITION BY event_type) AS mad FROM a)
SELECT event_id, event_type, value, round(center, 6) AS center, round(mad, 6) AS mad, round(CASE WHEN mad > 1e-12 THEN 0.67448975 * (value - center) / mad ELSE 0 END, 6) AS robust_z FROM b""")
def f_robust_z(spark, sf_dir):
    return distribution.robust_scores(events(spark, sf_dir).select("event_id", "event_type", "value"), ["event_type"], "value")


@query("WITH " + FEATURES_SQL + "," + MEMBERS_SQL + """, s AS (SELECT feature, count(value) FILTER (label > 0) AS na, count(value) FILTER (label = 0) AS nh, avg(value) FILTER (label > 0) AS ma, avg(value) FILTER (label = 0) AS mh, var_samp(value) FILTER (label > 0) AS va, var_samp(value) FILTER (label = 0) AS vh FROM feats JOIN episodes USING (user_id) GROUP BY 1)
SELECT feature, na, nh, round((ma - mh) / sqrt(((na - 1) * va + (nh - 1) * vh) / (na + nh - 2)), 6) AS effect_size FROM s""")
def st22_effect_sizes(spark, sf_dir):
    rows = study.long_features(spark, sf_dir).join(study.episodes(spark, sf_dir), "user_id").withColumn("anomaly", F.col("label") > 0)
    return distribution.effect_sizes(rows, ["feature"], "value", "anomaly")


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def st5_correlations(spark, sf_dir):
    return distribution.correlations(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")


_BOTH_SQL = MARKED_SQL + ", w AS (SELECT commissioning_n, seed, user_id, max(CASE WHEN detector = 'Diagonal' THEN score END) AS d, max(CASE WHEN detector = 'RobustDiagonal' THEN score END) AS r FROM m GROUP BY ALL)"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda d: F.max(F.when(F.col("detector") == d, F.col("score")))
    return marked(spark, sf_dir).groupBy("commissioning_n", "seed", "user_id").agg(of("Diagonal").alias("d"), of("RobustDiagonal").alias("r"))


@query("WITH " + _BOTH_SQL + " SELECT CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed, count(*) AS pairs, round(sum(sign((x.d - y.d) * (x.r - y.r))) / count(*), 6) AS tau, count(*) FILTER ((x.d - y.d) * (x.r - y.r) < 0) AS discordant FROM w x JOIN w y USING (commissioning_n, seed) WHERE x.user_id < y.user_id GROUP BY ALL")
def st6_kendall(spark, sf_dir):
    return distribution.kendall(_both(spark, sf_dir), ["commissioning_n", "seed"], "d", "r")


@query("WITH " + _BOTH_SQL + " SELECT CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed, round(regr_slope(r, d), 6) AS slope, round(regr_intercept(r, d), 6) AS intercept, round(regr_r2(r, d), 6) AS r2, round(quantile_cont(CASE WHEN d <> 0 THEN r / d END, 0.5), 6) AS median_ratio FROM w GROUP BY ALL")
def st7_score_agreement(spark, sf_dir):
    return distribution.linear_agreement(_both(spark, sf_dir), ["commissioning_n", "seed"], "d", "r")


# -- detectors as expressions ----------------------------------------------------------------------------------------


@query("WITH " + FEATURES_SQL + " SELECT feature, round(var_pop(value), 6) AS variance, row_number() OVER (ORDER BY var_pop(value) DESC, feature) AS rank FROM feats GROUP BY feature QUALIFY rank <= 3")
def o2_top_variance(spark, sf_dir):
    return detectors.top_variance_features(study.long_features(spark, sf_dir), 3)


@query("WITH " + FEATURES_SQL + "," + MEMBERS_SQL + """, ref AS (SELECT feature, value, quantile_cont(value, 0.5) OVER (PARTITION BY feature) AS center FROM feats JOIN parts USING (user_id) WHERE partition = 'reservoir'), sc AS (SELECT feature, max(center) AS center, quantile_cont(abs(value - center), 0.5) AS mad FROM ref GROUP BY 1),
z AS (SELECT user_id, feature, value, CASE WHEN mad > 1e-12 THEN 0.67448975 * (value - center) / mad ELSE 0 END AS rz FROM feats JOIN sc USING (feature))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(rz) DESC, feature) AS place, feature, round(value, 6) AS value, round(rz, 6) AS robust_z FROM z QUALIFY place <= 2""")
def m26_forensics(spark, sf_dir):
    long = study.long_features(spark, sf_dir)
    reference = long.join(study.partitions(spark, sf_dir).where("partition = 'reservoir'").select("user_id"), "user_id")
    return detectors.robust_forensics(long, reference, "user_id", 2, len(features.STATISTICS))


@query("""WITH e AS (SELECT vec_id, embedding, label FROM embeddings), q AS (SELECT vec_id, embedding FROM e WHERE vec_id % 50 = 0), r AS (SELECT vec_id AS rid, embedding AS re FROM e WHERE label = 0),
d AS (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(embedding, re), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS dist FROM q, r)
SELECT vec_id, round(dist, 6) AS score FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist) = least(10, count(*) OVER (PARTITION BY vec_id))""")
def m19_knn_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return detectors.nearest_distances(e.where("vec_id % 50 = 0"), e.where("label = 0"), "vec_id", "embedding", 10)


# -- detectors over matrices (no SQL: checked against numpy in the tests) ---------------------------------------------

#: The reference's commissioning sizes, and queries that are scored in one task.
COMMISSIONING = (10, 25, 50, 100)
QUERIES = 2048


def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as episodes: label 0 healthy, odd ids the source; every other label is a query.

    The target's commissioning sizes are those of COMMISSIONING that it has, beside all of it.
    """
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("episode"), F.col("embedding").cast("array<double>").alias("v"), "label")
    healthy = e.where("label = 0")
    even = healthy.where("episode % 2 = 0")
    whole = even.count()
    target = even.join(membership.seeded_rank(even.select("episode"), "episode", 1).select("episode", F.col("rank").alias("place")), "episode")
    sizes = F.explode(F.array(*[F.lit(n) for n in sorted({whole, *(n for n in COMMISSIONING if n <= whole)})])).alias("n")
    source = healthy.where("episode % 2 = 1").select(sizes, F.lit("source").alias("role"), "episode", "v")
    fit = target.select(sizes, "place", "episode", "v").where("place <= n").select("n", F.lit("target").alias("role"), "episode", "v")
    queries = e.where("label > 0").select(sizes, F.lit("query").alias("role"), "episode", "v")
    return source.unionByName(fit).unionByName(queries)


@query()
def m_matrix_detectors(spark, sf_dir):
    return matrix_detectors.score_queries(matrix_rows(spark, sf_dir), ["n"], list(matrix_detectors.SCORERS), QUERIES)


@query()
def m6_leave_one_out(spark, sf_dir):
    return moments.leave_one_out(matrix_rows(spark, sf_dir), ["n"], ["TargetOnly"])


@query()
def m17_transfer_metrics(spark, sf_dir):
    return kernels.transfer_metrics(matrix_rows(spark, sf_dir).where("role <> 'query'"), ["n"])


@query()
def m16_covariance_distances(spark, sf_dir):
    return moments.covariance_distances(matrix_rows(spark, sf_dir), ["n"])


@query()
def st29_conditioning(spark, sf_dir):
    return moments.conditioning(matrix_rows(spark, sf_dir), ["n"])


def phase_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's commissioning members as targets; every calibration, evaluation and anomaly user as query."""
    run = ["seed", "commissioning_n"]
    members = cut(study.commissioning(spark, sf_dir).select(*run, "user_id"))
    healthy = study.partitions(spark, sf_dir).where("partition <> 'reservoir'").select("user_id")
    queries = healthy.unionByName(study.episodes(spark, sf_dir).where("label > 0").select("user_id"))
    roles = members.withColumn("role", F.lit("target")).unionByName(members.select(*run).distinct().crossJoin(queries).withColumn("role", F.lit("query")))
    return roles.withColumnRenamed("user_id", "episode")


@query()
def m21_phase_aligned_neighbours(spark, sf_dir):
    telemetry = events(spark, sf_dir).select(F.col("user_id").alias("episode"), F.col("event_id").alias("at"), F.array("value").alias("v"))
    return matrix_detectors.aligned_phase_scores(telemetry, cut(phase_roles(spark, sf_dir)), ["seed", "commissioning_n"])
