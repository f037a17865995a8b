"""Decision ladders over aggregates, ranks, scales, folds and labels, each beside the SQL that DuckDB runs for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import distribution, graphs, membership, policies, summaries
from ..operators.order import average_ranks
from . import study
from .audits import _DELTA_SQL
from .catalog import events, query, runs, table
from .distributed import _DIFFERENT_SQL, _GRAPH_SQL, _OBSERVED_SQL, NULLS, correlation_graphs
from .study import MEMBERS_SQL

#: The first rung that holds decides; the order matters.
TRANSFER = (
    ("best_recall >= 0.05 AND false_alerts_at_best <= 0.005", "supports_transfer"), ("mean_delta < -0.02 OR worst_recall < -0.03", "negative_transfer"),
    ("abs(mean_delta) <= 0.03 AND best_recall < 0.05", "no_meaningful_benefit"),
)
GRAPH = (
    ("target_edges < 5", "more_healthy_data_required"), ("differential_ratio > 0.5", "differential_not_sparse"), ("sign_agreement < 0.6", "structure_unrelated"), ("passing < 0.8", "rows_disagree"),
    ("NOT (effect_size >= 1 AND identity_p <= 0.1 AND density_p <= 0.1)", "structure_unrelated"),
)


def _ladder_sql(rungs: tuple, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{label}'" for c, label in rungs) + f" ELSE '{otherwise}' END"


@query("WITH " + _DELTA_SQL + f""", k AS (SELECT commissioning_n, avg(delta) AS dr FROM dl GROUP BY 1),
fd AS (SELECT commissioning_n, seed, max(false_positive_rate) FILTER (detector = 'RobustDiagonal') - max(false_positive_rate) FILTER (detector = 'Diagonal') AS f FROM runs GROUP BY ALL), fk AS (SELECT commissioning_n, avg(f) AS df FROM fd GROUP BY 1),
g AS (SELECT max(dr) AS best_recall, min(dr) AS worst_recall, arg_max(commissioning_n, (dr, -commissioning_n)) AS best_n, arg_max(df, (dr, -commissioning_n)) AS false_alerts_at_best, (SELECT avg(delta) FROM dl) AS mean_delta FROM k JOIN fk USING (commissioning_n))
SELECT CAST(best_n AS BIGINT) AS best_n, round(best_recall, 6) AS best_recall, round(worst_recall, 6) AS worst_recall, round(false_alerts_at_best, 6) AS false_alerts_at_best, round(mean_delta, 6) AS mean_delta, {_ladder_sql(TRANSFER, 'inconclusive')} AS decision FROM g""")
def a26_transfer_decision(spark, sf_dir):
    """Whether one detector's paired gains over the other support it in some commissioning size, harm, or tell nothing."""
    d = cut(summaries.paired_delta(runs(spark, sf_dir), ["commissioning_n", "seed"], "detector", "Diagonal", "RobustDiagonal", ["recall", "false_positive_rate"]))
    by = d.groupBy("commissioning_n").agg(F.avg("delta_recall").alias("dr"), F.avg("delta_false_positive_rate").alias("df"), F.sum("delta_recall").alias("s"), F.count("delta_recall").alias("k"))
    order = F.struct("dr", -F.col("commissioning_n"))
    g = by.agg(F.max("dr").alias("best_recall"), F.min("dr").alias("worst_recall"), F.max_by("commissioning_n", order).alias("best_n"), F.max_by("df", order).alias("false_alerts_at_best"), (F.sum("s") / F.sum("k")).alias("mean_delta"))
    return policies.ladder(g, TRANSFER, "inconclusive").select("best_n", "best_recall", "worst_recall", "false_alerts_at_best", "mean_delta", "decision")


_NULL_SQL = {
    "density": f"l AS (SELECT *, unnest(range(1, {NULLS} + 1)) AS rep FROM (SELECT *, count(*) FILTER (es) OVER (PARTITION BY run) AS ns, count(*) FILTER (et) OVER (PARTITION BY run) AS nt FROM pr)), dd AS (SELECT run, rep, row_number() OVER (PARTITION BY run, rep ORDER BY md5(concat_ws(':', a, b, rep, 's'))) <= ns AS es, row_number() OVER (PARTITION BY run, rep ORDER BY md5(concat_ws(':', a, b, rep, 't'))) <= nt AS et FROM l), dj AS (SELECT run, rep, {_OBSERVED_SQL} AS j FROM dd GROUP BY ALL)",
    "identity": f"fr AS (SELECT f, rep, row_number() OVER (PARTITION BY rep ORDER BY f) AS n, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws(':', f, rep, 'f'))) AS m FROM (SELECT unnest(range(8)) AS f), (SELECT unnest(range(1, {NULLS} + 1)) AS rep)), nm AS MATERIALIZED (SELECT x.rep, x.f AS old, y.f AS new FROM fr x JOIN fr y ON x.rep = y.rep AND x.n = y.m), mv AS (SELECT run, p.rep, least(p.new, q.new) AS a, greatest(p.new, q.new) AS b, true AS moved FROM pr JOIN nm p ON p.old = a JOIN nm q ON q.old = b AND q.rep = p.rep WHERE et), dn AS (SELECT i.run, i.rep, es, coalesce(moved, false) AS et FROM (SELECT * EXCLUDE (et), unnest(range(1, {NULLS} + 1)) AS rep FROM pr) i LEFT JOIN mv USING (run, rep, a, b)), ij AS (SELECT run, rep, {_OBSERVED_SQL} AS j FROM dn GROUP BY ALL)",
}


@query("WITH " + _GRAPH_SQL + ", " + ", ".join(_NULL_SQL.values()) + f""", ob AS (SELECT run, {_OBSERVED_SQL} AS o, count(*) FILTER (et) AS te, CASE WHEN count(*) FILTER (es OR et) > 0 THEN {_DIFFERENT_SQL} / count(*) FILTER (es OR et) ELSE 0 END AS dr, avg(CAST(sign(rs) = sign(rt) AS DOUBLE)) FILTER (es AND et) AS sa FROM pr GROUP BY run),
xs AS (SELECT run, (o - avg(j)) / (stddev_samp(j) + 1e-12) AS es, (1 + count(*) FILTER (j >= o)) / (count(*) + 1) AS ip FROM ij JOIN ob USING (run) GROUP BY run, o), ds AS (SELECT run, (1 + count(*) FILTER (j >= o)) / (count(*) + 1) AS dp FROM dj JOIN ob USING (run) GROUP BY run, o),
al AS (SELECT *, te >= 5 AND es >= 1 AND ip <= 0.1 AND dp <= 0.1 AND dr <= 0.5 AND coalesce(sa >= 0.6, true) AS ok FROM ob JOIN xs USING (run) JOIN ds USING (run)),
gd AS (SELECT quantile_cont(te, 0.5) AS target_edges, quantile_cont(dr, 0.5) AS differential_ratio, quantile_cont(sa, 0.5) AS sign_agreement, avg(CAST(ok AS DOUBLE)) AS passing, quantile_cont(es, 0.5) AS effect_size, quantile_cont(ip, 0.5) AS identity_p, quantile_cont(dp, 0.5) AS density_p FROM al)
SELECT round(target_edges, 6) AS target_edges, round(differential_ratio, 6) AS differential_ratio, round(sign_agreement, 6) AS sign_agreement, round(passing, 6) AS passing, round(effect_size, 4) AS effect_size, round(identity_p, 6) AS identity_p, round(density_p, 6) AS density_p, {_ladder_sql(GRAPH, 'shared_structure')} AS decision FROM gd""")
def a26_graph_decision(spark, sf_dir):
    """Whether sources and target share a sparse structure: medians over all sources through an ordered ladder."""
    source, target = correlation_graphs(spark, sf_dir)
    seen = cut(graphs.overlap(source, target, ["run"]))
    identity = graphs.null_summary(seen, graphs.identity_null(source, target, ["run"], NULLS), ["run"]).select("run", "effect_size", F.col("empirical_p").alias("identity_p"))
    density = graphs.null_summary(seen, graphs.density_null(source, target, ["run"], NULLS), ["run"]).select("run", F.col("empirical_p").alias("density_p"))
    both = seen.join(identity, "run").join(density, "run")
    ok = F.expr("target_edges >= 5 AND effect_size >= 1 AND identity_p <= 0.1 AND density_p <= 0.1 AND differential_ratio <= 0.5 AND coalesce(sign_agreement >= 0.6, true)")
    middle = ["target_edges", "differential_ratio", "sign_agreement", "effect_size", "identity_p", "density_p"]
    g = both.agg(*[F.percentile(c, 0.5).alias(c) for c in middle], F.avg(ok.cast("double")).alias("passing"))
    return policies.ladder(g, GRAPH, "shared_structure").withColumn("effect_size", F.round("effect_size", 4))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS least_rank FROM lineitem")
def w7_minimum_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return average_ranks(rows, ["l_returnflag"], "l_quantity", "least_rank", "min").select("l_orderkey", "l_linenumber", "least_rank")


_SCALES_SQL = """c AS (SELECT user_id % 5 = 0 AS target, event_type, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id % 5 = 0, event_type) AS center FROM events WHERE value IS NOT NULL),
s AS (SELECT target, event_type, count(*) AS n_rows, any_value(center) AS center, 1.4826 * quantile_cont(abs(value - center), 0.5) AS mad_scale, (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 AS iqr_scale FROM c GROUP BY ALL)"""


def _scales(spark, sf_dir):
    rows = events(spark, sf_dir).where("value is not null").select("event_type", "value", (F.col("user_id") % 5 == 0).alias("target"))
    return distribution.robust_scales(rows, ["target", "event_type"], "value")


@query("WITH " + _SCALES_SQL + " SELECT target, event_type, n_rows, round(center, 6) AS center, round(mad_scale, 6) AS mad_scale, round(iqr_scale, 6) AS iqr_scale FROM s")
def m2_robust_scales(spark, sf_dir):
    return _scales(spark, sf_dir)


@query("WITH " + _SCALES_SQL + """ SELECT event_type, round(w, 6) AS target_weight, round(w * t.center + (1 - w) * s.center, 6) AS center, round(exp(w * ln(t.iqr_scale) + (1 - w) * ln(s.iqr_scale)), 6) AS scale
FROM (SELECT *, n_rows / (n_rows + 60.0) AS w FROM s WHERE target) t JOIN (SELECT * FROM s WHERE NOT target) s USING (event_type)""")
def m2_blended_scales(spark, sf_dir):
    """Centers and scales between the telemetry of a fifth of the users and that of the others."""
    scales = cut(_scales(spark, sf_dir))
    return distribution.blended_scales(scales.where("target").drop("target"), scales.where("not target").drop("target"), ["event_type"])


@query("WITH " + MEMBERS_SQL + " SELECT user_id, CAST(ntile(7) OVER (ORDER BY md5(concat(user_id, ':9')), user_id) - 1 AS BIGINT) AS fold FROM parts WHERE partition = 'reservoir'")
def x6_split_folds(spark, sf_dir):
    return membership.split_folds(study.partitions(spark, sf_dir).where("partition = 'reservoir'").select("user_id"), "user_id", 7, 9)


@query("""WITH l AS (SELECT user_id, printf('U%05d_%s_%s', user_id, upper(event_type[:3]), strftime(ts, '%Y%m')) AS label FROM events)
SELECT label, count(*) AS n_rows, CAST(regexp_extract(label, 'U(\\d+)', 1) AS BIGINT) AS user_id, regexp_extract(label, '_([A-Z]+)_', 1) AS kind, CAST(regexp_extract(label, '(\\d{4})\\d\\d$', 1) AS BIGINT) AS year, regexp_matches(label, '_(ERR|PUR)_') AS marked FROM l GROUP BY ALL""")
def f_run_labels(spark, sf_dir):
    """Labels with padded numbers and codes, and their parts taken back by patterns."""
    label = F.format_string("U%05d_%s_%s", F.col("user_id"), F.upper(F.substring("event_type", 1, 3)), F.date_format("ts", "yyyyMM"))
    named = events(spark, sf_dir).select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    part = lambda p: F.regexp_extract("label", p, 1)
    return named.select("label", "n_rows", part(r"U(\d+)").cast("long").alias("user_id"), part("_([A-Z]+)_").alias("kind"), part(r"(\d{4})\d\d$").cast("long").alias("year"), F.col("label").rlike("_(ERR|PUR)_").alias("marked"))
