"""Queries of statistics that add up over tasks, span reads and resampling, each beside the SQL that DuckDB runs for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.lineage import cut, shared_folder
from ..operators import graphs, kernels, moments, resampling, spans
from ..streaming import inventory
from . import catalog, study
from .audits import member_rows
from .catalog import matrix_rows, query, table
from .study import RUN, SCORES_SQL

#: Shifts in pooled deviations, replicates, level and target of the simulated power; replicates of bootstraps.
SHIFTS, POWER_REPLICATES, POWER_ALPHA, TARGET_POWER, BOOTSTRAPS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5), 200, 0.05, 0.8, 1000

# -- second moments ----------------------------------------------------------------------------------------------------

#: c: each vector about the mean of its label.
_CENTERED_SQL = """x AS MATERIALIZED (SELECT row_number() OVER () AS r, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), j AS (SELECT r, label, unnest(v) AS y, generate_subscripts(v, 1) AS k FROM x),
c AS MATERIALIZED (SELECT r, label, list(y - m ORDER BY k) AS c FROM (SELECT *, avg(y) OVER (PARTITION BY label, k) AS m FROM j) GROUP BY ALL)"""


@query("WITH " + _CENTERED_SQL + """, g AS (SELECT label, count(*) AS n, sum(list_inner_product(c, c)) AS t, sum(power(list_inner_product(c, c), 2)) AS f FROM c GROUP BY 1), s AS (SELECT label, sum(power(list_inner_product(a.c, b.c), 2)) AS s FROM c a JOIN c b USING (label) GROUP BY 1),
z AS (SELECT label, n, t / n AS trace, s / (n * n) AS fro, f / n AS fourth, 64.0 AS p FROM g JOIN s USING (label)), w AS (SELECT *, fro - trace * trace / p AS spread, (fourth - fro) / n AS noise FROM z)
SELECT CAST(label AS BIGINT) AS label, n AS n_rows, round(trace, 6) AS trace, round(fro, 6) AS frobenius_squared, least(n - 1, 64) AS matrix_rank, round(least(greatest(noise, 0), spread) / spread, 6) AS shrinkage FROM w""")
def m3_shrunk_moments(spark, sf_dir):
    """Trace, norm and rank of each label's covariance, and its Ledoit-Wolf shrinkage; vectors of one label are in general position."""
    return moments.shrinkage(table(spark, sf_dir, "embeddings"), ["label"], "embedding")


@query()
def m4_moment_detectors(spark, sf_dir):
    """Scores of all queries by the ten detectors that need moments alone (tests: equal to fits on the rows)."""
    return moments.score_queries(matrix_rows(spark, sf_dir), ["n"], list(moments.FITS))


@query()
def m12_covariance_choices(spark, sf_dir):
    """Cross-validated risk of each source prior and of the target's own estimators, and what is chosen."""
    return moments.covariance_choices(matrix_rows(spark, sf_dir), ["n"])


@query()
def m11_directional_audit(spark, sf_dir):
    """Along which of the target's directions the blend changes the scores, by the queries' labels."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("of"), "label")
    rows = matrix_rows(spark, sf_dir)
    return moments.directional_audit(rows.join(labels, F.col("episode") == F.col("of")), ["n"], "label")


# -- distances of domains ----------------------------------------------------------------------------------------------


def label_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label above 0 as a source, in a run of its own, against label 0 as the target."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("episode"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("run"))
    others = cut(e.where("run > 0").select("run").distinct())  # a row for each label
    source = e.where("run > 0").select("run", F.lit("source").alias("role"), "episode", "v")
    target = e.where("run = 0").drop("run").withColumn("run", F.explode(F.array(*[F.lit(r["run"]) for r in others.sort("run").collect()]))) if others.count() else e.where("false")
    return source.unionByName(target.select("run", F.lit("target").alias("role"), "episode", "v"))


@query("""WITH e AS MATERIALIZED (SELECT label AS d, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k, vec_id FROM embeddings), c AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY d, k) AS center, avg(x) OVER (PARTITION BY d, k) AS m FROM e),
s AS (SELECT k, 1.4826 * quantile_cont(abs(x - center), 0.5) AS scale FROM c WHERE d = 0 GROUP BY k), u AS MATERIALIZED (SELECT d, vec_id, list(greatest(-8.0, least(8.0, (x - center) / scale)) ORDER BY k) AS u FROM c JOIN s USING (k) GROUP BY ALL),
r AS MATERIALIZED (SELECT l.d AS run, u.d, u.vec_id, u.u FROM (SELECT DISTINCT d FROM u WHERE d > 0) l JOIN u ON u.d IN (0, l.d)),
q AS MATERIALIZED (SELECT a.run, a.d AS da, b.d AS db, a.vec_id AS ia, b.vec_id AS ib, greatest(0, list_inner_product(a.u, a.u) + list_inner_product(b.u, b.u) - 2 * list_inner_product(a.u, b.u)) AS s FROM r a JOIN r b USING (run)),
w AS (SELECT run, quantile_cont(s, 0.5) AS w FROM q WHERE ia < ib AND s > 0 GROUP BY 1), n AS (SELECT run, count(*) FILTER (d > 0) AS ns, count(*) FILTER (d = 0) AS nt FROM r GROUP BY 1),
k AS (SELECT run, sum(exp(CASE WHEN ia = ib THEN 0 ELSE -s / (2 * w) END) * (CASE WHEN da > 0 THEN 1.0 / ns ELSE -1.0 / nt END) * (CASE WHEN db > 0 THEN 1.0 / ns ELSE -1.0 / nt END)) AS mmd FROM q JOIN w USING (run) JOIN n USING (run) GROUP BY 1),
g AS (SELECT run, j, avg(x) FILTER (d > 0) - avg(x) FILTER (d = 0) AS gap, stddev_pop(x) FILTER (d > 0) - stddev_pop(x) FILTER (d = 0) AS spread FROM (SELECT run, d, unnest(u) AS x, generate_subscripts(u, 1) AS j FROM r) GROUP BY ALL),
h AS (SELECT run, sqrt(avg(gap * gap)) AS standardized_mean_shift, sqrt(sum(gap * gap) + sum(spread * spread)) AS wasserstein_diag FROM g GROUP BY 1),
b AS (SELECT run, sqrt(sum(power(m - m0, 2))) AS mean_shift_distance FROM (SELECT DISTINCT d AS run, k, m FROM c WHERE d > 0) JOIN (SELECT DISTINCT k, m AS m0 FROM c WHERE d = 0) USING (k) GROUP BY 1)
SELECT CAST(run AS BIGINT) AS run, metric, round(CASE metric WHEN 'mmd_rbf' THEN mmd WHEN 'standardized_mean_shift' THEN standardized_mean_shift WHEN 'wasserstein_diag' THEN wasserstein_diag ELSE mean_shift_distance END, 6) AS value
FROM k JOIN h USING (run) JOIN b USING (run), (SELECT unnest(['mmd_rbf', 'standardized_mean_shift', 'wasserstein_diag', 'mean_shift_distance']) AS metric)""")
def m17_label_discrepancy(spark, sf_dir):
    """Kernel discrepancy, mean shifts and diagonal Wasserstein distance of each label against label 0."""
    found = kernels.transfer_metrics(label_domains(spark, sf_dir), ["run"])
    return found.where(F.col("metric").isin("mmd_rbf", "standardized_mean_shift", "wasserstein_diag", "mean_shift_distance"))


# -- spans of rows -------------------------------------------------------------------------------------------------------

_SPANS_SQL = "sp AS (SELECT event_id AS episode, event_id AS first_row, event_id + 1 + CAST(floor(value) AS BIGINT) % 64 AS stop_row FROM events WHERE event_type = 'error')"


def error_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each error on, as many rows of the telemetry as its value says: an inventory of spans of all lengths."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("episode"), F.col("event_id").alias("first_row"), (F.col("event_id") + 1 + F.floor("value").cast("long") % 64).alias("stop_row"))


@query("WITH " + _SPANS_SQL + " SELECT episode, event_id, user_id, round(value, 6) AS value FROM sp JOIN events ON event_id BETWEEN first_row AND stop_row - 1")
def s6_span_rows(spark, sf_dir):
    return spans.read_spans(table(spark, sf_dir, "events"), error_spans(spark, sf_dir), [], "event_id", "episode", ["user_id", "value"])


@query("WITH " + _SPANS_SQL + """, g AS (SELECT *, max(stop_row) OVER (ORDER BY first_row, episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp)
SELECT episode, first_row, stop_row, first_row - reach AS gap, coalesce(first_row < reach, false) AS overlaps FROM g""")
def s7_span_neighbours(spark, sf_dir):
    return spans.neighbours(error_spans(spark, sf_dir), [], "episode")


@query("SELECT user_id, min(event_id) AS first_row, max(event_id) + 1 AS stop_row, count(*) AS n_rows, count(*) = max(event_id) + 1 - min(event_id) AS contiguous FROM events GROUP BY 1")
def s7_span_inventory(spark, sf_dir):
    return spans.inventory(table(spark, sf_dir, "events"), [], "user_id", "event_id")


# -- resampling ----------------------------------------------------------------------------------------------------------

_HASH = moments.PRIME
_COUNT_SQL = " + ".join(f"CAST(h2 >= {t} AS INTEGER)" for t in moments.POISSON)


def _bootstrap_sql(rows: str, replicates: int = BOOTSTRAPS) -> str:
    """CTEs over ``rows`` (g, x, y, id): c with g, replicate and correlation r."""
    return f"""u AS MATERIALIZED ({rows}), a AS (SELECT avg(x) AS ax, avg(y) AS ay FROM u), h AS (SELECT g, x - ax AS x, y - ay AS y, replicate, (id % {_HASH} * {moments.ROW_STEP} + replicate * {moments.REPLICATE_STEP}) % {_HASH} AS h0 FROM u, a, (SELECT unnest(range(0, {replicates} + 1)) AS replicate)),
i AS (SELECT *, h0 * ((h0 + {moments.MIX[0]}) % {_HASH}) % {_HASH} AS h1 FROM h), k AS (SELECT *, h1 * ((h1 + {moments.MIX[1]}) % {_HASH}) % {_HASH} AS h2 FROM i), w AS (SELECT g, replicate, x, y, CASE WHEN replicate = 0 THEN 1 ELSE {_COUNT_SQL} END AS w FROM k),
s AS (SELECT g, replicate, sum(w) AS w, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy FROM w GROUP BY ALL HAVING sum(w) > 0),
c AS (SELECT g, replicate, w, (sxy - sx * sy / w) / sqrt((sxx - sx * sx / w) * (syy - sy * sy / w)) AS r FROM s)"""


_INTERVAL_SQL = "CAST(max(w) FILTER (replicate = 0) AS BIGINT) AS n_rows, round(max(r) FILTER (replicate = 0), 6) AS correlation, round(quantile_cont(r, 0.025) FILTER (replicate > 0), 6) AS ci_low, round(quantile_cont(r, 0.975) FILTER (replicate > 0), 6) AS ci_high"
_LINES_SQL = "SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y, l_orderkey * 8 + l_linenumber AS id FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))


@query("WITH " + _bootstrap_sql(_LINES_SQL) + f" SELECT g AS l_returnflag, {_INTERVAL_SQL} FROM c GROUP BY 1")
def st5_bootstrap(spark, sf_dir):
    """Pearson's correlation of quantity and price with its bootstrap interval."""
    return resampling.bootstrap_correlation(_lines(spark, sf_dir), ["l_returnflag"], "l_quantity", "l_extendedprice", "line", BOOTSTRAPS)


@query("WITH v AS (" + _LINES_SQL + "), " + _bootstrap_sql("SELECT g, id, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS y FROM v") + f" SELECT g AS l_returnflag, {_INTERVAL_SQL} FROM c GROUP BY 1")
def st5_rank_bootstrap(spark, sf_dir):
    """Spearman's correlation with the interval of replicates that weigh the ranks."""
    return resampling.bootstrap_correlation(_lines(spark, sf_dir), ["l_returnflag"], "l_quantity", "l_extendedprice", "line", BOOTSTRAPS, ranks=True)


def _two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.scores(spark, sf_dir).where("partition in ('calibration', 'evaluation')").withColumn("second", F.col("partition") == "evaluation")


def _tests(spark: SparkSession, sf_dir: str, shifts: tuple[float, ...], replicates: int) -> DataFrame:
    return resampling.simulated_tests(cut(_two_samples(spark, sf_dir)), RUN, "score", "second", shifts, replicates)


@query("WITH " + SCORES_SQL + f""", t AS MATERIALIZED (SELECT detector, commissioning_n, seed, score, partition = 'evaluation' AS b FROM scores WHERE partition IN ('calibration', 'evaluation')),
g AS (SELECT detector, commissioning_n, seed, count(*) FILTER (NOT b) AS na, count(*) FILTER (b) AS nb, avg(score) AS m, stddev_samp(score) AS sd FROM t GROUP BY ALL), o AS (SELECT detector, commissioning_n, seed, score, row_number() OVER (PARTITION BY detector, commissioning_n, seed ORDER BY score) - 1 AS place FROM t),
d AS (SELECT *, unnest(range(1, na + nb + 1)) AS i FROM (SELECT *, unnest(range(1, 61)) AS replicate FROM g)), p AS (SELECT *, ('0x' || substr(md5(concat_ws(':', detector, commissioning_n, seed, replicate, i)), 1, 8))::BIGINT % (na + nb) AS place FROM d),
zs AS MATERIALIZED (SELECT detector, commissioning_n, seed, replicate, na, nb, i > na AS later, (score - m) / sd AS z FROM p JOIN o USING (detector, commissioning_n, seed, place)), f AS (SELECT *, CASE WHEN later THEN z + shift ELSE z END AS x FROM zs, (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS shift)),
n AS (SELECT detector, commissioning_n, seed, replicate, shift, na, nb, x, count(*) FILTER (NOT later) AS a, count(*) FILTER (later) AS b FROM f GROUP BY ALL),
c AS (SELECT *, abs(sum(a) OVER w / na - sum(b) OVER w / nb) AS gap FROM n WINDOW w AS (PARTITION BY detector, commissioning_n, seed, replicate, shift ORDER BY x)), k AS (SELECT detector, commissioning_n, seed, replicate, shift, max(gap) AS ks FROM c GROUP BY ALL)
SELECT detector, CAST(commissioning_n AS BIGINT) AS commissioning_n, CAST(seed AS BIGINT) AS seed, shift, count(*) AS replicates, round(avg(ks), 6) AS mean_ks FROM k GROUP BY ALL""")
def st18_simulated_distances(spark, sf_dir):
    """The mean distance of 60 simulated pairs of samples at three shifts."""
    return resampling.power_curve(_tests(spark, sf_dir, (0.0, 0.5, 1.0), 60), RUN, POWER_ALPHA).select(*RUN, "shift", "replicates", "mean_ks")


@query()
def st18_power_curve(spark, sf_dir):
    """The share of 200 simulated pairs that the exact test rejects, at each shift of each run."""
    return resampling.power_curve(_tests(spark, sf_dir, SHIFTS, POWER_REPLICATES), RUN, POWER_ALPHA)


@query()
def st18_detectable_shift(spark, sf_dir):
    """The smallest shift that each detector and size finds with the target power, on average over its seeds."""
    curve = resampling.power_curve(_tests(spark, sf_dir, SHIFTS, POWER_REPLICATES), RUN, POWER_ALPHA)
    return resampling.detectable_shifts(curve, ["detector", "commissioning_n"], TARGET_POWER)


# -- graphs ----------------------------------------------------------------------------------------------------------------

#: Features of the correlation graphs, the correlation that makes an edge, replicates of the nulls; penalties of the lasso.
GRAPH_FEATURES, GRAPH_EDGE, NULLS, PENALTIES, EDGE_NULLS, LENT_FEATURES, LENT_BOUND = 8, 0.15, 199, (0.05, 0.1, 0.2, 0.4), 99, 16, 0.2

_GRAPH_SQL = f"""v AS (SELECT label, a, b, CAST(embedding[a + 1] AS DOUBLE) AS x, CAST(embedding[b + 1] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range({GRAPH_FEATURES})) AS a), (SELECT unnest(range({GRAPH_FEATURES})) AS b) WHERE a < b),
g AS MATERIALIZED (SELECT label, a, b, corr(x, y) AS r, abs(corr(x, y)) >= {GRAPH_EDGE} AS e FROM v GROUP BY ALL), pr AS MATERIALIZED (SELECT s.label AS run, s.a, s.b, s.r AS rs, t.r AS rt, s.e AS es, t.e AS et FROM g s JOIN g t USING (a, b) WHERE s.label > 0 AND t.label = 0)"""


def correlation_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Graphs of correlated components: each label above 0 as a source, label 0 as the target of all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("run"), "embedding")
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(GRAPH_FEATURES) for b in range(a + 1, GRAPH_FEATURES)])
    long = e.withColumn("pair", F.explode(pairs)).select("run", "pair.a", "pair.b", F.col("embedding")[F.col("pair.a")].cast("double").alias("x"), F.col("embedding")[F.col("pair.b")].cast("double").alias("y"))
    graph = long.groupBy("run", "a", "b").agg(F.corr("x", "y").alias("partial"))
    graph = cut(graph.select("run", "a", "b", F.abs("partial").alias("probability"), "partial", (F.abs("partial") >= GRAPH_EDGE).alias("stable")))
    runs = graph.where("run > 0").select("run").distinct()
    # As many rows as there are labels and pairs of components.
    return graph.where("run > 0"), graph.where("run = 0").drop("run").join(F.broadcast(runs))


@query("WITH " + _GRAPH_SQL + f" SELECT run, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CASE WHEN es <> et THEN 'support' ELSE 'weight' END AS kind, round(rs, 6) AS source_partial, round(rt, 6) AS target_partial FROM (SELECT CAST(run AS BIGINT) AS run, * EXCLUDE (run) FROM pr) WHERE es <> et OR (es AND et AND abs(rt - rs) >= {graphs.CHANGED})")
def m14_differential_edges(spark, sf_dir):
    found = graphs.differential_edges(*correlation_graphs(spark, sf_dir), ["run"])
    return found.select("run", "a", "b", "kind", "source_partial", "target_partial")


_OBSERVED_SQL = "CASE WHEN count(*) FILTER (es OR et) > 0 THEN count(*) FILTER (es AND et) / count(*) FILTER (es OR et) ELSE 1 END"
_DIFFERENT_SQL = f"count(*) FILTER (es <> et OR (es AND et AND abs(rt - rs) >= {graphs.CHANGED}))"


@query("WITH " + _GRAPH_SQL + f""" SELECT CAST(run AS BIGINT) AS run, count(*) FILTER (es) AS source_edges, count(*) FILTER (et) AS target_edges, count(*) FILTER (es AND et) AS shared_edges, {_DIFFERENT_SQL} AS differential_edges, round({_OBSERVED_SQL}, 6) AS jaccard,
round(CASE WHEN count(*) FILTER (es OR et) > 0 THEN {_DIFFERENT_SQL} / count(*) FILTER (es OR et) ELSE 0 END, 6) AS differential_ratio, round(sum(least(abs(rs), abs(rt))) / (sum(greatest(abs(rs), abs(rt))) + 1e-12), 6) AS weighted_overlap,
round(avg(CAST(sign(rs) = sign(rt) AS DOUBLE)) FILTER (es AND et), 6) AS sign_agreement, round(quantile_cont(abs(rt - rs), 0.5) FILTER (es AND et), 6) AS median_partial_gap FROM pr GROUP BY run""")
def m14_graph_overlap(spark, sf_dir):
    return graphs.overlap(*correlation_graphs(spark, sf_dir), ["run"])


_SUMMARY_SQL = """SELECT CAST(run AS BIGINT) AS run, round(o, 6) AS observed, round(avg(j), 6) AS null_mean, round(stddev_samp(j), 6) AS null_std, round(quantile_cont(j, 0.95), 6) AS null_q95, round((1 + count(*) FILTER (j >= o)) / (count(*) + 1), 6) AS empirical_p,
round((o - avg(j)) / (stddev_samp(j) + 1e-12), 4) AS effect_size FROM jn JOIN ob USING (run) GROUP BY run, o"""


def _summary(spark: SparkSession, sf_dir: str, null) -> DataFrame:
    source, target = correlation_graphs(spark, sf_dir)
    found = graphs.null_summary(graphs.overlap(source, target, ["run"]), null(source, target, ["run"], NULLS), ["run"])
    return found.withColumn("effect_size", F.round("effect_size", 4))


@query("WITH " + _GRAPH_SQL + f""", ob AS (SELECT run, {_OBSERVED_SQL} AS o FROM pr GROUP BY run), k AS (SELECT *, count(*) FILTER (es) OVER (PARTITION BY run) AS ns, count(*) FILTER (et) OVER (PARTITION BY run) AS nt FROM pr), l AS (SELECT *, unnest(range(1, {NULLS} + 1)) AS rep FROM k),
d AS (SELECT run, rep, row_number() OVER (PARTITION BY run, rep ORDER BY md5(concat_ws(':', a, b, rep, 's'))) <= ns AS es, row_number() OVER (PARTITION BY run, rep ORDER BY md5(concat_ws(':', a, b, rep, 't'))) <= nt AS et FROM l), jn AS (SELECT run, rep, {_OBSERVED_SQL} AS j FROM d GROUP BY ALL) """ + _SUMMARY_SQL)
def m14_density_null(spark, sf_dir):
    """The graphs' overlap against random graphs with as many edges."""
    return _summary(spark, sf_dir, graphs.density_null)


@query("WITH " + _GRAPH_SQL + f""", ob AS (SELECT run, {_OBSERVED_SQL} AS o FROM pr GROUP BY run), fr AS (SELECT f, rep, row_number() OVER (PARTITION BY rep ORDER BY f) AS n, row_number() OVER (PARTITION BY rep ORDER BY md5(concat_ws(':', f, rep, 'f'))) AS m FROM (SELECT unnest(range({GRAPH_FEATURES})) AS f), (SELECT unnest(range(1, {NULLS} + 1)) AS rep)),
nm AS MATERIALIZED (SELECT x.rep, x.f AS old, y.f AS new FROM fr x JOIN fr y ON x.rep = y.rep AND x.n = y.m), mv AS (SELECT run, p.rep, least(p.new, q.new) AS a, greatest(p.new, q.new) AS b, true AS moved FROM pr JOIN nm p ON p.old = a JOIN nm q ON q.old = b AND q.rep = p.rep WHERE et),
d AS (SELECT l.run, l.rep, es, coalesce(moved, false) AS et FROM (SELECT * EXCLUDE (et), unnest(range(1, {NULLS} + 1)) AS rep FROM pr) l LEFT JOIN mv USING (run, rep, a, b)), jn AS (SELECT run, rep, {_OBSERVED_SQL} AS j FROM d GROUP BY ALL) """ + _SUMMARY_SQL)
def m14_identity_null(spark, sf_dir):
    """The graphs' overlap against the target's graph under random names of its components."""
    return _summary(spark, sf_dir, graphs.identity_null)


@query()
def m14_penalty_profile(spark, sf_dir):
    """How stable the lasso's edges are at each penalty for the study's members, and which penalty is taken."""
    return graphs.penalty_profile(graphs.edge_stability(member_rows(spark, sf_dir), ["seed"], PENALTIES), ["seed"])


@query()
def m14_edge_p_values(spark, sf_dir):
    """Each pair of the study's features against graphs of permuted columns."""
    return graphs.edge_p_values(cut(member_rows(spark, sf_dir)), ["seed"], 0.1, EDGE_NULLS)


@query()
def m13_lent_precision(spark, sf_dir):
    """Edges of the cross-fitted precision of the target, its columns from itself or through the source."""
    rows = matrix_rows(spark, sf_dir).where("role <> 'query'").withColumn("v", F.slice("v", 1, LENT_FEATURES))
    return graphs.lent_edges(rows, ["n"], LENT_BOUND)


# -- keyed state, table and aggregate functions ------------------------------------------------------------------------------

_STATE_SQL = catalog.oracle_sql()["a3_episode_inventory"].replace("AS labels FROM r", "AS labels, CAST(0 AS BIGINT) AS late_rows, false AS closed FROM r")


@query(_STATE_SQL)
def a3_stream_inventory(spark, sf_dir):
    """The telemetry read as a stream into keyed state, which gives the same inventory as the batch."""
    events = table(spark, sf_dir, "events")
    path, checkpoint = shared_folder(spark, "inventory"), shared_folder(spark, "inventory-state")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")  # a pattern may name a file
    # The table spans 30 days; rows of a file come in any order.
    inventory.run_inventory(stream, path, checkpoint, "user_id", "ts", "event_id", "event_type", lateness=40 * 86400.0, retention=80 * 86400.0)
    out = inventory.latest(spark, path, "user_id")
    return out.withColumns({c: F.round(c, 3) for c in ("mean_step", "std_step", "min_step", "max_step")})


@query("SELECT event_type, threshold, count(*) FILTER (value <= threshold) AS n_rows FROM events, (SELECT unnest(range(0, 401, 50))::DOUBLE AS threshold) GROUP BY ALL")
def t_grid_counts(spark, sf_dir):
    """A table function over the telemetry, called from SQL: rows up to each threshold of a grid."""
    tables.register(spark)
    counts = spark.sql("SELECT * FROM grid_counts(TABLE({events}), 'event_type', 'value', 0D, 400D, 8)", events=table(spark, sf_dir, "events").select("event_type", "value"))
    return counts.groupBy("event_type", "threshold").agg(F.sum("n_rows").alias("n_rows"))


@query("SELECT event_type, round(ln(sum(exp(value / 100 - m))) + any_value(m), 6) AS log_sum FROM (SELECT *, max(value / 100) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY 1")
def t_log_sum_exp(spark, sf_dir):
    """A grouped aggregate in pandas, called from SQL: by salt first, then by key."""
    tables.register(spark)
    salted = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("x"), F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("salt"))
    return spark.sql("SELECT event_type, log_sum_exp(part) AS log_sum FROM (SELECT event_type, log_sum_exp(x) AS part FROM {salted} GROUP BY event_type, salt) GROUP BY event_type", salted=salted)
