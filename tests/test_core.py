"""Facts about thresholds, ranks, guards and kernels, and every catalogued query against its SQL on the smallest tables."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import columns as C
from episodica.functions import linalg as L
from episodica.operators import conformal, distribution, features, guards, matrix_detectors, membership, roc
from episodica.plans import audits, catalog  # noqa: F401  (importing a module registers its queries)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def scores(spark, healthy, anomalous):
    rows = [("r", float(x), False) for x in healthy] + [("r", float(x), True) for x in anomalous]
    return spark.createDataFrame(rows, "run string, score double, is_anomaly boolean")


@pytest.mark.parametrize(("m", "alpha", "rank", "feasible", "threshold"), [(100, 0.01, 100, True, 99.0), (50, 0.01, 51, False, math.inf), (100, 0.02, 99, True, 98.0), (119, 0.01, 119, True, 118.0)])
def test_conformal_rank_facts(spark, m, alpha, rank, feasible, threshold):
    rows = spark.createDataFrame([("r", float(i)) for i in range(m)], "run string, score double")
    got = conformal.conformal_thresholds(rows, ["run"], alpha).first()
    assert (got.raw_rank, got.feasible, got.strict_threshold) == (rank, feasible, threshold)


def test_rank_landmarks(spark):
    table = {(r.m, r.alpha): r for r in conformal.rank_table(spark.createDataFrame([(m,) for m in (98, 99, 198, 199)], "m long"), "m", (0.01,)).collect()}
    assert [table[m, 0.01].finite for m in (98, 99)] == [False, True]
    assert [table[m, 0.01].is_maximum for m in (99, 198, 199)] == [True, True, False]


def test_superiority_counts_ties_half(spark):
    got = roc.auroc(scores(spark, [0, 1], [1, 2]), ["run"]).first()
    assert (got.auroc, got.auroc_strict) == (0.875, 0.75)


def test_oracle_with_one_extreme_healthy_score(spark):
    s = scores(spark, [0, 1, 100], [10, 11, 12, 13])
    got = {r.allowed: r.max_recall for r in roc.count_sensitivity(s, ["run"], [0, 1]).collect()}
    assert got == {0: 0.0, 1: 1.0}
    assert roc.oracle_feasibility(s, ["run"], 0.1, 0.9).first().max_recall == 0.0
    assert roc.oracle_feasibility(scores(spark, range(100), range(200, 300)), ["run"], 0.01, 0.9).first().feasible


def test_episode_features_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = {e: rng.normal(size=n) for e, n in ((1, 7), (2, 12))}
    rows = [(e, t, float(v)) for e, s in x.items() for t, v in enumerate(s)]
    got = features.episode_features(spark.createDataFrame(rows, "e int, t int, s double"), "e", ["t"], ["s"]).collect()
    for r in got:
        v = x[r.e]
        want = [v.mean(), v.std(ddof=1), np.median(v), *np.quantile(v, [0.25, 0.75]), np.abs(np.diff(v)).sum()]
        assert np.allclose([r.s__mean, r.s__std, r.s__median, r.s__q25, r.s__q75, r.s__total_variation], want)


def test_membership_is_nested_disjoint_and_independent_of_partitions(spark):
    ids = spark.range(200).withColumnRenamed("id", "e")
    parts = membership.fixed_partitions(ids, "e", 0.3, 0.2)
    assert not guards.overlaps(parts, "e", "partition", []).count()
    nested = membership.nested_commissioning(parts.where("partition = 'reservoir'"), "e", (0, 1), (5, 20))
    assert not guards.not_nested(nested, "e", ["seed"], "commissioning_n").count()
    again = membership.fixed_partitions(ids.repartition(7), "e", 0.3, 0.2)
    assert {tuple(r) for r in parts.collect()} == {tuple(r) for r in again.collect()}


def test_guards(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, float("nan"), 2), (2, 1.0, 2)], "e int, x double, c int")
    assert guards.not_finite(df, ["x"]).count() == 1
    assert [r.e for r in guards.not_constant(df, "e", ["c"]).collect()] == [1]
    with pytest.raises(ValueError, match="repeated"):
        guards.require_none(guards.repeated_keys(df, ["e"]), "repeated")
    grid = spark.createDataFrame([(1,), (2,)], "k int")
    seen = spark.createDataFrame([(2,), (2,), (3,)], "k int")
    assert {(r.k, r.status) for r in guards.missing_and_unexpected(grid, seen, ["k"]).collect()} == {(1, "missing"), (2, "duplicate"), (3, "unexpected")}


def test_boolean_parsing(spark):
    df = spark.createDataFrame([(" Yes",), ("0",), ("TRUE",)], "t string")
    assert [r.b for r in df.select(C.boolean_of(F.col("t")).alias("b")).collect()] == [True, False, True]
    with pytest.raises(Exception, match="not a boolean"):
        spark.createDataFrame([("maybe",)], "t string").select(C.boolean_of(F.col("t"))).collect()


def test_phase_resampling_is_linear_interpolation(spark):
    v = [0.0, 2.0, 1.0, 5.0]
    rows = spark.createDataFrame([(1, t, x) for t, x in enumerate(v)] + [(2, 0, 3.0)], "e int, t int, x double")
    got = features.phase_resampled(rows, "e", ["t"], "x", 10).orderBy("e", "bin").collect()
    assert np.allclose([r.value for r in got if r.e == 1], np.interp(np.linspace(0, 3, 10), range(4), v))
    assert [r.value for r in got if r.e == 2] == [3.0] * 10


def test_two_sample_statistics(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 6.0]
    rows = spark.createDataFrame([("k", x, False) for x in a] + [("k", x, True) for x in b], "k string, x double, second boolean")
    got = distribution.two_sample(rows, ["k"], "x", "second").first()
    grid = sorted({*a, *b})
    cdf = lambda s: np.array([np.mean(np.array(s) <= g) for g in grid])
    assert math.isclose(got.ks, np.abs(cdf(a) - cdf(b)).max())
    assert math.isclose(got.wasserstein, (np.abs(cdf(a) - cdf(b))[:-1] * np.diff(grid)).sum())
    assert got.mann_whitney_u == sum((y > x) + 0.5 * (y == x) for x in a for y in b)


def test_kernels():
    rng = np.random.default_rng(1)
    s, t = rng.normal(size=(40, 6)), rng.normal(size=(12, 6))
    _, cov, shrink = L.shrunk_covariance(t)
    assert 0 <= shrink <= 1 and np.all(np.linalg.eigvalsh(cov) > 0)
    same = L.transfer_metrics(s, s)
    assert same["mmd_rbf"] < 1e-12 and math.isclose(same["projector_similarity"], 1.0) and same["mean_shift_distance"] == 0
    assert L.transfer_metrics(s + 3, t)["mean_shift_distance"] > L.transfer_metrics(s, t)["mean_shift_distance"]
    assert L.covariance_distances(cov, cov)["bures_wasserstein"] < 1e-6
    assert np.allclose(L.warped(t, t, 2), t)


def test_no_source_weight_is_the_target_alone():
    rng = np.random.default_rng(2)
    s, t = rng.normal(size=(30, 4)), rng.normal(size=(15, 4))
    blend = matrix_detectors.blended(s, t, 0.0)
    assert np.allclose(blend["b"][1], blend["t"][1]) and np.allclose(blend["b"][0], blend["t"][0])
    assert matrix_detectors.safe_transfer_weight(100 * s, t) == 0.0


@pytest.mark.parametrize("name", sorted(matrix_detectors.SCORERS))
def test_every_detector_ranks_an_outlier_first(name):
    rng = np.random.default_rng(3)
    s, t, q = rng.normal(size=(60, 5)), rng.normal(size=(30, 5)), np.vstack([rng.normal(size=(10, 5)), np.full((1, 5), 9.0)])
    got = matrix_detectors.SCORERS[name](s, t, q)
    assert got.shape == (11,) and np.isfinite(got).all() and got.argmax() == 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_matrix_queries_use_whole_vectors_and_every_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(0, 1, 24) + np.arange(24) * (i % 3 > 0) for i in range(90)}
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    vectors = {i: v.astype(np.float32).astype(float) for i, v in vectors.items()}
    members = {}
    for r in catalog.matrix_rows(spark, str(tmp_path)).collect():
        assert np.array_equal(r.v, vectors[r.episode])
        members.setdefault((r.n, r.role), []).append(r.episode)
    queries = [i for i in vectors if i % 3]
    assert {n for n, _ in members} == {10, 15} and all(sorted(members[n, "query"]) == queries and len(members[n, "target"]) == n for n in (10, 15))
    assert sorted(members[15, "target"]) == [i for i in vectors if i % 6 == 0] and sorted(members[15, "source"]) == [i for i in vectors if i % 6 == 3]
    of = lambda n, role: np.array([vectors[i] for i in sorted(members[n, role])])
    got = {(r.n, r.detector, r.episode): r.score for r in catalog.m_matrix_detectors(spark, str(tmp_path)).collect()}
    for n in (10, 15):
        for name, scorer in matrix_detectors.SCORERS.items():
            assert np.allclose([got.pop((n, name, i)) for i in queries], scorer(of(n, "source"), of(n, "target"), of(n, "query")), rtol=1e-6)
    assert not got
    left = {(r.n, r.episode): r.score for r in catalog.m6_leave_one_out(spark, str(tmp_path)).collect()}
    for n in (10, 15):
        t, ids = of(n, "target"), sorted(members[n, "target"])
        assert np.allclose([left.pop((n, i)) for i in ids], [matrix_detectors.SCORERS["TargetOnly"](None, np.delete(t, k, axis=0), t[k : k + 1])[0] for k in range(n)], rtol=1e-6)
    assert not left
    few = matrix_detectors.batched(catalog.matrix_rows(spark, str(tmp_path)), 7)
    again = {(r.n, r.episode): r.score for r in matrix_detectors.run_scores(few, ["n", "batch"], ["Pooled"]).collect()}
    assert np.allclose([again[10, i] for i in queries], matrix_detectors.SCORERS["Pooled"](of(10, "source"), of(10, "target"), of(10, "query")), rtol=1e-6)


def test_matrix_queries_fit_each_detector_once_a_run(spark, tmp_path, monkeypatch):
    """However many tasks score the queries: a fit leaves a file for each time that it ran."""
    rng, fits = np.random.default_rng(6), tmp_path / "fits"
    fits.mkdir()
    rows = [(i, rng.normal(size=5).tolist(), int(i % 3 > 0)) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))

    def counted(s, t):
        import uuid

        (fits / f"{len(t)}-{uuid.uuid4().hex}").touch()
        return lambda q: q[:, 0] - t[0, 0]

    for registry in ("SCORERS", "FITS"):
        monkeypatch.setattr(matrix_detectors, registry, dict(getattr(matrix_detectors, registry)))
    matrix_detectors.register_fit("Counted", counted)
    monkeypatch.setattr(catalog, "QUERIES", 7)
    got = catalog.m_matrix_detectors(spark, str(tmp_path)).where("detector = 'Counted'").collect()
    assert {(r.n, r.episode) for r in got} == {(n, i) for n in (10, 20) for i, _, label in rows if label} and len(got) == 160
    assert sorted(f.name.split("-")[0] for f in fits.iterdir()) == ["10", "20"]
    few = catalog.matrix_rows(spark, str(tmp_path)).where("n = 10 or role <> 'query'")
    assert {r.n for r in matrix_detectors.score_queries(few, ["n"], ["Pooled"], 9).collect()} == {10}
    assert matrix_detectors.score_queries(few.where("role <> 'source'"), ["n"], ["Pooled"], 9).count() == 0
    assert matrix_detectors.score_queries(few.where("role <> 'query'"), ["n"], ["Pooled"], 9).count() == 0


def test_phase_neighbours_score_every_query_of_the_study(spark):
    telemetry = {}
    for r in catalog.events(spark, DATA).orderBy("event_id").collect():
        telemetry.setdefault(r.user_id, []).append([r.value])
    parts = {r.user_id: r.partition for r in catalog.study.partitions(spark, DATA).collect()}
    queries = {u for u in telemetry if parts.get(u) != "reservoir"}
    runs = {}
    for r in catalog.study.commissioning(spark, DATA).collect():
        runs.setdefault((r.seed, r.commissioning_n), []).append(r.user_id)
    got = {(r.seed, r.commissioning_n, r.episode): r.score for r in catalog.m21_phase_aligned_neighbours(spark, DATA).collect()}
    assert len(got) == len(runs) * len(queries) and {u for _, _, u in got} == queries
    run = min(runs)
    members, one = sorted(runs[run]), min(queries)
    every = np.vstack([telemetry[u] for u in members])
    frame = lambda u: (np.array(telemetry[u], float) - every.mean(axis=0)) / every.std(axis=0)
    profile = lambda u: (lambda w: np.interp(np.linspace(0, 1, 128), np.linspace(0, 1, len(w)), w[:, 0]))(L.warped(frame(u), frame(members[0]), 2))
    distances = sorted(np.linalg.norm(profile(u) - profile(one)) for u in members)
    assert math.isclose(got[*run, one], distances[min(10, len(members)) - 1], rel_tol=1e-9)


def test_bootstrap_has_the_references_replicates(spark):
    name = "st1_bootstrap_mean_10000"
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    assert "range(1, 10001)" in catalog.oracle_sql()[name]
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, catalog.queries()[name](spark, DATA).collect())) == sorted(want)


def test_catalogue_against_duckdb(spark, monkeypatch):
    import duckdb

    from episodica.plans import audits, catalog, decisions, distributed, study  # noqa: F401

    # Forty queries start from the same score table, which is computed once here.
    scores = study.scores(spark, DATA).cache()
    monkeypatch.setattr(study, "scores", lambda _, folder: scores if folder == DATA else None)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    value = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    wrong = []
    for name, sql in catalog.oracle_sql().items():
        got = catalog.queries()[name](spark, DATA)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        theirs = sorted(repr([value(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
        ours = sorted(repr([value(r[c]) for c in sorted(got.columns)]) for r in got.collect())
        if sorted(names) != sorted(got.columns) or ours != theirs:
            wrong.append(name)
    assert not wrong


def test_distinct_values_are_counted_by_column_and_value(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(1, 2.0, None), (1, nan, None), (2, inf, None), (None, 2.0, None), (3, -0.0, None), (3, 0.0, None)], "a int, b double, c double")
    found = features.column_profile(rows, ["a", "b", "c"])
    assert "Expand" not in found._jdf.queryExecution().toString()  # no row that carries all columns for each of them
    got = {r["column"]: r for r in found.collect()}
    assert [(got[c]["n"], got[c]["missing"], got[c]["finite"], got[c]["distinct_values"], got[c]["is_constant"]) for c in "abc"] == [(6, 1, 5, 3, False), (6, 0, 4, 2, False), (6, 6, 0, 0, True)]
    assert (got["b"]["min"], got["b"]["max"], got["b"]["mean"], got["c"]["mean"]) == (0.0, 2.0, 1.0, None)
