"""Exact order statistics, pairings, policies and kernels against brute force on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import linalg as L
from episodica.operators import audits, detectors, distribution, matrix_detectors, membership, order, policies, transfer_detectors
from episodica.sources import tables


def grouped_values(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("hot", float(x)) for x in rng.normal(size=4000)] + [("ties", float(x)) for x in rng.integers(0, 4, 500)] + [("one", 3.0), ("null", None), (None, 1.0), (None, 2.0)]
    values = {}
    for k, x in rows:
        if x is not None:
            values.setdefault(k, []).append(x)
    return spark.createDataFrame(rows, "k string, x double").repartition(3), {k: np.sort(v) for k, v in values.items()}


def test_quantiles_of_hot_and_tied_groups(spark):
    df, values = grouped_values(spark)
    got = {r.k: (r.a, r.b) for r in order.quantiles(df, ["k"], "x", {"a": 0.5, "b": 0.93}).collect()}
    assert got.keys() == values.keys()
    for k, v in values.items():
        assert np.allclose(got[k], np.quantile(v, [0.5, 0.93]))
    assert order.quantiles(df.limit(0), ["k"], "x", {"a": 0.5}).count() == 0


def test_average_ranks(spark):
    df, values = grouped_values(spark)
    rows = order.average_ranks(df, ["k"], "x", "r").collect()
    assert len(rows) == df.count() and {r.r for r in rows if r.x is None} == {None}
    for r in rows:
        if r.x is not None:
            v = values[r.k]
            assert r.r == (np.searchsorted(v, r.x) + np.searchsorted(v, r.x, "right") + 1) / 2


def test_rank_operators_take_clashing_names(spark):
    df = spark.createDataFrame([(n, float(x)) for n in (1, 2) for x in range(5)], "n long, range double")
    assert {(r.n, r.m) for r in order.quantiles(df, ["n"], "range", {"m": 0.5}).collect()} == {(1, 2.0), (2, 2.0)}


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x), float(y)) for x, y in zip(rng.integers(0, 12, 150), rng.integers(0, 9, 150))] + [("b", float(x), float(x + 0.3 * y)) for x, y in rng.normal(size=(200, 2))]
    got = {r.k: r for r in distribution.kendall(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    for k in "ab":
        part = [(x, y) for g, x, y in rows if g == k]
        signs = [np.sign((p[0] - q[0]) * (p[1] - q[1])) for p, q in itertools.combinations(part, 2)]
        assert got[k].pairs == len(signs) and got[k].discordant == signs.count(-1) and np.isclose(got[k].tau, sum(signs) / len(signs))


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(detectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(detectors, "REFERENCE_BLOCK", 11)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.integers(0, 3, (60, 2)), rng.normal(size=(40, 2))]).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for r in detectors.nearest(df.where("id % 5 = 0"), df, "id", "v", 6).collect():
        d = np.sqrt(((x - x[r.id]) ** 2).sum(axis=1))
        best = sorted(range(len(x)), key=lambda j: (d[j], j))[:6]
        assert [n.id for n in r.near] == best and np.allclose([n.distance for n in r.near], d[best])
    few = {r.id: r.score for r in detectors.nearest_distances(df.where("id = 0"), df.where("id < 3"), "id", "v", 10).collect()}
    assert np.isclose(few[0], np.sqrt(((x[:3] - x[0]) ** 2).sum(axis=1)).max())


def test_exact_ks_against_all_arrangements():
    for n, m, d in ((3, 4, 0.5), (5, 5, 0.6), (4, 6, 0.75), (5, 7, 0.3)):
        distances = []
        for chosen in itertools.combinations(range(n + m), n):
            mine = np.isin(np.arange(n + m), chosen)
            distances.append(np.abs(np.cumsum(mine) / n - np.cumsum(~mine) / m).max())
        assert np.isclose(L.ks_exact(n, m, d), np.mean(np.array(distances) >= d - 1e-12))


def test_exact_ks_of_large_samples_holds_one_diagonal():
    import tracemalloc

    n, m, d = 3000, 2500, 0.03
    tracemalloc.start()
    try:
        p = L.ks_exact(n, m, d)
        assert tracemalloc.get_traced_memory()[1] < 1 << 20  # the grid of all points would take 60 MB
    finally:
        tracemalloc.stop()
    z = 2 * n * m / (n + m) * d * d
    assert np.isclose(p, 2 * sum((-1) ** (k - 1) * np.exp(-k * k * z) for k in range(1, 20)), atol=0.01) and np.isclose(p, L.ks_exact(m, n, d), rtol=1e-9)
    assert L.ks_exact(n, m, 1.0) == 0.0 and L.ks_exact(n, m, 0.0) == 1.0 and L.ks_exact(1, 1, 1.0) == 1.0


def test_fisher_against_all_tables():
    from math import comb

    for a, b, c, d in ((3, 1, 1, 3), (8, 2, 1, 5), (0, 4, 5, 2), (0, 0, 3, 4)):
        row, column, n = a + b, a + c, a + b + c + d
        chance = {k: comb(row, k) * comb(n - row, column - k) / comb(n, column) for k in range(max(0, row + column - n), min(row, column) + 1)}
        assert np.isclose(L.fisher_exact(a, b, c, d), sum(p for p in chance.values() if p <= chance[a] * (1 + 1e-7)))


def test_precisions():
    rng = np.random.default_rng(3)
    s = np.cov(rng.normal(size=(400, 6)), rowvar=False)
    assert np.allclose(L.sparse_precision(s, 0.0), np.linalg.inv(s), atol=1e-4) and np.allclose(L.constrained_precision(s, 1e-4), np.linalg.inv(s), atol=1e-3)
    shrunk = L.sparse_precision(s, 0.05)
    gap, off = np.linalg.inv(shrunk) - s, ~np.eye(6, dtype=bool)
    # The optimality conditions: the gap is the penalty where an entry stands, and at most that where none does.
    assert np.abs(gap[off]).max() <= 0.0501 and np.allclose(np.abs(gap[off & (np.abs(shrunk) > 1e-6)]), 0.05, atol=1e-3)
    chain = np.eye(5) + np.diag([0.45] * 4, 1) + np.diag([0.45] * 4, -1)
    x = rng.multivariate_normal(np.zeros(5), np.linalg.inv(chain), 600)
    _, often = L.stable_edges(x, (0.05, 0.1, 0.2, 0.4))
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(often, 1)))} == {(i, i + 1) for i in range(4)}


@pytest.mark.parametrize("kind", ["chain", "hub", "blocks", "random"])
def test_synthetic_graphs_are_found_again(kind):
    truth = L.synthetic_precision(kind, 8, 0.35, seed=1)
    assert np.linalg.eigvalsh(truth).min() > 0.09
    x = L.synthetic_rows(truth, 4000, seed=2)
    cov = np.cov(x, rowvar=False)
    for found in (L.sparse_precision(cov, 0.03), L.constrained_precision(cov, 0.05)):
        assert L.support_metrics(found, truth, 0.06)["edge_recall"] > 0.9
    assert np.abs(np.linalg.inv(cov) - truth).max() < 0.4
    heavy = L.synthetic_rows(truth, 4000, seed=2, degrees=3)
    assert np.abs(heavy).max() > 2 * np.abs(x).max()


def test_clusters_contributions_and_risk():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(30, 2)), rng.normal(size=(20, 2)) + 12, rng.normal(size=(10, 2)) - 12])
    assert L.clusters(x, 3)[0].tolist() == [0] * 30 + [1] * 20 + [2] * 10
    mean, cov, _ = L.shrunk_covariance(x)
    parts = L.contributions(x, mean, np.linalg.inv(cov))
    assert np.allclose(parts.sum(axis=1), L.mahalanobis(x, mean, np.linalg.inv(cov)) ** 2)
    t = rng.normal(size=(40, 4))
    near, far = L.risk_index(rng.normal(size=(300, 4)), t), L.risk_index(5 * rng.normal(size=(300, 4)), t)
    assert near["risk_index"] < 3 < far["risk_index"] and far["best_weight"] > near["best_weight"]


def test_transfer_metrics_from_their_definitions():
    rng = np.random.default_rng(5)
    s, t = rng.normal(size=(50, 6)) @ rng.normal(size=(6, 6)), rng.normal(size=(30, 6)) + 0.5
    got = L.transfer_metrics(s, t, 3)
    scale = 1.4826 * np.median(np.abs(t - np.median(t, axis=0)), axis=0)
    a, b = (np.clip((x - np.median(x, axis=0)) / scale, -8, 8) for x in (s, t))
    kernel = lambda x, y, h: np.exp(-((x[:, None] - y[None]) ** 2).sum(-1) / (2 * h)).mean()
    pooled = np.vstack([a, b])
    h = np.median([((p - q) ** 2).sum() for p, q in itertools.combinations(pooled, 2)])
    assert np.isclose(got["mmd_rbf"], kernel(a, a, h) + kernel(b, b, h) - 2 * kernel(a, b, h))
    assert np.isclose(got["covariance_discrepancy"], np.linalg.norm(np.cov(a.T) - np.cov(b.T)) / 6)
    p, q = (u @ u.T for u in (L.principal_basis(a, 3), L.principal_basis(b, 3)))
    assert np.isclose(got["projector_discrepancy"], np.linalg.norm(p - q) / np.sqrt(6)) and np.isclose(got["projector_similarity"], np.trace(p @ q) / 3)


def test_lending_without_trust_is_the_target_alone():
    rng = np.random.default_rng(6)
    s, t, q = rng.normal(size=(80, 5)), rng.normal(size=(20, 5)), rng.normal(size=(7, 5))
    scores = matrix_detectors.SCORERS
    assert np.allclose(scores["SelectiveTargetOnly"](s, t, q), scores["TargetOnly"](s, t, q), rtol=1e-6)
    model = transfer_detectors.lending(s, t)
    assert ((0 <= model.trust) & (model.trust <= 1)).all() and np.allclose(model.variance(False), model.own)
    # A source that contradicts the target is not lent from.
    far = 100 * rng.normal(size=(80, 5)) + 50
    assert np.allclose(scores["SelectiveTransfer"](far, t, q), scores["SelectiveTargetOnly"](far, t, q))
    assert transfer_detectors.blend_share(s, t, 3) in transfer_detectors.BLEND_GRID


def test_policies(spark):
    t = spark.createDataFrame([(1, 2.0, 3.0, "x")], "id long, motor_current double, motor_voltage double, note string")
    assert policies.select_signals(t, "all", metadata=["ID"]) == ["motor_current", "motor_voltage"]
    assert policies.select_signals(t, "explicit", explicit=["motor_voltage", "motor_current"], metadata=["id"]) == ["motor_voltage", "motor_current"]
    for wrong, fault in ((["id"], "metadata"), (["note"], "not numeric"), (["nope"], "unknown"), (["motor_current"] * 2, "repeated")):
        with pytest.raises(ValueError, match=fault):
            policies.select_signals(t, "explicit", explicit=wrong, metadata=["id"])
    with pytest.raises(ValueError, match="no column"):
        policies.select_signals(t, "keyword", keywords=["torque"])
    assert [(r.place, r.id) for r in policies.select_requested(spark.range(9), "id", [7, 2]).orderBy("place").collect()] == [(0, 7), (1, 2)]
    with pytest.raises(ValueError, match="missing"):
        policies.select_requested(spark.range(9), "id", [7, 20])
    assert policies.select_requested(spark.range(9), "id", [7, 20], require_all=False).count() == 1


def test_lookups_and_drift_reject_repeated_keys(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    right = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    assert {(r.k, r.v, r.found) for r in audits.lookup(left, right, ["k"]).collect()} == {(1, "a", True), (2, None, False), (None, None, False)}
    with pytest.raises(Exception, match="repeated"):
        audits.lookup(left, right.union(right), ["k"]).collect()
    runs = spark.createDataFrame([("d", 10, 1.0), ("d", 10, 2.0), ("d", 50, 3.0)], "d string, n int, x double")
    with pytest.raises(Exception, match="repeated"):
        audits.paired_drift(runs, ["d"], "n", 10, 50, ["x"]).collect()


def test_splits_are_disjoint_frozen_and_complete(spark):
    ids = spark.range(200).withColumnRenamed("id", "e")
    legacy = membership.legacy_split(ids, "e", (0, 1), 20, 40, 50, 60).collect()
    assert len({(r.seed, r.e) for r in legacy}) == len(legacy) == 300
    extended = membership.extended_calibration(ids, "e", (0, 1), 40, 50, 60).collect()
    first = {(r.seed, r.e) for r in legacy if r.partition == "calibration"}
    assert {(r.seed, r.e) for r in extended if r.place <= 50} == first and len(extended) == 2 * (50 + 50)
    frozen = membership.frozen_split(ids, "e", (0, 1, 2), 30, 50, 60).collect()
    fixed = {r.e for r in frozen if r.seed is None}
    assert len(fixed) == 110 and not fixed & {r.e for r in frozen if r.seed is not None}
    assert len({frozenset(r.e for r in frozen if r.seed == s) for s in (0, 1, 2)}) == 3
    ranks = membership.seeded_rank(ids.repartition(7), "e", 42).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 201)) and {r.n for r in ranks} == {200}


def test_feature_versions_splits_and_catalogue(spark, tmp_path):
    path = str(tmp_path / "features")
    tables.save_features(spark.createDataFrame([(1, 0.5), (2, 0.7)], "episode_id long, x double"), path, "v1")
    assert tables.load_features(spark, path, "v1", ["x", "episode_id"]).count() == 2
    for version, columns, fault in (("v2", None, "version"), ("v1", ["x"], "columns")):
        with pytest.raises(ValueError, match=fault):
            tables.load_features(spark, path, version, columns)
    members = [(-1, -1, 1, "calibration"), (0, 5, 2, "commissioning")]
    spark.createDataFrame(members, "seed long, commissioning_n long, episode_id long, partition string").write.parquet(str(tmp_path / "m"))
    read = lambda *a: tables.read_split(spark, str(tmp_path / "m"), path, ["x"], *a).collect()
    assert [r.episode_id for r in read("calibration")] == [1] and [r.episode_id for r in read("commissioning", 0, 5)] == [2]
    for wrong in (("commissioning",), ("calibration", 0, 5)):
        with pytest.raises(ValueError, match="needs a seed"):
            read(*wrong)
    runs = spark.createDataFrame([("d", 1.0)], "detector string, recall double")
    tables.append_results(runs, str(tmp_path / "runs"), protocol_version="p1")
    tables.append_results(runs, str(tmp_path / "runs"), protocol_version="p1")
    with pytest.raises(ValueError, match="protocol"):
        tables.append_results(runs, str(tmp_path / "runs"), protocol_version="p2")
    spark.createDataFrame([(1, 2.0)], "a long, Motor_Current double").createOrReplaceTempView("motors")
    assert [(r["table"], r.column) for r in tables.find_columns(spark, "current$").collect()] == [("motors", "Motor_Current")]
    spark.catalog.dropTempView("motors")
    manifest = tables.write_manifest(spark, str(tmp_path / "manifest"), [path], {"seed": "42"}).first()
    assert manifest.parameters == {"seed": "42"} and all(len(f.sha256) == 64 for f in manifest.files)
    with pytest.raises(ValueError, match="missing columns"):
        tables.require_columns(runs, ["fpr"])


def test_context_conditional_against_brute_force(spark):
    rng = np.random.default_rng(7)
    known = [(i, float(c), float(s)) for i, (c, s) in enumerate(zip(rng.integers(0, 6, 40), rng.normal(size=40)))]
    asked = [(100 + i, float(c)) for i, c in enumerate(rng.uniform(-1, 7, 25))]
    calibration = spark.createDataFrame(known, "e long, c double, s double")
    got = {r.e: r.threshold for r in audits.context_conditional(spark.createDataFrame(asked, "e long, c double"), calibration, "e", "c", "s", 8, 7).collect()}
    for e, c in asked:
        near = sorted(known, key=lambda k: (abs(k[1] - c), k[0]))[:8]
        assert np.isclose(got[e], sorted(s for _, _, s in near)[6]), e


def test_sources_by_distance(spark):
    d = spark.createDataFrame([(0, i, float((i * 7) % 10)) for i in range(10)], "run int, e long, distance double")
    got = {}
    for r in audits.source_regimes(d, ["run"], "e", 2).collect():
        got.setdefault(r.regime, []).append(r.distance)
    assert {k: sorted(v) for k, v in got.items()} == {"near": [0.0, 1.0], "moderate": [4.0, 5.0], "high": [8.0, 9.0]}
    assert audits.source_regimes(d.where(F.lit(False)), ["run"], "e").count() == 0


def test_equal_contexts_before_a_query_give_their_smaller_ids(spark):
    near = [(100, 0.5, 50.0), (101, 0.5, 40.0), (102, 0.9, 30.0)]
    calibration = spark.createDataFrame([(i, 0.0, float(i)) for i in range(1, 16)] + near + [(200, None, 0.0)], "e long, c double, s double")
    asked = spark.createDataFrame([(1000, 1.0), (1001, -1.0), (1002, 0.0)], "e long, c double")
    for rank in (5, 8):
        got = {r.e: r.threshold for r in audits.context_conditional(asked, calibration, "e", "c", "s", 8, rank).collect()}
        assert got == {1000: sorted([1, 2, 3, 4, 5, 50, 40, 30])[rank - 1], 1001: rank, 1002: rank}


def test_rows_left_out_of_large_targets_need_no_pass_over_the_others(monkeypatch):
    rng = np.random.default_rng(9)
    mix = rng.normal(size=(6, 6))
    s, t = rng.normal(size=(300, 6)) @ mix + 0.1, rng.normal(size=(270, 6)) @ mix
    passes = []
    shrunk, basis = L.shrunk_covariance, L.principal_basis
    monkeypatch.setattr(L, "shrunk_covariance", lambda x: passes.append(len(x)) or shrunk(x))
    monkeypatch.setattr(L, "principal_basis", lambda x, k: passes.append(len(x)) or basis(x, k))
    for name in ("SelectiveTransfer", "SelectiveSourcePermuted", "SelectiveTrustPermuted", "SharedProjector"):
        passes.clear()
        matrix_detectors.FITS[name](s, t)
        assert passes.count(269) < 27  # each of them once for every one of 270 rows, before
    assert all(np.allclose(cov[0], shrunk(np.delete(t, here.start, axis=0))[1]) for here, _, _, cov in transfer_detectors._left_out(t))
    # Bounds hold every gain, and the gate is that of all gains wherever its slack lies.
    for permuted in (False, True):
        least, most = transfer_detectors.gain_bounds(s, t, permuted)
        gains = np.array([transfer_detectors._gain(s, t, i, permuted, transfer_detectors.lender(s)) for i in range(270)])
        assert (least - 1e-9 <= gains).all() and (gains <= most + 1e-9).all()
        for slack in (-gains.mean() + 1e-6, -gains.mean() - 1e-6, 0.01, 0.0, -0.01):
            monkeypatch.setattr(transfer_detectors, "GATE_SLACK", slack)
            assert transfer_detectors.gate_opens(s, t, permuted) == (gains.mean() >= -slack)
    own, other = [basis(np.delete(t, i, axis=0), 3) for i in range(270)], basis(s, 3)
    risks = [np.mean([np.square(row - b @ (b.T @ row)).mean() for row, b in zip(t, (transfer_detectors._blended_basis(o, other, share) for o in own), strict=True)]) for share in transfer_detectors.BLEND_GRID]
    assert np.allclose(transfer_detectors._blend_risks(other, t, 3), risks, rtol=1e-9)
