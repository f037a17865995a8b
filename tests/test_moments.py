"""Moments that add up over tasks against the rows themselves, in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import linalg as L
from episodica.operators import matrix_detectors as M
from episodica.operators import moments as A

RNG = np.random.default_rng(11)


def sample(n, p=7, shift=0.0, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, p)) @ rng.standard_normal((p, p)) + shift * rng.standard_normal(p)) * np.logspace(-2, 3, p)


def same(a, b, tolerance=1e-9):
    for f in ("n", "first", "second", "third", "fourth"):
        x, y = getattr(a, f), getattr(b, f)
        assert np.allclose(x, y, rtol=tolerance, atol=tolerance * max(1.0, np.abs(y).max())), f


def test_moving_merging_scaling_and_taking_out():
    x, y = sample(40), sample(25, shift=3, seed=1)
    both, center = np.vstack([x, y]), RNG.standard_normal(7)
    a, b, whole = A.Moments.of(x), A.Moments.of(y), A.Moments.of(both)
    same(a.about(center), A.Moments.of(x, center=center))
    same((a + b).about(whole.center), whole)
    same((whole - b).about(a.center), a)
    same(whole.without(both[3]), A.Moments.of(np.delete(both, 3, axis=0), center=whole.center))
    same(A.Moments.unpacked(whole.packed()), whole, 0)
    use = np.array([True, False] * 3 + [True])
    frame = A.Frame(use, both.mean(axis=0)[use], both.std(axis=0)[use])
    same(frame.moments(whole), A.Moments.of(frame.rows(both), center=np.zeros(4)))
    w = RNG.integers(0, 3, len(x)).astype(float)
    same(A.Moments.of(x, w), A.Moments.of(np.repeat(x, w.astype(int), axis=0), center=x.mean(axis=0)))


def test_shrinkage_of_moments_is_that_of_rows():
    for n in (3, 30, 3000):
        x = sample(n, shift=2, seed=n)
        for got, want in zip(A.Moments.of(x).shrunk(), L.shrunk_covariance(x), strict=True):
            assert np.allclose(got, want, rtol=1e-9, atol=1e-9 * np.abs(want).max())


def test_every_detector_fits_from_moments():
    s, t, q = sample(50, shift=1, seed=2), sample(12, seed=3), sample(9, shift=2, seed=4)
    s[:, 2] = t[:, 2] = 4.0  # does not vary
    for name, fit in A.FITS.items():
        got = A.scorer(fit(A.Moments.of(s), A.Moments.of(t)))(q)
        assert np.allclose(got, M.SCORERS[name](s, t, q), rtol=1e-7), name


def runs_of(spark, s, t, q=()):
    rows = [(n, r, 1000 * k + i, v.tolist(), i % 2) for n in (1, 2) for k, (r, x) in enumerate((("source", s), ("target", t), ("query", q))) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "n int, role string, episode long, v array<double>, odd int").repartition(7)


def values(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_spread_over_tasks_equals_one_matrix(spark):
    s, t, q = sample(60, shift=1, seed=5), sample(30, seed=6), sample(20, shift=2, seed=7)
    got = values(A.score_queries(runs_of(spark, s, t, q), ["n"], list(A.FITS)), "n", "detector", "episode")
    assert len(got) == 2 * len(A.FITS) * 20
    for name in A.FITS:
        assert np.allclose([got[2, name, 2000 + i]["score"] for i in range(20)], M.SCORERS[name](s, t, q), rtol=1e-7)
    direct = {**L.covariance_distances(L.floored(L.shrunk_covariance(s)[1]), L.floored(L.shrunk_covariance(t)[1]))}
    for (_, metric), r in values(A.covariance_distances(runs_of(spark, s, t), ["n"]), "n", "metric").items():
        assert r["value"] == pytest.approx(direct[metric], rel=1e-6)


def test_leaving_out_equals_refitting(spark):
    s, t = sample(40, p=5, shift=1, seed=8), sample(300, p=5, seed=9)
    names = ["TargetOnly", "Pooled", "Blended", "EigenvaluesOnly"]
    got = values(A.leave_one_out(runs_of(spark, s, t).where("n = 1"), ["n"], names), "detector", "episode")
    for name in names:
        for i in range(0, 300, 7):
            assert got[name, 1000 + i]["score"] == pytest.approx(M.SCORERS[name](s, np.delete(t, i, axis=0), t[i : i + 1])[0], rel=1e-7)
    assert A.leave_one_out(runs_of(spark, s, t[:2]), ["n"], names).count() == 0


def test_a_column_that_varies_by_one_row_only(spark):
    t = sample(6, p=4, seed=10)
    t[:, 1] = 5.0
    t[2, 1] = 6.0
    got = values(A.leave_one_out(runs_of(spark, t, t).where("n = 1"), ["n"], ["TargetOnly"]), "episode")
    for i in range(6):
        assert got[(1000 + i,)]["score"] == pytest.approx(M.SCORERS["TargetOnly"](t, np.delete(t, i, axis=0), t[i : i + 1])[0], rel=1e-6)


def test_conditioning_and_ranks(spark):
    t = sample(40, p=6, seed=12)
    t[:, 3] = t[:, 2] * 2  # rank 5
    got = {r["metric"]: r["value"] for r in A.conditioning(runs_of(spark, t, t).where("n = 1"), ["n"], 3).collect()}
    r = np.abs(np.corrcoef(t, rowvar=False))
    pairs = r[np.triu_indices(6, 1)]
    assert (got["n_rows"], got["rank"], got["constant_share"]) == (40, 5, 0) and got["effective_rank"] == pytest.approx(L.conditioning(t)["effective_rank"], rel=1e-6)
    assert got["median_correlation"] == pytest.approx(np.median(pairs), rel=1e-6) and got["share_above_0_90"] == pytest.approx(np.mean(pairs >= 0.9))
    assert got["within_signal_median_correlation"] == pytest.approx(np.median([r[i, j] for i in range(6) for j in range(i + 1, 6) if i // 3 == j // 3]), rel=1e-6)
    assert got["shrunk_condition"] == pytest.approx(L.conditioning(t)["shrunk_condition"], rel=1e-5)


def test_risk_index_counts_rows_as_its_hash_says(spark):
    s, t = sample(50, p=4, shift=1, seed=13), sample(40, p=4, seed=14)
    rows = runs_of(spark, s, t).where("n = 1")
    got = {r["metric"]: r["value"] for r in A.risk_index(rows, ["n"], 30).collect()}
    entity = {r["episode"]: r["h"] for r in rows.where("role = 'target'").select("episode", F.xxhash64("episode").alias("h")).collect()}
    counts = A.resample_counts(np.array([entity[1000 + i] for i in range(40)]), 30, 42)
    own = L.shrunk_covariance(t)[1]
    drawn = [L.shrunk_covariance(np.repeat(t, counts[:, r].astype(int), axis=0))[1] for r in range(30)]
    assert got["uncertainty_bootstrap"] == pytest.approx(np.mean([np.square(c - own).sum() for c in drawn]), rel=1e-8)
    assert got["uncertainty_jackknife"] == pytest.approx(np.mean([np.square(L.shrunk_covariance(np.delete(t, i, axis=0))[1] - own).sum() for i in range(40)]), rel=1e-8)
    other = L.shrunk_covariance(s)[1]
    risks = [np.mean([np.square((1 - w) * own + w * other - c).sum() for c in drawn]) for w in np.linspace(0, 1, 101)]
    assert got["best_weight"] == pytest.approx(np.argmin(risks) / 100) and got["best_risk"] == pytest.approx(min(risks), rel=1e-8)


def test_resample_counts_are_poisson_and_of_the_row_alone():
    counts = A.resample_counts(np.arange(5000) * 7919, 40)
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02
    assert abs(np.corrcoef(counts[:, 0], counts[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(counts[:-1, 3], counts[1:, 3])[0, 1]) < 0.05
    assert (A.resample_counts(np.array([7919 * 3]), 40)[0] == counts[3]).all()


def test_choices_of_the_covariance_family(spark):
    near, far = sample(400, p=6, seed=20), sample(400, p=6, seed=21) * 30
    t, near = near[:15], near[15:]
    picks = {}
    for name, s in (("near", near), ("far", far)):
        rows = A.covariance_choices(runs_of(spark, s, t).where("n = 1"), ["n"]).collect()
        picks[name] = next(r["parameter"] for r in rows if r["family"] == "blend" and r["chosen"])
        assert sum(r["chosen"] for r in rows) == 2 and len(rows) == len(A.PRIORS) + 1 + len(A.GAMMAS)
        assert all(r["lower_gain"] == 0 for r in rows if r["parameter"] == 0)
    assert picks["far"] == 0 and picks["near"] > 0


def test_fold_risks_are_those_of_refits(spark):
    s, t = sample(60, p=4, seed=22), sample(23, p=4, seed=23)
    rows = runs_of(spark, s, t).where("n = 1")
    folds = {r["episode"] - 1000: r["fold"] for r in A.fold_of(rows.where("role = 'target'"), ["n"], "episode").collect()}
    assert sorted(np.bincount(list(folds.values()))) == [4, 4, 5, 5, 5]
    z = M.standardizer(t)
    risks = []
    for f in range(5):
        held = np.array([folds[i] == f for i in range(23)])
        risks.append(L.gaussian_risk(z(t)[held], np.linalg.pinv(L.floored(M.blended(z(s), z(t)[~held], 20.0)["b"][1]), hermitian=True)))
    got = next(r for r in A.covariance_choices(rows, ["n"]).collect() if r["family"] == "blend" and r["parameter"] == 20)
    assert got["risk"] == pytest.approx(np.mean(risks), rel=1e-8)


def test_directional_parts_add_up_to_the_change_of_every_row(spark):
    s, t, q = sample(50, p=5, shift=1, seed=30), sample(14, p=5, seed=31), sample(25, p=5, shift=2, seed=32)
    parts = A.directional_parts(A.Moments.of(s), A.Moments.of(t), q)
    z = M.standardizer(np.vstack([s, t]))
    fits = M.blended(z(s), z(t))
    squared = {k: L.mahalanobis(z(q), fits[k][0], np.linalg.pinv(L.floored(fits[k][1]), hermitian=True)) ** 2 for k in "bt"}
    assert np.allclose(parts.sum(axis=1), squared["b"] - squared["t"], rtol=1e-9, atol=1e-9)
    rows = A.directional_audit(runs_of(spark, s, t, q).where("n = 1"), ["n"], "odd").collect()
    assert len(rows) == 10
    for r in rows:
        assert r["change"] == pytest.approx(parts[r["kind"] :: 2, r["direction"]].mean(), rel=1e-7) and r["target_variance"] > 0 and 0 <= r["alignment"] <= 1


def test_contributions_add_up_to_the_distance(spark):
    t, q = sample(30, p=5, seed=40), sample(11, p=5, shift=2, seed=41)
    t[:, 2] = 1.0
    rows = A.strongest_contributions(runs_of(spark, t, t, q).where("n = 1 and role <> 'source'"), ["n"], 9).collect()
    assert len(rows) == 11 * 4 and {r["feature"] for r in rows} == {0, 1, 3, 4}
    for i, distance in enumerate(M.SCORERS["TargetOnly"](t, t, q)):
        mine = sorted((r for r in rows if r["episode"] == 2000 + i), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == [1, 2, 3, 4] and sorted((r["contribution"] for r in mine), reverse=True) == [r["contribution"] for r in mine]
        assert sum(r["contribution"] for r in mine) == pytest.approx(distance**2, rel=1e-8) == mine[0]["squared"]


def test_too_many_moments_are_refused(spark, monkeypatch):
    monkeypatch.setattr(A, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        A.domains(runs_of(spark, sample(5), sample(5)), ["n"])


def test_vectors_must_be_whole(spark):
    for bad in ([1.0], None, [1.0, None]):
        with pytest.raises(Exception, match="vector"):
            A.moments(spark.createDataFrame([(1, [1.0, 2.0]), (1, bad)], "n int, v array<double>").coalesce(1), ["n"]).collect()
    assert A.moments(spark.createDataFrame([], "n int, v array<double>"), ["n"]).count() == 0
