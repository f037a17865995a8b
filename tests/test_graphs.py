"""Graphs over moments: planted edges, nulls and differences by brute force, lending from a close and a far source."""

import hashlib

import numpy as np
import pytest

from episodica.functions import linalg as L
from episodica.operators import graphs as G


def frame(spark, roles, runs=(1,)):
    rows = [(n, role, 10_000 * k + i, v) for n in runs for k, (role, x) in enumerate(roles.items()) for i, v in enumerate(np.asarray(x).tolist())]
    return spark.createDataFrame(rows, "n int, role string, episode long, v array<double>").repartition(4)


def test_planted_edge_is_stable_and_significant(spark):
    p = np.eye(5)
    p[1, 3] = p[3, 1] = 0.6
    rows = frame(spark, {"target": L.synthetic_rows(p, 150, 1)})
    stability = G.edge_stability(rows, ["n"], (0.1, 0.2, 0.4, 0.9), replicates=12).cache()
    profile = G.penalty_profile(stability, ["n"])
    chosen = [r for r in profile.collect() if r["chosen"]]
    assert len(chosen) == 1 and chosen[0]["penalty"] == 0.4 and sorted(r["penalty"] for r in profile.collect() if r["neighbour"]) == [0.2, 0.9]
    assert [(r["a"], r["b"]) for r in G.chosen_edges(stability, profile, ["n"]).collect() if r["stable"]] == [(1, 3)]
    found = {(r["a"], r["b"]): r for r in G.edge_p_values(rows, ["n"], 0.1, 39).collect()}
    assert len(found) == 10 and found[1, 3]["p_value"] == pytest.approx(1 / 40) and found[1, 3]["edge"] and found[1, 3]["partial"] < -0.3
    assert sum(r["p_value"] < 0.05 for r in found.values()) <= 2


def test_permuting_keeps_each_feature_and_breaks_their_ties(spark):
    x = np.arange(60.0).reshape(20, 3)
    out = G.permuted_rows(frame(spark, {"target": x}), ["n"], 3).collect()
    for r in (1, 2, 3):
        moved = np.array([row["v"] for row in out if row["replicate"] == r])
        assert all(sorted(moved[:, j]) == sorted(x[:, j]) for j in range(3))
        assert not np.allclose(moved[:, 1] - moved[:, 0], 1)


def graph(spark, edges):
    rows = [(n, a, b, 0.9 if s else 0.1, w, s) for n, pairs in edges.items() for (a, b), (s, w) in pairs.items()]
    return spark.createDataFrame(rows, "n int, a int, b int, probability double, partial double, stable boolean")


def test_overlap_differences_and_nulls(spark):
    pairs = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    s = {q: (i % 3 == 0, 0.3) for i, q in enumerate(pairs)}
    t = {q: (i % 2 == 0, 0.3 if i != 6 else 0.45) for i, q in enumerate(pairs)}
    source, target = graph(spark, {1: s, 2: s}), graph(spark, {1: t, 2: s})
    rows = {r["n"]: r for r in G.overlap(source, target, ["n"]).collect()}
    on_s, on_t = {q for q in pairs if s[q][0]}, {q for q in pairs if t[q][0]}
    assert (rows[1]["source_edges"], rows[1]["target_edges"], rows[1]["shared_edges"]) == (len(on_s), len(on_t), len(on_s & on_t))
    assert rows[1]["jaccard"] == pytest.approx(len(on_s & on_t) / len(on_s | on_t)) and rows[2]["jaccard"] == 1 and rows[2]["differential_edges"] == 0
    kinds = {(r["a"], r["b"]): r["kind"] for r in G.differential_edges(source, target, ["n"]).where("n = 1").collect()}
    assert {q for q, k in kinds.items() if k == "support"} == on_s ^ on_t and {q for q, k in kinds.items() if k == "weight"} == {pairs[6]}
    drawn = lambda *p: hashlib.md5(":".join(map(str, p)).encode()).hexdigest()
    jaccard = lambda x, y: len(x & y) / len(x | y)
    null = {(r["n"], r["replicate"]): r["jaccard"] for r in G.density_null(source, target, ["n"], 7).collect()}
    for r in range(1, 8):
        pick = lambda mark, m, r=r: set(sorted(pairs, key=lambda q: drawn(*q, r, mark))[:m])
        assert null[1, r] == pytest.approx(jaccard(pick("s", len(on_s)), pick("t", len(on_t))))
    null = {(r["n"], r["replicate"]): r["jaccard"] for r in G.identity_null(source, target, ["n"], 7).collect()}
    for r in range(1, 8):
        names = dict(zip(range(5), sorted(range(5), key=lambda f: drawn(f, r, "f")), strict=True))
        assert null[1, r] == pytest.approx(jaccard(on_s, {tuple(sorted((names[a], names[b]))) for a, b in on_t}))
    summary = {r["n"]: r for r in G.null_summary(G.overlap(source, target, ["n"]), G.identity_null(source, target, ["n"], 99), ["n"]).collect()}
    assert summary[2]["empirical_p"] < 0.2 < summary[1]["empirical_p"] and summary[2]["observed"] == 1


def test_constrained_columns_are_feasible_and_least():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 6))
    sigma, right = np.cov(x.T), np.eye(6) + 0.1 * rng.standard_normal((6, 6))
    found = G.constrained_columns(sigma, right, 0.2)
    assert np.abs(sigma @ found - right).max() <= 0.2 + 1e-7
    exact = np.linalg.solve(sigma, right)
    assert (np.abs(found).sum(axis=0) <= np.abs(exact).sum(axis=0)).all()
    for _ in range(2000):  # no feasible neighbour has a smaller absolute sum
        other = found + rng.standard_normal(found.shape) * 10 ** rng.uniform(-4, -1)
        ok = np.abs(sigma @ other - right).max(axis=0) <= 0.2
        assert (np.abs(other).sum(axis=0)[ok] >= np.abs(found).sum(axis=0)[ok] - 1e-6).all()


def test_a_close_source_lends_and_a_far_one_does_no_harm(spark):
    truth = L.synthetic_precision("chain", 8, 0.4, 3)
    target = L.synthetic_rows(truth, 30, 5)
    near, far = L.synthetic_rows(truth, 600, 6), L.synthetic_rows(L.synthetic_precision("random", 8, 0.4, 9), 600, 7) * 3
    error = lambda m: np.linalg.norm(m - truth) / np.linalg.norm(truth)
    alone = G.constrained_columns(np.cov(target.T, ddof=0), np.eye(8), 0.25)
    alone = error(L.floored((alone + alone.T) / 2, 1e-6))
    found = {name: G.lent_precisions(frame(spark, {"source": s, "target": target}), ["n"], 0.25)[1,] for name, s in (("near", near), ("far", far))}
    for r in found.values():
        assert r["violation"] < 1e-6 and r["unsolved"] == 0 and np.linalg.eigvalsh(r["precision"]).min() >= 1e-6 * 0.999
    assert error(found["near"]["precision"]) <= alone and found["near"]["lent"] > found["far"]["lent"]
    assert error(found["near"]["precision"]) < error(found["far"]["precision"])
    edges = G.lent_edges(frame(spark, {"source": near, "target": target}), ["n"], 0.25).collect()
    assert len(edges) == 28 and {(r["a"], r["b"]) for r in edges if r["edge"]} >= {(i, i + 1) for i in range(7)}


def test_columns_without_a_solution_are_counted(spark):
    few = np.random.default_rng(1).standard_normal((7, 9))
    found = G.lent_precisions(frame(spark, {"source": np.random.default_rng(2).standard_normal((90, 9)), "target": few}), ["n"], 0.05)[1,]
    assert found["unsolved"] > 0 and found["violation"] <= G.SOLVED and np.isfinite(found["precision"]).all()


def test_too_few_rows_have_no_graph(spark):
    rows = frame(spark, {"target": np.eye(2), "source": np.eye(2)})
    assert G.edge_stability(rows.where("role = 'target'"), ["n"], (0.1,)).count() == 0
    assert G.lent_precisions(rows, ["n"], 0.1) == {}
