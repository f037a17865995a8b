"""Tiled distances of domains against whole matrices."""

import numpy as np
import pytest

from episodica.functions import linalg as L
from episodica.operators import kernels as K


def rows_of(spark, runs):
    rows = [(n, role, 10_000 * k + i, v) for n, (s, t) in runs.items() for k, (role, x) in enumerate((("source", s), ("target", t))) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "n int, role string, episode long, v array<double>").repartition(5)


def sample(n, p, seed, shift=0.0):
    return np.random.default_rng(seed).standard_normal((n, p)) * np.arange(1, p + 1) + shift


def test_all_measures_equal_the_dense_form(spark):
    tied = np.round(sample(40, 3, 5))
    runs = {1: (sample(70, 3, 1, 0.5), sample(45, 3, 2)), 2: (sample(9, 3, 3), sample(8, 3, 4)), 3: (tied, tied[:15])}
    runs[2][1][:, 1] = 3.0  # a scale that vanishes
    got = {(r["n"], r["metric"]): r["value"] for r in K.transfer_metrics(rows_of(spark, runs), ["n"], block=16).collect()}
    for n, (s, t) in runs.items():
        want = L.transfer_metrics(s, t)
        assert tuple(want) == K.MEASURES
        for metric, value in want.items():
            # A discrepancy of projectors of full rank is the root of a rounding error.
            assert got[n, metric] == pytest.approx(value, rel=1e-8, abs=1e-7 if metric == "projector_discrepancy" else 1e-9), (n, metric)


def test_median_of_squares_is_exact(spark):
    for seed, n in ((7, 30), (8, 31), (9, 2)):
        x = sample(n, 4, seed)
        pairs, _ = K.tiles(rows_of(spark, {1: (x[: n // 2], x[n // 2 :])}), ["n"], 7)
        d = L.squared_distances(x)
        assert K.median_squares(pairs, ["n"], 4)[1,] == pytest.approx(L.median_bandwidth(d), rel=1e-12)


def test_twenty_thousand_rows(spark):
    """A matrix of all pairs would take 3.2 GB; a tile of 1024 rows takes 8 MB."""
    s, t = sample(12_000, 2, 11, 0.3), sample(8_000, 2, 12)
    got = K.kernel_discrepancy(rows_of(spark, {1: (s, t)}), ["n"], 2)[1,]
    pick = np.random.default_rng(0)
    a, b = s[pick.permutation(12_000)[:1500]], t[pick.permutation(8_000)[:1500]]
    assert got == pytest.approx(L.kernel_discrepancy(a, b), abs=0.01) and got > 0.001


def test_a_run_without_a_source_has_no_measures(spark):
    empty = np.zeros((0, 3))
    assert K.transfer_metrics(rows_of(spark, {1: (empty, sample(5, 3, 1))}), ["n"]).count() == 0
    assert K.transfer_metrics(rows_of(spark, {}), ["n"]).count() == 0


def test_a_row_is_sent_to_a_bounded_number_of_tasks(spark):
    s, t = sample(700, 3, 21, 0.4), sample(500, 3, 22)
    pairs, _ = K.tiles(rows_of(spark, {1: (s, t)}), ["n"], 16)
    assert pairs.count() <= (K.PARTS + 1) ** 2 and pairs.agg({"number": "max"}).first()[0] >= K.PARTS - 1
    x = np.concatenate([s, t])
    assert K.median_squares(pairs, ["n"], 3, 16)[1,] == pytest.approx(L.median_bandwidth(L.squared_distances(x)), rel=1e-12)
    assert K.kernel_discrepancy(rows_of(spark, {1: (s, t)}), ["n"], 3, 16)[1,] == pytest.approx(L.kernel_discrepancy(s, t), rel=1e-9)
