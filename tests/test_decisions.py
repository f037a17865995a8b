"""Ladders, ranks, scales, folds and seeded orders on small cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import audits, distribution, membership, policies
from episodica.operators.order import average_ranks


def test_the_first_rung_that_holds_decides(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, None), (4, 0.1)], "i int, x double")
    got = {r.i: r.decision for r in policies.ladder(rows, (("x > 0.8", "high"), ("x > 0.4", "middle"), ("x > 0.3", "never")), "rest").collect()}
    assert got == {1: "high", 2: "middle", 3: "rest", 4: "rest"}


def test_rank_methods(spark):
    rows = spark.createDataFrame([("a", x) for x in (3.0, 1.0, 3.0, 3.0, None)] + [(None, 2.0)], "k string, x double")
    want = {"min": (1.0, 2.0), "max": (1.0, 4.0), "average": (1.0, 3.0)}
    for method, (low, high) in want.items():
        got = Counter((r.k, r.x, r.r and float(r.r)) for r in average_ranks(rows, ["k"], "x", "r", method).collect())
        assert got == Counter([("a", 1.0, low), *[("a", 3.0, high)] * 3, ("a", None, None), (None, 2.0, 1.0)])


def test_robust_scales_and_their_blend(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal(41), rng.gamma(2, size=30)
    rows = [("x", v) for v in x.tolist()] + [("y", v) for v in y.tolist()] + [("flat", 2.0)] * 4 + [("one", 5.0)] + [("tied", v) for v in (1.0, 1.0, 1.0, 1.0, 9.0)]
    found = distribution.robust_scales(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").cache()
    got = {r.k: r for r in found.collect()}
    for k, v in (("x", x), ("y", y)):
        assert got[k].n_rows == len(v) and got[k].center == pytest.approx(np.median(v)) and got[k].mad_scale == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))
        assert got[k].iqr_scale == pytest.approx((np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.349)
    assert (got["flat"].mad_scale, got["flat"].iqr_scale, got["one"].iqr_scale) == (1.0, 1.0, 1.0)
    assert got["tied"].iqr_scale == pytest.approx(np.std([1, 1, 1, 1, 9], ddof=1)) and got["tied"].mad_scale == 1.0
    blend = distribution.blended_scales(found.where("k = 'x'").withColumn("k", F.lit("z")), found.where("k = 'y'").withColumn("k", F.lit("z")), ["k"], 41.0).first()
    assert blend.target_weight == 0.5 and blend.scale == pytest.approx(np.sqrt(got["x"].iqr_scale * got["y"].iqr_scale)) and blend.center == pytest.approx((np.median(x) + np.median(y)) / 2)


def test_split_folds_are_parts_of_the_order(spark):
    for n, folds in ((23, 5), (3, 5), (10, 10), (1, 1)):
        rows = membership.split_folds(spark.range(n).withColumnRenamed("id", "e"), "e", folds, 4).collect()
        order = sorted(range(n), key=lambda e: (hashlib.md5(f"{e}:4".encode()).hexdigest(), e))
        parts = [p.tolist() for p in np.array_split(np.array(order), folds)]
        assert {r.e: r.fold for r in rows} == {e: i for i, p in enumerate(parts) for e in p}


def test_seeded_orders_of_several_seeds(spark):
    ids = spark.range(300).withColumnRenamed("id", "e")
    for most in (None, 7, 299, 1000):
        got = {(r.seed, r.e): r["rank"] for r in membership.seeded_ranks(ids, "e", (0, 3), most).collect()}
        for seed in (0, 3):
            order = sorted(range(300), key=lambda e: (hashlib.md5(f"{e}:{seed}".encode()).hexdigest(), e))[: most or 300]
            assert [e for e in order if (seed, e) in got] == order and all(got[seed, e] == i for i, e in enumerate(order, 1))
        assert len(got) == 2 * min(most or 300, 300)


def test_contexts_and_regimes_with_ties(spark):
    calibration = [(i, float(i // 4), float((i * 7) % 23)) for i in range(40)]
    asked = [(100 + i, c) for i, c in enumerate((-3.0, 0.0, 2.5, 4.0, 50.0))]
    got = {r.e: r.threshold for r in audits.context_conditional(spark.createDataFrame(asked, "e long, c double"), spark.createDataFrame(calibration, "e long, c double, s double"), "e", "c", "s", 6, 5).collect()}
    for e, c in asked:
        near = sorted(calibration, key=lambda x: (abs(x[1] - c), x[0]))[:6]
        assert got[e] == sorted(s for *_, s in near)[4]
    rows = [(r, i, float(i // 3)) for r in (1, 2) for i in range(11)]
    found = audits.source_regimes(spark.createDataFrame(rows, "run int, e long, distance double"), ["run"], "e", 2).collect()
    assert {(r.run, r.regime): sorted(x.e for x in found if (x.run, x.regime) == (r.run, r.regime)) for r in found} == {(n, k): v for n in (1, 2) for k, v in (("near", [0, 1]), ("moderate", [4, 5]), ("high", [9, 10]))}
