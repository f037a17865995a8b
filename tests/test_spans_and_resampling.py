"""Span reads, bootstraps and simulated power against direct forms."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import moments, order, resampling, spans


def span_frame(spark, rows):
    return spark.createDataFrame(rows, "file string, episode long, first_row long, stop_row long")


def test_rows_of_spans_of_all_lengths(spark):
    rng = random.Random(4)
    held = [(rng.choice("ab"), i, at := rng.randrange(-40, 400), at + rng.choice([0, 1, 1, 2, 3, 4, 5, 8, 9, 63, 64, 65, 300])) for i in range(60)] + [(None, 99, 3, 9)]
    rows = [(f, r, float(r)) for f in ("a", "b", "c", None) for r in range(-20, 420)]
    out = spans.read_spans(spark.createDataFrame(rows, "file string, row long, x double"), span_frame(spark, held), ["file"], "row", "episode", ["x"])
    want = sorted((str(f), e, r, x) for f, e, a, b in held for g, r, x in rows if g == f and a <= r < b)
    assert sorted((str(r.file), r.episode, r.row, r.x) for r in out.collect()) == want
    assert spans.read_spans(spark.createDataFrame(rows, "file string, row long, x double"), span_frame(spark, []), ["file"], "row", "episode", ["x"]).count() == 0


def test_span_reads_join_by_equality_and_prune_the_scan(spark, tmp_path):
    spark.range(10_000).select(F.col("id").alias("row"), F.lit("a").alias("file"), F.rand(1).alias("x"), F.rand(2).alias("unread")).write.parquet(str(tmp_path / "rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spans.read_spans(spark.read.parquet(str(tmp_path / "rows")), span_frame(spark, [("a", 1, 50, 70), ("a", 2, 4000, 4001)]), ["file"], "row", "episode", ["x"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "GreaterThanOrEqual(row,50)" in plan and "LessThan(row,4001)" in plan and "unread" not in plan
        assert out.count() == 21
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_guards_of_spans(spark):
    rng = random.Random(5)
    held = [(rng.choice("ab"), i, at := rng.randrange(500), at + rng.randrange(1, 90)) for i in range(80)]
    got = {r.episode: (r.gap, r.overlaps) for r in spans.neighbours(span_frame(spark, held), ["file"], "episode", 32).collect()}
    for file in "ab":
        reach = None
        for _, e, a, b in sorted((s for s in held if s[0] == file), key=lambda s: (s[2], s[1])):
            assert got[e] == ((None, False) if reach is None else (a - reach, a < reach))
            reach = b if reach is None else max(reach, b)
    rows = spark.createDataFrame([("a", 1, r) for r in (4, 5, 6)] + [("a", 2, r) for r in (8, 10)], "file string, episode long, row long")
    assert sorted(map(tuple, spans.inventory(rows, ["file"], "episode", "row").collect())) == [("a", 1, 4, 7, 3, True), ("a", 2, 8, 11, 2, False)]


def test_bootstrapped_correlation(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, 120) + 1e6
    y = 0.5 * x + rng.standard_normal(120) * 3
    rows = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [("flat", i, 1.0, float(i)) for i in range(5)] + [("two", i, float(i), float(i)) for i in range(2)] + [("a", 7, None, 1.0)], "g string, id long, x double, y double").repartition(6)
    counts = moments.resample_counts(np.arange(120), 400)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    for ranks, (p, q) in ((False, (x, y)), (True, (rank(x), rank(y)))):
        r = [np.corrcoef(np.repeat(p, w.astype(int)), np.repeat(q, w.astype(int)))[0, 1] for w in counts.T]
        got = {r["g"]: r for r in resampling.bootstrap_correlation(rows, ["g"], "x", "y", "id", 400, ranks=ranks).collect()}
        assert got["a"]["n_rows"] == 120 and got["a"]["correlation"] == pytest.approx(np.corrcoef(p, q)[0, 1], rel=1e-7)
        assert (got["a"]["ci_low"], got["a"]["ci_high"]) == pytest.approx(tuple(np.percentile(r, [2.5, 97.5])), rel=1e-6)
        assert got["flat"]["correlation"] is None and got["two"]["correlation"] is None and got["two"]["ci_low"] is None


def test_distance_counts_steps():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 6, rng.integers(1, 9)), rng.integers(0, 6, rng.integers(1, 9))
        want = max(abs((a <= v).mean() - (b <= v).mean()) for v in [*a, *b])
        assert resampling.distance_steps(a, b) / (len(a) * len(b)) == pytest.approx(want)


def test_power_holds_its_level_and_finds_large_shifts(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k, s, float(v), i < 25) for k in ("u", "v") for s in (1, 2) for i, v in enumerate(rng.gamma(2, 3, 60))] + [("flat", 1, 1.0, i < 2) for i in range(5)], "k string, seed int, x double, second boolean")
    tests = resampling.simulated_tests(rows, ["k", "seed"], "x", "second", (0.0, 0.4, 1.5), 300).cache()
    assert tests.count() == 4 * 300 * 3 and {(r.n_first, r.n_second) for r in tests.select("n_first", "n_second").distinct().collect()} == {(35, 25)}
    curve = {(r.k, r.seed, r["shift"]): r for r in resampling.power_curve(tests, ["k", "seed"], 0.1).collect()}
    for (_, _, shift), r in curve.items():
        assert r.replicates == 300 and r.standard_error == pytest.approx(math.sqrt(r.power * (1 - r.power) / 300))
        if shift == 0:
            assert r.power <= 0.1 + 3 * math.sqrt(0.09 / 300)  # the exact test of tied draws is at most as large as its level
        if shift == 1.5:
            assert r.power > 0.95
    found = resampling.detectable_shifts(resampling.power_curve(tests, ["k", "seed"], 0.1), ["k"], 0.9).collect()
    assert {(r.k, r.n_curves, r.detectable_shift, r.largest_shift) for r in found} == {("u", 2, 1.5, 1.5), ("v", 2, 1.5, 1.5)}
    assert all(r.null_rejections < 0.16 for r in found)
    again = resampling.simulated_tests(rows.repartition(5), ["k", "seed"], "x", "second", (0.0, 0.4, 1.5), 300)
    assert again.exceptAll(tests).count() == 0


def test_power_asks_for_few_p_values_and_judges_every_distance(monkeypatch):
    asked = []
    whole = resampling._p_value
    monkeypatch.setattr(resampling, "_p_value", lambda n, m, steps: asked.append(steps) or whole(n, m, steps))
    for n, m, alpha in ((35, 25, 0.1), (7, 30, 0.05), (2, 2, 0.01)):
        asked.clear()
        bound = resampling.critical_steps.__wrapped__(n, m, alpha)
        assert len(asked) <= math.log2(n * m) + 2
        assert all((steps >= bound) == (whole(n, m, steps) < alpha) for steps in range(n * m + 1))


def test_simulated_distances_are_those_of_the_drawn_samples(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, 40).astype(float)
    rows = spark.createDataFrame([("u", float(v), i < 17) for i, v in enumerate(x)], "k string, x double, second boolean")
    z = (np.sort(x) - x.mean()) / x.std(ddof=1)
    got = resampling.simulated_tests(rows, ["k"], "x", "second", (0.0, 0.5), 30).collect()
    assert len(got) == 60
    for r in got:
        places = [int(hashlib.md5(f"u:{r['replicate']}:{i}".encode()).hexdigest()[:8], 16) % 40 for i in range(1, 41)]
        drawn = z[places]
        assert r["steps"] == resampling.distance_steps(drawn[:23], drawn[23:] + r["shift"]) and r["ks"] == pytest.approx(r["steps"] / (23 * 17))


def test_counts_follow_the_definition_and_rows_are_dealt_whatever_their_files(spark):
    ids, replicates = [0, 1, -7, 2**31 - 1, 2**31, 5 * 10**12, 2**62], [1, 2, 999, 10**6]
    for i in ids:
        for r in replicates:
            h = (i % moments.PRIME * moments.ROW_STEP + r * moments.REPLICATE_STEP) % moments.PRIME
            for step in moments.MIX:
                h = h * ((h + step) % moments.PRIME) % moments.PRIME
            assert moments.resample_hash(np.array([i]), np.array([r]))[0] == h
    rows = spark.range(2000).selectExpr("'a' as g", "id", "double(id % 7) as x", "double(id % 11) as y").coalesce(1)
    sums = resampling.bootstrap_sums(rows, ["g"], "x", "y", "id", 20)
    assert "RepartitionByExpression [entity#" in sums._jdf.queryExecution().toString() and sums.where("replicate = 0").first()["w"] == 2000
    ranked = order.average_ranks(rows, ["g"], "x", "place")
    assert "BroadcastHashJoin" in ranked._jdf.queryExecution().executedPlan().toString() and {r.place for r in ranked.where("x = 0").collect()} == {143.5}
