"""Table and aggregate functions from SQL."""

import math

import pytest

from episodica.functions import tables


def test_grid_counts(spark):
    tables.register(spark)
    rows = [(k, x) for k in ("a", "b", None) for x in (0.0, 1.0, 1.5, 2.0, 7.0, -1.0, None, float("nan"))]
    spark.createDataFrame(rows, "key string, x double").repartition(5).createOrReplaceTempView("grid_rows")
    out = spark.sql("SELECT key, threshold, sum(n_rows) AS n FROM grid_counts(TABLE(grid_rows), 'key', 'x', 0D, 2D, 2) GROUP BY ALL").collect()
    assert {(r.key, r.threshold): r.n for r in out} == {(k, t): n for k in ("a", "b", None) for t, n in ((0.0, 2), (1.0, 3), (2.0, 5))}
    for call in ("'none', 'x', 0D, 1D, 2", "'key', 'x', 1D, 1D, 2", "'key', 'x', 0D, 1D, 0"):
        with pytest.raises(Exception, match="no column none|a grid needs"):
            spark.sql(f"SELECT * FROM grid_counts(TABLE(grid_rows), {call})").collect()


def test_log_sum_exp_takes_its_own_results(spark):
    tables.register(spark)
    values = [700.0, 710.5, 711.0, None, -5.0]
    spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(0, 1.0), (9, None)], "salt int, x double").createOrReplaceTempView("logs")
    want = 711.0 + math.log(sum(math.exp(v - 711.0) for v in [*values, 1.0] if v is not None))
    once = spark.sql("SELECT log_sum_exp(x) AS r FROM logs").first().r
    twice = spark.sql("SELECT log_sum_exp(p) AS r FROM (SELECT log_sum_exp(x) AS p FROM logs GROUP BY salt)").first().r
    assert once == pytest.approx(want) == twice
    assert spark.sql("SELECT log_sum_exp(x) AS r FROM logs WHERE salt = 9").first().r is None
