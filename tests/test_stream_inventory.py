"""The inventory as keyed state against the batch form, after restarts and out-of-order files."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import features
from episodica.streaming import inventory

SCHEMA = "user long, ts timestamp, id long, kind string"


def telemetry(spark, n=240):
    rng = random.Random(3)
    rows = [(rng.randrange(5), 1_700_000_000 + 40 * i + rng.choice((0, 0, 25)), i, rng.choice(("a", "a", "b", None))) for i in range(n)]
    return spark.createDataFrame(rows, "user long, s long, id long, kind string").select("user", F.timestamp_seconds("s").alias("ts"), "id", "kind")


def compared(spark, path, rows):
    want = {r.user: r for r in features.episode_inventory(rows.withColumn("t", F.unix_micros("ts") / 1e6), "user", "t", ["ts", "id"], "kind").collect()}
    got = {r.user: r for r in inventory.latest(spark, path, "user").collect()}
    assert got.keys() == want.keys()
    for user, w in want.items():
        for c in w.asDict():
            assert got[user][c] == (pytest.approx(w[c], rel=1e-9) if isinstance(w[c], float) else w[c]), (user, c)
    return got


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows = telemetry(spark).cache()
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    run = lambda: inventory.run_inventory(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source), out, checkpoint, "user", "ts", "id", "kind", lateness=3000.0)
    # Neighbouring rows are in files that come the other way round, within the lateness.
    for at in (40, 0, 80):
        rows.where(f"id >= {at} and id < {at + 40}").coalesce(1).write.mode("append").parquet(source)
    run()
    compared(spark, out, rows.where("id < 120"))
    for at in (120, 200, 160):
        rows.where(f"id >= {at} and id < {at + 40}").coalesce(1).write.mode("append").parquet(source)
    run()  # a new query that starts from the checkpoint
    got = compared(spark, out, rows)
    assert sum(r.late_rows for r in got.values()) == 0 and not any(r.closed for r in got.values())


def test_late_rows_are_counted_and_idle_episodes_closed(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    one = lambda user, s, i: spark.range(1).select(F.lit(user).cast("long").alias("user"), at(s).alias("ts"), F.lit(i).cast("long").alias("id"), F.lit("a").alias("kind"))
    for user, s, i in ((1, 0, 0), (1, 100, 1), (1, 900, 2), (1, 50, 3), (1, 895, 4), (2, 500_000, 5), (2, 500_001, 6)):
        one(user, s, i).coalesce(1).write.mode("append").parquet(source)
        inventory.run_inventory(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, "user", "ts", "id", "kind", lateness=60.0, retention=10_000.0)
    got = {r.user: r for r in inventory.latest(spark, out, "user").collect()}
    assert (got[1].row_count, got[1].late_rows, got[1].closed, got[1].steps_forward, got[1].max_step) == (4, 1, True, 3, 795.0)
    assert (got[2].row_count, got[2].closed, got[2].late_rows) == (2, False, 0)
