"""Readers, sinks and the streaming operators on small files."""

import pytest

from episodica.sources import tables
from episodica.streaming import online


def test_inventory_contract(spark, tmp_path):
    head = "episode_id,label,label_name,row_count,first_row,last_row,single_label,contiguous,monotonic\n"
    (tmp_path / "good.csv").write_text(head + "1,0,normal,3,0,2,True,yes,1\n2,1,fault,2,3,4,true,no,0\n")
    (tmp_path / "bad.csv").write_text(head + "1,0,normal,9,0,2,True,yes,1\n")
    got = {r.episode_id: r.contiguous for r in tables.read_inventory(spark, str(tmp_path / "good.csv")).collect()}
    assert got == {1: True, 2: False}
    with pytest.raises(ValueError, match="span"):
        tables.read_inventory(spark, str(tmp_path / "bad.csv"))


def test_protocol_and_append(spark, tmp_path):
    path = str(tmp_path / "members")
    rows = [(-1, -1, 1, "calibration"), (-1, -1, 2, "calibration"), (0, 5, 3, "commissioning")]
    tables.append_results(spark.createDataFrame(rows, "seed long, commissioning_n long, episode_id long, partition string"), path, ["partition"])
    assert sorted(r.episode_id for r in tables.read_protocol(spark, path, "calibration").collect()) == [1, 2]
    with pytest.raises(ValueError, match="no members"):
        tables.read_protocol(spark, path, "commissioning", 1, 5)
    assert tables.file_hashes(spark, path).where("length(sha256) = 64").count() > 0


def test_sessions_are_scored_in_a_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:0{i}:00", float(i)) for i in range(5)] + [(1, "2024-01-01 02:00:00", 100.0), (1, "2024-01-02 00:00:00", 0.0)]
    spark.createDataFrame(rows, "user long, ts string, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, ts string, x double").parquet(str(tmp_path / "in"))
    frozen = spark.createDataFrame([(2.0, 1.0)], "mean double, std double")
    out = online.score_stream(online.session_features(stream, "user", "ts", "x"), frozen, 3.0)
    run = out.writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = {(r["mean"], r.alert) for r in spark.sql("select * from alerts").collect()}
    assert got == {(2.0, False), (100.0, True)}
