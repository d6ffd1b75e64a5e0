"""Sources, sinks and payload parsing on inline payloads and temp folders."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewater.operators import scenarios as N
from tidewater.sources import io as S_IO
from tidewater.sources import payloads as P


def test_fred_observations_drop_dots(spark):
    doc = json.dumps({"observations": [{"date": "2024-01-01", "value": "5.33"},
                                       {"date": "2024-01-02", "value": "."}]})
    df = spark.createDataFrame([("FEDFUNDS", doc)], "series string, payload string")
    rows = P.fred_observations(df, "payload", ["series"]).collect()
    assert [(r["date"], r["value"]) for r in rows] == [(dt.date(2024, 1, 1), 5.33)]


def test_ecb_observation_index(spark):
    doc = json.dumps({"dataSets": [{"observations": {"0:0": [3.9], "1:0": [4.0], "7:0": [9.9]}}],
                      "structure": {"dimensions": {"observation": [
                          {"id": "TIME_PERIOD", "values": [{"id": "2024-01"}, {"id": "2024-02"}]}]}}})
    df = spark.createDataFrame([(doc,)], "payload string")
    rows = sorted((r["period"], r["value"]) for r in P.ecb_observations(df, "payload").collect())
    assert rows == [("2024-01", 3.9), ("2024-02", 4.0)]  # index 7 is out of range


def test_generic_and_validation(spark):
    doc = json.dumps({"data": [{"date": "2024-03-01", "value": "1.5", "other": "x"}]})
    df = spark.createDataFrame([(doc,)], "payload string")
    r = P.generic_records(df, "payload", ["value", "other"]).first()
    assert r["date"] == dt.date(2024, 3, 1) and r["value"] == 1.5 and r["other"] is None
    v = P.validate_response(df, "payload", ["data"]).first()["valid"]
    assert v is True
    assert P.validate_response(df, "payload", ["data", "missing"]).first()["valid"] is False


def test_api_usage_stats(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(t0, True, 100.0), (t0 + dt.timedelta(hours=2), False, 0.0), (t0 + dt.timedelta(hours=4), True, 50.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp, success boolean, response_time double")
    r = P.api_usage_stats(df).first()
    assert r["total_calls"] == 3 and r["successful_calls"] == 2 and r["time_range_hours"] == 4.0
    assert r["calls_per_hour"] == 0.75 and r["avg_response_time_ms"] == 75.0


def test_export_load_roundtrip_and_snapshots(spark):
    base = tempfile.mkdtemp(prefix="tidewater-io-")
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "id int, name string, x double")
    for ext in ("csv", "parquet", "json"):
        path = os.path.join(base, f"t.{ext}")
        S_IO.export_data(df, path)
        back = S_IO.load_data(spark, path, schema=df.schema)
        assert sorted(back.collect()) == sorted(df.collect())
    snap = os.path.join(base, "snap")
    S_IO.save_snapshot({"t": df}, snap, "2024-01-01 00:00:00")
    S_IO.save_snapshot({"t": df.where(F.col("id") == 1)}, snap, "2024-01-02 00:00:00")
    latest = S_IO.load_latest_snapshot(spark, snap, ["t"])["t"]
    assert latest.count() == 1
    assert not S_IO.is_stale(spark, snap, "t", "2024-01-02 12:00:00", 24)
    assert S_IO.is_stale(spark, snap, "t", "2024-01-04 00:00:00", 24)
    assert S_IO.is_stale(spark, os.path.join(base, "none"), "t", "2024-01-04 00:00:00", 24)


def test_a_save_that_dies_is_not_mixed_with_an_older_one(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="tidewater-io-"), "snap")
    names = ["a", "b"]

    def tables(k, b=None):
        b = F.lit(k) if b is None else b
        return {"a": spark.range(2).select("id", F.lit(k).alias("v")), "b": spark.range(3).select("id", b.alias("v"))}

    def loaded():
        return {n: sorted({r["v"] for r in df.collect()}) for n, df in S_IO.load_latest_snapshot(spark, base, names).items()}

    S_IO.save_snapshot(tables(1), base, "2024-01-01 00:00:00")
    with pytest.raises(Exception, match="killed"):
        S_IO.save_snapshot(tables(2, F.raise_error(F.lit("killed")).cast("int")), base, "2024-01-02 00:00:00")
    assert os.path.isdir(os.path.join(base, "a", "snapshot_ts=2024-01-02 00%3A00%3A00"))
    assert loaded() == {"a": [1], "b": [1]}
    assert S_IO.is_stale(spark, base, names, "2024-01-02 12:00:00", 24)
    fresh = S_IO.refresh_if_stale(spark, base, names, "2024-01-02 00:00:00", lambda: tables(3), 12)
    assert {n: df.count() for n, df in fresh.items()} == {"a": 2, "b": 3}
    assert loaded() == {"a": [3], "b": [3]}
    # a table saved alone is no snapshot of both
    S_IO.save_snapshot({"a": tables(4)["a"]}, base, "2024-01-03 00:00:00")
    assert loaded() == {"a": [3], "b": [3]}
    with pytest.raises(FileNotFoundError):
        S_IO.load_latest_snapshot(spark, base, ["a", "c"])


def test_run_log_gives_the_newest_runs(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tidewater-log-"), "log")
    for k in (1, 2, 10, 9, 3, 4, 10):  # out of order, one written twice
        S_IO.append_runs(spark.createDataFrame([(k, f"s{k}", float(k))] * 2, "run_id long, scenario string, x double"), path)
    got = [(r["run_id"], r["scenario"]) for r in S_IO.last_runs(spark, path, 5).orderBy("run_id").collect()]
    assert got == [(k, f"s{k}") for k in (2, 3, 4, 9, 10) for _ in range(2)]
    assert S_IO.last_runs(spark, path, 50).select("run_id").distinct().count() == 6
    plan = S_IO.last_runs(spark, path, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "PushedFilters: []" in plan


def test_comparison_of_runs_needs_two(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tidewater-log-"), "log")
    schema = "run_id long, scenario string, deposit_change_pct double, lcr_change double, funding_gap double, risk_level string"
    S_IO.append_runs(spark.createDataFrame([(1, "a", -5.0, None, 2.5e6, None)], schema), path)
    assert N.compare_runs(S_IO.last_runs(spark, path)).count() == 0
    S_IO.append_runs(spark.createDataFrame([(2, "b", None, -0.1, None, "High")], schema), path)
    got = sorted(map(tuple, N.compare_runs(S_IO.last_runs(spark, path)).collect()))
    assert got == [(1, "a", -5.0, 0.0, 2.5, "Unknown"), (2, "b", 0.0, -0.1, 0.0, "High")]


def test_validate_types(spark):
    from tidewater.operators import clean as C
    df = spark.createDataFrame([(1, "a", 2.5)], "id int, name string, x double")
    assert C.validate_data_types(df, {"id": "int", "name": "string", "x": "numeric", "y": "float"}) == \
        {"id": True, "name": True, "x": True, "y": False}
