"""Streaming operators: late rows, several batches."""

import datetime as dt
import os
import shutil
import time

from pyspark.sql import functions as F

import __spark_entry__ as E
from tidewater import fixtures as fx
from tidewater.streaming import flows as X


def _write(spark, path, days, value):
    rows = [(1, "view", dt.datetime(2024, 1, d, 12), value) for d in days]
    df = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp, value double")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_late_rows_are_dropped_and_days_are_updated(spark, tmp_path):
    path = os.path.join(str(tmp_path), "in")
    schema = _write(spark, path, range(1, 11), 1.0)
    time.sleep(1.1)  # files are taken in the order of their times
    _write(spark, path, [10, 11], 5.0)
    time.sleep(1.1)
    # the first batch's watermark holds for late rows from the third batch on
    _write(spark, path, [1, 11], 7.0)
    customers = spark.createDataFrame([("CUST_000001", "SME")], "customer_id string, segment string")
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = X.run_to_table(spark, X.segment_daily_stream(events, customers), ["date", "segment"], "late")
    got = {r["date"].day: (r["deposit_flow"], r["events"]) for r in out.collect()}
    assert got == {d: (1.0, 1) for d in range(1, 10)} | {10: (6.0, 2), 11: (12.0, 2)}


def test_weights_per_batch(spark, tmp_path):
    path = os.path.join(str(tmp_path), "in")
    for k, wrong in enumerate([1.0, 3.0]):
        rows = [("a", 10.0, 10.0 + wrong), ("b", 10.0, 11.0)]
        df = spark.createDataFrame(rows, "model_name string, actual double, predicted double")
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = X.run_dynamic_weights(spark, stream)
    got = {(r["batch_id"], r["model_name"]): round(r["weight"], 4) for r in out.select("model_name", "weight", F.col("batch_id").cast("int")).collect()}
    assert got == {(0, "a"): 0.5, (0, "b"): 0.5, (1, "a"): 0.25, (1, "b"): 0.75}


SF = "/root/testdata/sf0.001"


def _folders(spark, tmp_path):
    """The small tables, events and orders as folders of four part files each."""
    for t in ("region", "nation", "customer"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    for t in ("events", "orders"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(4).write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_folder_tables_are_streamed_whole(spark, tmp_path):
    x1 = E.queries()["x1_streaming_segment_daily"]
    one, four = x1(spark, SF), x1(spark, _folders(spark, tmp_path))
    assert one.agg(F.sum("events")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert sorted(map(tuple, four.collect()), key=repr) == sorted(map(tuple, one.collect()), key=repr)


def test_customers_are_counted_exactly(spark, tmp_path):
    n = 3000
    path = os.path.join(str(tmp_path), "in")
    rows = spark.range(2 * n).selectExpr(f"id % {n} as user_id", "'view' as event_type", "timestamp'2024-01-01 12:00:00' as ts", "1.0D as value")
    rows.coalesce(1).write.parquet(path)
    customers = spark.range(n - 10).select(F.format_string("CUST_%06d", "id").alias("customer_id"), F.lit("SME").alias("segment"))
    stream = X.customer_daily_stream(spark.readStream.schema(rows.schema).parquet(path), customers)
    got = {r["segment"]: (r["events"], r["active_customers"]) for r in X.segment_daily(X.run_to_table(spark, stream, X.CUSTOMER_DAY, "exact")).collect()}
    assert got == {"SME": (2 * (n - 10), n - 10), None: (20, 0)}


def test_weights_per_twenty_rows(spark, tmp_path):
    p = fx.predictions(spark, SF).toPandas().sort_values("row_id")
    want = {}
    for model, g in p.groupby("model_name"):
        for k in range(0, len(g), 20):
            part = g.iloc[k:k + 20]
            want[k // 20, model] = 1 / (((part.actual - part.predicted) ** 2).mean() ** 0.5 + 1e-8)
    total = {w: sum(v for (x, _), v in want.items() if x == w) for w, _ in want}
    x2 = E.queries()["x2_streaming_dynamic_weights"]
    for at in (SF, _folders(spark, tmp_path)):
        got = {(r["window"], r["model_name"]): r["weight"] for r in x2(spark, at).collect()}
        assert got.keys() == want.keys() and len(total) > 2
        assert all(abs(got[k] - v / total[k[0]]) < 1e-9 for k, v in want.items())


def _ordered_files(spark, path, rows, files):
    """``rows`` in ``files`` files, taken in their order."""
    size = -(-len(rows) // files)
    for k in range(files):
        part = spark.createDataFrame(rows[k * size:(k + 1) * size], "model_name string, row_id long, actual double, predicted double")
        part.coalesce(1).write.mode("append").parquet(path)
    old = sorted((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: os.stat(os.path.join(path, f)).st_mtime_ns)
    for k, f in enumerate(old):
        os.utime(os.path.join(path, f), (1_700_000_000 + 10 * k,) * 2)
    return part.schema


def _weights_by_hand(rows, size, least):
    out, place = {}, {}
    for model, _, actual, predicted in rows:
        k = place[model] = place.get(model, -1) + 1
        out.setdefault((k // size, model), []).append(None if actual is None else (actual - predicted) ** 2)
    inv = {}
    for key, e in out.items():
        known = [x for x in e if x is not None]
        if len(e) >= least and known:
            inv[key] = 1 / ((sum(known) / len(known)) ** 0.5 + 1e-8)
    total = {w: sum(v for (x, _), v in inv.items() if x == w) for w, _ in inv}
    return {k: (len(out[k]), v / total[k[0]]) for k, v in inv.items()}


def test_windows_go_on_over_micro_batches(spark, tmp_path):
    path = os.path.join(str(tmp_path), "in")
    # model b begins late and ends with less than half a window; one window of c has no known error
    rows = [(m, i, None if m == "c" and 20 <= i < 40 else float(i % 7), float(i * (2 if m == "a" else 3) % 11))
            for i in range(73) for m in ("a", "b", "c") if m != "b" or 30 <= i < 55]
    schema = _ordered_files(spark, path, rows, 8)
    want = _weights_by_hand(rows, 20, 10)
    assert (1, "c") not in want and (1, "b") not in want and (0, "b") in want
    for files in (1, 20):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        got = {(r["window"], r["model_name"]): (r["rows"], r["weight"])
               for r in X.run_dynamic_weights(spark, stream, order_by="row_id").collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_weights_of_nothing(spark, tmp_path):
    schema = "model_name string, row_id long, actual double, predicted double"
    for name, rows in (("none", None), ("empty", [])):
        path = os.path.join(str(tmp_path), name)
        os.mkdir(path)
        if rows is not None:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        for order_by in (None, "row_id"):
            stream = spark.readStream.schema(schema).parquet(path)
            assert X.run_dynamic_weights(spark, stream, order_by=order_by).count() == 0
