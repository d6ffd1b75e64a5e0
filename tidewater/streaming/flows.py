"""Structured Streaming forms of existing operators.

X1: segment-daily flows from an arriving event stream: stream-static join
to the customer segment, event-time windows of one day with a watermark
for late rows, partial aggregation in the state store.

X2: ensemble weights of arriving predictions; the place of a model's next
row is state, kept from one micro-batch to the next.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixtures import OUTFLOW_EVENT_TYPES
from ..plans.global_order import join_groups, with_global_position
from ..session import checkpoint_dir, read_table, table_path


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a table as a stream, all files there in one micro-batch:
    files of a table are in no order of time, so taken one by one, rows of
    later files would count as late.

    A folder of part files is streamed itself; for a single file the data
    folder is, filtered to its name (a file can't be a stream's path).
    """
    path = table_path(sf_dir, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(read_table(spark, sf_dir, name).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(sf_dir)


def _signed_events(events: DataFrame, customers: DataFrame, watermark: str) -> DataFrame:
    is_out = F.col("event_type").isin(*OUTFLOW_EVENT_TYPES)
    e = events.withWatermark("ts", watermark).select(
        F.format_string("CUST_%06d", F.col("user_id")).alias("customer_id"), "ts",
        F.when(is_out, -F.col("value")).otherwise(F.col("value")).alias("v"),
        F.when(is_out, F.lit(0.0)).otherwise(F.col("value")).alias("i"),
        F.when(is_out, -F.col("value")).otherwise(F.lit(0.0)).alias("o"))
    return e.join(customers.select("customer_id", "segment", F.lit(True).alias("known")), "customer_id", "left")


def _daily(j: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    return (j.groupBy(F.window("ts", "1 day").alias("w"), *keys)
             .agg(F.sum("v").alias("deposit_flow"), F.sum("i").alias("inflow"), F.sum("o").alias("outflow"),
                  F.count(F.lit(1)).alias("events"), *more)
             .withColumn("date", F.col("w.start").cast("date")).drop("w"))


def segment_daily_stream(events: DataFrame, customers: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Streaming aggregation per (day window, segment): signed flow, inflow,
    outflow, event count and approximate distinct customers."""
    j = _signed_events(events, customers, watermark)
    return _daily(j, ["segment"], F.approx_count_distinct("customer_id").alias("active_customers")).select(
        "date", "segment", "deposit_flow", "inflow", "outflow", "events", "active_customers")


#: Keys of ``customer_daily_stream``.
CUSTOMER_DAY = ["date", "segment", "customer_id"]


def customer_daily_stream(events: DataFrame, customers: DataFrame, watermark: str = "2 days") -> DataFrame:
    """The same per (day window, segment, customer): with the customer among
    the state's keys, ``segment_daily`` counts customers exactly."""
    j = _signed_events(events, customers, watermark)
    return _daily(j, ["segment", "customer_id"], F.max("known").alias("known"))


def segment_daily(customer_days: DataFrame) -> DataFrame:
    """The result table of ``customer_daily_stream`` per (day, segment), with
    the exact number of its customers (ids without a customer row count as none)."""
    return customer_days.groupBy("date", "segment").agg(
        *[F.sum(c).alias(c) for c in ("deposit_flow", "inflow", "outflow", "events")],
        F.count("known").alias("active_customers"))


def run_to_table(spark: SparkSession, stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Drive an aggregating stream over all available input (availableNow) in
    update mode and return the newest row per key.

    Each micro-batch writes the rows that it changed to a folder of its own in
    the shared checkpoint folder, so a batch that is run again overwrites
    itself; the result is read from there, not gathered on the driver.  State
    older than the watermark is dropped, and so are rows that late.
    """
    base = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    out = os.path.join(base, "rows")

    ran = set()

    def store(batch: DataFrame, batch_id: int) -> None:
        ran.add(batch_id)
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={batch_id}"))

    q = (stream.writeStream.foreachBatch(store).outputMode("update")
               .option("checkpointLocation", os.path.join(base, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    if not ran:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).option("basePath", out).parquet(os.path.join(out, "batch_id=*"))
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)


def _weights(errors: DataFrame, rmse: Column) -> DataFrame:
    """Weights of one row per (window, model): 1/(rmse + 1e-8), normalised."""
    inv = errors.withColumn("__w", 1 / (rmse + 1e-8))
    # a window over one row per model
    total = F.sum("__w").over(Window.partitionBy("window"))
    return inv.withColumn("weight", F.col("__w") / total).drop("__w")


def dynamic_weights_batch(batch: DataFrame) -> DataFrame:
    """X2 (foreachBatch body without an order): the batch is one window, its
    weights are proportional to 1/(rmse + 1e-8) per model, normalised."""
    err = batch.groupBy(F.lit(0).cast("long").alias("window"), "model_name").agg(
        F.sqrt(F.avg((F.col("actual") - F.col("predicted")) ** 2)).alias("rmse"))
    return _weights(err, F.col("rmse")).drop("rmse")


def window_errors(batch: DataFrame, seen: DataFrame, order_by: str, window_rows: int) -> tuple[DataFrame, DataFrame]:
    """X2 (foreachBatch body with an order): the batch's share of each
    ``window_rows``-row window, and the rows seen per model after it.

    ``seen`` (model_name, seen) is the state so far: a model's next row has
    position ``seen``, so a window that one micro-batch leaves open goes on in
    the next.  Positions come from the distributed global order, sums are
    combined before the shuffle: no task holds a model's rows.
    """
    p = with_global_position(batch, ["model_name", order_by], "gpos")
    start = (p.groupBy("model_name").agg(F.min("gpos").alias("first"), F.count(F.lit(1)).alias("rows"))
              .join(seen, "model_name", "full"))
    start = start.select("model_name", "first", F.coalesce("rows", F.lit(0)).alias("rows"),
                         F.coalesce("seen", F.lit(0)).alias("seen"))
    p = join_groups(p, start.where("rows > 0").select("model_name", (F.col("seen") - F.col("first")).alias("shift")),
                    ["model_name"])
    error = (F.col("actual") - F.col("predicted")) ** 2
    window = F.floor((F.col("gpos") + F.col("shift")) / window_rows)
    errors = p.groupBy(window.alias("window"), "model_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count(error).alias("known"), F.sum(error).alias("squares"))
    return errors, start.select("model_name", (F.col("seen") + F.col("rows")).alias("seen"))


def run_dynamic_weights(spark: SparkSession, predictions_stream: DataFrame, name: str = "x2",
                        order_by: str | None = None, window_rows: int = 20, min_rows: int = 10) -> DataFrame:
    """Ensemble weights (1/rmse, normalised over the models) of arriving
    labelled predictions, after all available input is processed.

    With ``order_by`` (unique within a model) every ``window_rows`` rows of a
    model are a window, in the order of the micro-batches and of ``order_by``
    within one; a window goes on over micro-batches, so the result is the same
    however ordered files are dealt to them.  A model with fewer than
    ``min_rows`` rows in a window has no weight there (as in E5), nor has one
    without a known error.  Returns (window, model_name, rows, weight).
    Without an order each micro-batch is one window: (window, model_name,
    weight, batch_id).  No batch or only empty ones: no rows.

    The state is a table of one row per model for each micro-batch, beside the
    windows' sums, in the shared checkpoint folder.  Batch k reads the state
    of batch k - 1 and overwrites its own folders, so one that is run again
    after a failure counts nothing twice.
    """
    base = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    out, state = os.path.join(base, "windows"), os.path.join(base, "state")

    def folder(of: str, batch_id: int) -> str:
        return os.path.join(of, f"batch_id={batch_id}")

    ran = set()

    def update(batch: DataFrame, batch_id: int) -> None:
        ran.add(batch_id)
        if order_by is None:
            dynamic_weights_batch(batch).write.mode("overwrite").parquet(folder(out, batch_id))
            return
        own = batch.sparkSession
        schema = "model_name string, seen long"
        seen = own.createDataFrame([], schema) if batch_id == 0 else own.read.schema(schema).parquet(folder(state, batch_id - 1))
        errors, seen = window_errors(batch, seen, order_by, window_rows)
        errors.write.mode("overwrite").parquet(folder(out, batch_id))
        seen.write.mode("overwrite").parquet(folder(state, batch_id))

    q = (predictions_stream.writeStream.foreachBatch(update)
                           .option("checkpointLocation", os.path.join(base, "_checkpoint"))
                           .trigger(availableNow=True).start())
    q.awaitTermination()
    if order_by is None:
        if not ran:
            return spark.createDataFrame([], "window long, model_name string, weight double, batch_id int")
        return spark.read.parquet(out)
    schema = "window long, model_name string, rows long, known long, squares double"
    if not ran:
        errors = spark.createDataFrame([], schema)
    else:
        errors = spark.read.schema(schema).option("basePath", out).parquet(os.path.join(out, "batch_id=*"))
    whole = errors.groupBy("window", "model_name").agg(*[F.sum(c).alias(c) for c in ("rows", "known", "squares")])
    whole = whole.where((F.col("rows") >= min_rows) & (F.col("known") > 0))
    return _weights(whole, F.sqrt(F.col("squares") / F.col("known"))).select("window", "model_name", "rows", "weight")
