"""Sources and sinks (S1-S6, S14): files in, files out, snapshots.

Formats are chosen by extension (csv, parquet, json); schemas are given
explicitly where known (no inference on the hot path).  Snapshots are one
directory per table partitioned by ``snapshot_ts`` so that "latest" is a
partition-pruned filter; a manifest written last names the whole ones.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}


def _format(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported format for {path!r} (excel/pickle are not supported)")
    return FORMATS[ext]


def load_data(spark: SparkSession, path: str, fmt: str | None = None,
              schema: T.StructType | None = None) -> DataFrame:
    """Csv (header), parquet or json by extension."""
    f = _format(path, fmt)
    r = spark.read.format(f)
    if schema is not None:
        r = r.schema(schema)
    if f == "csv":
        r = r.option("header", "true")
        if schema is None:
            r = r.option("inferSchema", "true")
    return r.load(path)


def export_data(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write csv (header), parquet or json; facts partitioned by date."""
    f = _format(path, fmt)
    w = df.write.format(f).mode(mode)
    if f == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_snapshot(tables: Mapping[str, DataFrame], base_path: str, snapshot_ts: str,
                  quality: DataFrame | None = None) -> None:
    """Every table under ``base/<name>`` with a ``snapshot_ts`` partition
    column; an optional quality report alongside.

    The manifest, which names the snapshot's tables, is written last and is
    what readers go by: a save that dies between two tables leaves nothing
    they take.  A save run again under the same id replaces that snapshot.
    """
    spark = next(iter(tables.values())).sparkSession

    def write(df: DataFrame, name: str, fmt: str = "parquet") -> None:
        (df.withColumn("snapshot_ts", F.lit(snapshot_ts)).write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts")
           .format(fmt).save(os.path.join(base_path, name)))

    for name, df in tables.items():
        write(df, name)
    if quality is not None:
        write(quality, "_quality", "json")
    write(spark.createDataFrame([(n,) for n in tables], "table_name string").coalesce(1), MANIFEST)


#: Folder of the manifests beside the tables.
MANIFEST = "_manifest"


def latest_snapshot_ts(spark: SparkSession, base_path: str, names: str | Sequence[str]):
    """Newest snapshot id whose manifest names all of ``names``; None if no
    snapshot does.  Only manifests are read: a row per table and snapshot."""
    names = [names] if isinstance(names, str) else list(dict.fromkeys(names))
    entries = spark.read.parquet(os.path.join(base_path, MANIFEST)).where(F.col("table_name").isin(names))
    whole = entries.groupBy("snapshot_ts").agg(F.count_distinct("table_name").alias("n")).where(F.col("n") == len(names))
    return whole.agg(F.max("snapshot_ts")).first()[0]


def load_latest_snapshot(spark: SparkSession, base_path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the newest whole snapshot that holds them all (its
    partitions only), never tables of different snapshots."""
    ts = latest_snapshot_ts(spark, base_path, names)
    if ts is None:
        raise FileNotFoundError(f"no whole snapshot of {', '.join(names)} in {base_path}")
    return {n: spark.read.parquet(os.path.join(base_path, n)).where(F.col("snapshot_ts") == F.lit(ts)).drop("snapshot_ts")
            for n in names}


def is_stale(spark: SparkSession, base_path: str, names: str | Sequence[str], as_of: str,
             max_age_hours: float = 24) -> bool:
    """True when there is no whole snapshot of the table or tables, or the
    newest is older than the limit at ``as_of`` (snapshot ids are
    'yyyy-MM-dd HH:mm:ss' texts)."""
    from pyspark.errors import AnalysisException
    try:
        ts = latest_snapshot_ts(spark, base_path, names)
    except AnalysisException as e:
        # no folder yet, or an empty one; any other failure is the caller's
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return True
    if ts is None:
        return True
    from datetime import datetime
    age = datetime.fromisoformat(as_of) - datetime.fromisoformat(str(ts))
    return age.total_seconds() / 3600 > max_age_hours


def refresh_if_stale(spark: SparkSession, base_path: str, names: list[str], as_of: str, rebuild,
                     max_age_hours: float = 24) -> dict[str, DataFrame]:
    """Reuse the newest whole snapshot when fresh, else call ``rebuild()``
    (returning a dict of frames), store it under ``as_of`` and return it."""
    if is_stale(spark, base_path, names, as_of, max_age_hours):
        save_snapshot(rebuild(), base_path, as_of)
    return load_latest_snapshot(spark, base_path, names)


# ------------------------------------------------------------------- run log
def append_runs(runs: DataFrame, path: str) -> None:
    """N10, EV13: the result rows of one or more runs, with their long
    ``run_id``, as partitions of an append-only log; a run written again under
    its id replaces itself."""
    (runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id").parquet(path))


def last_runs(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """The rows of the ``n`` newest runs of the log (all if fewer).  The
    ids come from the partitions, and only the newest partitions are read."""
    log = spark.read.parquet(path)
    newest = log.select("run_id").distinct().orderBy(F.col("run_id").desc()).limit(n)
    ids = [r["run_id"] for r in newest.collect()]
    return log.where(F.col("run_id").isin(ids))


def save_model(model, path: str, metadata: dict | None = None) -> None:
    """Spark ML model/pipeline persistence, with a metadata row (texts)
    beside it."""
    model.write().overwrite().save(path)
    if metadata:
        spark = SparkSession.getActiveSession()
        rows = [(str(k), str(v)) for k, v in metadata.items()]
        spark.createDataFrame(rows, "key string, value string").write.mode("overwrite").json(path.rstrip("/") + "_metadata")


def load_model(path: str):
    """A saved pipeline model and its metadata ({} if none was saved)."""
    from pyspark.errors import AnalysisException
    from pyspark.ml import PipelineModel
    model = PipelineModel.load(path)
    try:
        rows = SparkSession.getActiveSession().read.schema("key string, value string").json(path.rstrip("/") + "_metadata").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return model, {r["key"]: r["value"] for r in rows}
