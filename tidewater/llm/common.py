"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import checkpoint_dir, read_table

from .wordhash import mix

#: Rows up to which a table that was counted may be broadcast.
BROADCAST_ROWS = 50_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: computed once,
    read as often as needed, and still there when an executor is lost."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Makes the session hand over at most ``rows`` rows at a time, from Parquet
    and to Python: rows of texts are long, and a usual batch of 10,000 of them
    takes as much memory as the work on it."""
    for key, usual in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.parquet.columnarReaderBatchSize", "4096")):
        if not 0 < int(spark.conf.get(key, usual)) <= rows:
            spark.conf.set(key, str(rows))


def fresh(df: DataFrame | list[str], *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` (or a list) doesn't have."""
    taken, out = {c.lower() for c in (df if isinstance(df, list) else df.columns)}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id's text modulo ``by``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def attach(left: DataFrame, right: DataFrame, key: str, spread: Column, rows: int | None = None) -> DataFrame:
    """Left join of a table with one row per ``key``, whatever share of the left
    rows one key holds.

    ``right`` is counted (or ``rows`` says its count).  Up to ``BROADCAST_ROWS``
    it is broadcast; a larger one is repeated for 32 salts and the left rows
    are dealt over them by the hash of ``spread``, so that no key's rows meet
    in one task.  Null keys match null keys.
    """
    rows = right.count() if rows is None else rows
    here, there, salt = fresh(left.columns + right.columns, "here", "there", "salt")
    side = right.withColumnRenamed(key, there)
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(side), left[key].eqNullSafe(side[there]), "left").drop(there)
    side = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(31))))
    mine = left.withColumn(here, F.pmod(F.xxhash64(spread), F.lit(32)).cast("int"))
    return mine.join(side, mine[key].eqNullSafe(side[there]) & (mine[here] == side[salt]), "left").drop(there, salt, here)


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", parts: int = 32) -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``keys``, whatever
    share of the left rows one key holds.

    The left rows of a key are dealt over ``parts`` cells by the hash of
    ``spread``.  The cells in use, at most ``parts`` a key, look the key up, and
    the left rows join their cell.  ``left`` is read twice.
    """
    (at,) = fresh(left.columns + right.columns, "at")
    dealt = left.withColumn(at, F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    cells = dealt.select(*keys, at).distinct().join(right, keys)
    return dealt.join(cells, [*keys, at], how).drop(at)


def summed(df: DataFrame, size: int, count: Callable[[pa.RecordBatch], np.ndarray], slots: int = 32) -> np.ndarray:
    """The sum over all rows of ``df`` of vectors of ``size`` integers.

    ``count`` gives the sum over a batch.  Every task keeps one vector and sends
    one row; ``slots`` tasks add those up as they stream in; the driver gets
    ``slots`` rows at most.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += count(b)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for v in b.column("v"):
                total += np.frombuffer(v.as_buffer(), np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    parts = df.mapInArrow(rows, "slot int, v binary").repartition(slots, "slot").mapInArrow(add, "v binary").collect()
    return sum((np.frombuffer(r["v"], np.int64) for r in parts), np.zeros(size, np.int64))


#: Bits of an id filter: 16 for each id, up to this many (32 MB).
FILTER_BITS = 1 << 28


def maybe_among(ids: DataFrame, slots: int = 8) -> Callable[[Column], Column]:
    """A test for the long column of ``ids``: false only for ids that are not
    there.

    It is a Bloom filter of bounded size, so it can go to every task however
    many ids there are; when they outgrow it, it says true more often, and
    what relies on it joins more rows but gives the same result.  Each task
    makes one bit map, ``slots`` tasks unite them.
    """
    n = max(1, ids.count())
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(13, (16 * n - 1).bit_length()))
    name = ids.columns[0]

    def places(x: np.ndarray) -> list[np.ndarray]:
        h = x.astype(np.int64).view(np.uint64)
        return [mix(h ^ seed) & np.uint64(size - 1) for seed in mix(np.arange(4))]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size >> 3, np.uint8)
        for b in batches:
            for at in places(b.column(0).drop_null().to_numpy()):
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["slot", "v"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size >> 3, np.uint8)
        for b in batches:
            for v in b.column("v"):
                bits |= np.frombuffer(v.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["v"])

    rows = ids.select(name).mapInArrow(mark, "slot int, v binary").repartition(slots, "slot").mapInArrow(unite, "v binary").collect()
    bits = np.zeros(size >> 3, np.uint8)
    for r in rows:
        bits |= np.frombuffer(r["v"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        there = np.ones(len(x), bool)
        for at in places(x.fillna(0).to_numpy()):
            there &= (shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return pd.Series(there)

    return lambda column: column.isNotNull() & test(F.coalesce(column.cast("long"), F.lit(0)))
