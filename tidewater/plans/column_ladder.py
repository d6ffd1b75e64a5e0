"""One value ladder for many columns.

Every wanted column of a table becomes rows (column, value) in one scan; equal
values are counted before the shuffle, and the counts are range-partitioned
once by (column, group, value).  Quantiles, distinct counts, most frequent
values and counts beyond limits of all columns then come from that ladder,
which has a row per distinct value and is written once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .global_order import exact_quantiles, value_count_ladder

COLUMN = "column"


def known(df: DataFrame, name: str) -> Column:
    """A column's value, NaN being NULL."""
    x = F.col(f"`{name}`")
    return F.when(~F.isnan(x), x) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else x


def _value(df: DataFrame, name: str) -> Column:
    """(number, text) of a value: text tells whole and decimal numbers apart
    that one double stands for; NULL of a NULL."""
    x, kind = known(df, name), df.schema[name].dataType
    number = x.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.lit(None).cast("string")
    else:
        text = F.hex(x) if isinstance(kind, T.BinaryType) else x.cast("string")
    return F.when(x.isNotNull(), F.struct(number.alias("number"), text.alias("text")))


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, value) for each of ``cols`` in each row, from one scan."""
    each = F.array(*[F.struct(F.lit(c).alias(COLUMN), _value(df, c).alias("value")) for c in cols])
    return df.select(*by, F.explode(each).alias("__x")).select(*by, f"__x.{COLUMN}", "__x.value")


def column_ladder(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A row per distinct value of each column (and group): (column, by,
    number, text, c, below, __n); see ``value_count_ladder``.  NULL and NaN
    are left out, so a column without values has no rows."""
    lad = value_count_ladder(long_values(df, cols, by), "value", [COLUMN, *by])
    return lad.select(COLUMN, *by, "value.number", "value.text", "c", "below", "__n")


def column_quantiles(ladder: DataFrame, quantiles: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear quantiles, a row per column (and group): ``quantiles``
    maps the result's names to shares.  Columns without numbers give NULL."""
    return exact_quantiles(None, "number", list(quantiles.values()), list(quantiles), [COLUMN, *by], ladder)


def wide_quantiles(ladder: DataFrame, cols: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """The same in one row: a struct per column, NULL for one without values."""
    q = column_quantiles(ladder, quantiles).withColumn("__q", F.struct(*quantiles))
    return q.agg(*[F.max(F.when(F.col(COLUMN) == c, F.col("__q"))).alias(c) for c in cols])


def top_counts(counts: DataFrame, k: int, by: Sequence[str] = (), text: str = "text", count: str = "c") -> DataFrame:
    """The ``k`` most frequent values of each column (and group), ties to the
    smaller text, with ``place`` from 1.  Spark cuts each task to its own
    ``k`` rows of a column before the shuffle, so no task holds them all."""
    w = Window.partitionBy(COLUMN, *by).orderBy(F.col(count).desc(), F.col(text))
    return counts.select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= k)
