"""Null-safe arithmetic and small Column helpers shared by all operators.

ANSI mode is on in Spark 4: ``x / 0`` raises, so divisions go through
``try_divide`` and yield NULL where pandas would give inf/NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def nan_to_null(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def clean_double(x) -> Column:
    """NaN and +/-inf become NULL."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def flag(cond: Column) -> Column:
    """0/1 integer of a condition; NULL comparisons count as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(x, lo=None, hi=None) -> Column:
    """Clip keeping NULL (least/greatest would skip the null argument)."""
    x = col(x)
    v = x
    if lo is not None:
        v = F.when(v < lo, F.lit(lo)).otherwise(v)
    if hi is not None:
        v = F.when(v > hi, F.lit(hi)).otherwise(v)
    return F.when(x.isNotNull(), v)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def columns_matching(df: DataFrame, *needles: str, case: bool = True,
                     numeric_only: bool = False) -> list[str]:
    """Name-driven column selection: any needle is a substring of the name."""
    names = numeric_columns(df) if numeric_only else df.columns
    if case:
        return [c for c in names if any(n in c for n in needles)]
    return [c for c in names if any(n.lower() in c.lower() for n in needles)]


def rate_columns(df: DataFrame) -> list[str]:
    return columns_matching(df, "RATE", "TREASURY", numeric_only=True)


def round_half_away(x, digits: int = 4) -> Column:
    """round(x * 10^d) / 10^d in double arithmetic (the SQL engines' double
    rounding) after snapping to 9 decimals, so that a value such as
    x.xxxx5 that summation order leaves just above or below the boundary
    rounds alike in both engines."""
    snap = F.round(col(x) * 1e9, 0) / 1e9
    p = float(10 ** digits)
    return F.round(snap * p, 0) / p + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column (oracle comparisons)."""
    return df.select(*[round_half_away(f.name, digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def pandas_skew(m2: Column, m3: Column, n: Column) -> Column:
    """Bias-adjusted sample skewness (pandas) from population skewness."""
    return F.when(n > 2, m3 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_skewness(x) -> Column:
    """pandas ``Series.skew()`` (bias adjusted): g1*sqrt(n(n-1))/(n-2)."""
    n = F.count(col(x)).cast("double")
    g1 = F.skewness(col(x))
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x) -> Column:
    """pandas ``Series.kurt()``: (n-1)/((n-2)(n-3))*((n+1)g2+6)."""
    n = F.count(col(x)).cast("double")
    g2 = F.kurtosis(col(x))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def scalar_fields(one_row: DataFrame) -> dict[str, Column]:
    """Every column of a one-row frame as a field of ONE scalar subquery:
    the subquery runs once (identical plans are reused) however many of its
    fields a later expression uses."""
    s = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns]).alias("__s")).scalar()
    return {c: s[c] for c in one_row.columns}


def combine_rows(parts: list[DataFrame]) -> DataFrame:
    """Side-by-side combination of one-row frames without joins: each part
    becomes ONE struct-valued scalar subquery of a one-row projection, whose
    fields are expanded in an outer projection (the subquery is not copied
    per field, so plans stay linear in the number of parts)."""
    spark = parts[0].sparkSession
    structs = [p.select(F.struct(*[F.col(f"`{c}`") for c in p.columns])).scalar().alias(f"__p{i}")
               for i, p in enumerate(parts)]
    row = spark.range(1).select(*structs)
    return row.select(*[F.col(f"__p{i}")[c].alias(c) for i, p in enumerate(parts) for c in p.columns])


def with_row(df: DataFrame, one_row: DataFrame, name: str = "__r") -> DataFrame:
    """Attach the one-row frame ``one_row`` to every row of ``df`` as a
    struct column ``name`` computed by ONE scalar subquery (no join).
    Refer to its fields as ``F.col(name)[field]``; a later projection that
    uses several fields does not copy the subquery (it is not cheap, so
    Catalyst does not collapse it into each reference)."""
    s = one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns])).scalar()
    return df.select("*", s.alias(name))


def np_round(x, digits: int) -> Column:
    """numpy's round: scale by 10^d in double arithmetic, round half to
    even, scale back.  The value is first snapped to 9 decimals so that
    summation-order noise cannot move a decimal tie to either side."""
    p = float(10 ** digits)
    snap = F.round(col(x) * 1e9, 0) / 1e9
    return F.bround(snap * p, 0) / p
