"""Sampling, splits and set operations.

Samples are deterministic by key hash (not pandas' RNG).  Positions for
chronological splits come from distributed global positions (H1), and
per-stratum top-k uses two stages so that a hot stratum is spread over
many tasks before the final cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.global_order import with_global_position

SALTS = 64


def _hash(key: Sequence[str], seed: int):
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in key])


def sample_random(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows with the smallest key hash (the whole frame if it is smaller);
    the limit is the sampling feature itself."""
    return df.orderBy(_hash(key, seed), *key).limit(n)


def sample_systematic(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """Every (len // n)-th row in ``order_by`` order, at most n rows."""
    total = df.count()
    if total <= n:
        return df
    step = total // n
    p = with_global_position(df, list(order_by), "__pos")
    return p.where(F.col("__pos") % step == 0).where(F.col("__pos") / step < n).drop("__pos")


def sample_stratified(df: DataFrame, n: int, strata: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """min(size, n // groups) rows per stratum by key hash; two-stage top-k
    (salted first stage) so no task holds a whole hot stratum."""
    groups = df.select(strata).distinct().count()
    k = max(n // max(groups, 1), 0)
    h = _hash(key, seed)
    d = df.select("*", h.alias("__h"), F.pmod(h, F.lit(SALTS)).alias("__salt"))
    w1 = Window.partitionBy(strata, "__salt").orderBy("__h", *key)
    d = d.select("*", F.row_number().over(w1).alias("__r1")).where(F.col("__r1") <= k)
    w2 = Window.partitionBy(strata).orderBy("__h", *key)
    d = d.select("*", F.row_number().over(w2).alias("__r2")).where(F.col("__r2") <= k)
    return d.drop("__h", "__salt", "__r1", "__r2")


def chronological_split(df: DataFrame, order_by: Sequence[str], ratios: Sequence[float] = (0.7, 0.15)) -> DataFrame:
    """``split`` label by global position against int(n * cumulative
    ratio): train / validation / test (two ratios) or train / test (one)."""
    p = with_global_position(df, list(order_by), "__pos")
    n = p.agg(F.count(F.lit(1))).scalar()
    names = ["train", "validation", "test"] if len(ratios) == 2 else ["train", "test"]
    cum, expr = 0.0, None
    for name, r in zip(names, ratios):
        cum += r
        cond = F.col("__pos") < F.floor(n * F.lit(cum))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(names[-1]))
    return p.select(*df.columns, expr.alias("split"))


def date_cutoff_split(df: DataFrame, date_col: str, cutoff: str) -> DataFrame:
    """L5 alternative: rows before the cut-off train, the rest test, so one
    day never straddles the split."""
    return df.select("*", F.when(F.col(date_col) < F.lit(cutoff).cast("date"), "train").otherwise("test")
                     .alias("split"))


def fold_start(n: int, n_splits: int, fold: int) -> int:
    """The position at which fold ``fold``'s test rows of ``expanding_folds`` begin (and the last one's end)."""
    size = n // (n_splits + 1)
    return (fold + 1) * size + (n - (n_splits + 1) * size)


def expanding_folds(df: DataFrame, order_by: Sequence[str], n_splits: int = 5) -> DataFrame:
    """L6 (TimeSeriesSplit): test size n // (k + 1); fold i trains on
    positions < (i + 1) * size and tests on the next ``size`` rows.  Output:
    rows tagged (fold, role) -- a row appears in every fold it belongs to."""
    p = with_global_position(df, list(order_by), "__pos")
    n = p.agg(F.count(F.lit(1))).scalar()
    size = F.floor(n / (n_splits + 1))
    folds = F.array(*[F.lit(i) for i in range(n_splits)])
    x = p.select("*", F.explode(folds).alias("fold"))
    start = (F.col("fold") + 1) * size + (n - (n_splits + 1) * size)
    role = F.when(F.col("__pos") < start, "train").when(F.col("__pos") < start + size, "test")
    return x.select(*df.columns, "fold", role.alias("role")).where(F.col("role").isNotNull())


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Row concat by name, missing columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` absent from ``right``."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")
