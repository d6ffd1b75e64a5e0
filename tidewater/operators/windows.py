"""Window operators (W1-W24): lags, rolling statistics, fills, ranks, runs.

Row order is explicit: every operator takes ``order_by`` (unique within the
partition) and optional ``partition_by``.  All expressions of one call go
into a single ``select`` so that rows sharing a window specification are
sorted once (H6).

Unpartitioned windows move every row to one task; use them only on series
whose size is bounded by the calendar (market days, segment-days).  For
fact-size global orders use :mod:`tidewater.plans.global_order`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.core import nan_to_null, safe_div


def spec(order_by: Sequence[str], partition_by: Sequence[str] | None = None) -> WindowSpec:
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if partition_by:
        return Window.partitionBy(*partition_by).orderBy(*order)
    return Window.orderBy(*order)


def rows(order_by, partition_by=None, start=None, end=0) -> WindowSpec:
    s = Window.unboundedPreceding if start is None else start
    e = Window.unboundedFollowing if end is None else end
    return spec(order_by, partition_by).rowsBetween(s, e)


def trailing(order_by, partition_by, n: int) -> WindowSpec:
    """The last ``n`` rows up to and including the current one."""
    return spec(order_by, partition_by).rowsBetween(-(n - 1), 0)


def full(expr: Column, x: Column, frame: WindowSpec, min_periods: int) -> Column:
    """``expr`` only where the frame holds ``min_periods`` non-null values."""
    return F.when(F.count(x).over(frame) >= min_periods, expr)


# --------------------------------------------------------------------------- W1
def lag_features(df: DataFrame, cols: Sequence[str], lags: Sequence[int], order_by,
                 partition_by=None) -> DataFrame:
    w = spec(order_by, partition_by)
    return df.select("*", *[F.lag(c, n).over(w).alias(f"{c}_lag_{n}") for c in cols for n in lags])


def lead_features(df: DataFrame, cols: Sequence[str], leads: Sequence[int], order_by,
                  partition_by=None) -> DataFrame:
    w = spec(order_by, partition_by)
    return df.select("*", *[F.lead(c, n).over(w).alias(f"{c}_lead_{n}") for c in cols for n in leads])


def diff_features(df: DataFrame, cols: Sequence[str], periods: Sequence[int], order_by,
                  partition_by=None, name="{c}_diff_{n}") -> DataFrame:
    w = spec(order_by, partition_by)
    return df.select("*", *[(F.col(c) - F.lag(c, n).over(w)).alias(name.format(c=c, n=n))
                            for c in cols for n in periods])


def pct_change_features(df: DataFrame, cols: Sequence[str], periods: Sequence[int], order_by,
                        partition_by=None, name="{c}_pct_change_{n}") -> DataFrame:
    """x / x[t-n] - 1; a zero base gives NULL (pandas gives inf)."""
    w = spec(order_by, partition_by)
    return df.select("*", *[(safe_div(F.col(c), F.lag(c, n).over(w)) - 1).alias(name.format(c=c, n=n))
                            for c in cols for n in periods])


# --------------------------------------------------------------------------- W2
ROLLING_STATS = ("ma", "std", "min", "max", "q25", "q75")


def rolling_expr(x: Column, stat: str, frame: WindowSpec) -> Column:
    if stat in ("ma", "mean"):
        return F.avg(x).over(frame)
    if stat == "std":
        return F.stddev_samp(x).over(frame)
    if stat == "std_pop":
        return F.stddev_pop(x).over(frame)
    if stat == "min":
        return F.min(x).over(frame)
    if stat == "max":
        return F.max(x).over(frame)
    if stat == "sum":
        return F.sum(x).over(frame)
    if stat.startswith("q"):
        return F.percentile(x, int(stat[1:]) / 100.0).over(frame)
    raise ValueError(f"unknown rolling statistic {stat!r}")


def rolling_features(df: DataFrame, cols: Sequence[str], windows: Sequence[int], order_by,
                     partition_by=None, stats: Sequence[str] = ROLLING_STATS,
                     min_periods: int | None = None, name="{c}_{s}_{n}") -> DataFrame:
    """Rolling statistics over the last ``n`` rows; null until the frame
    holds ``min_periods`` (default ``n``) non-null values."""
    out = []
    for c in cols:
        for n in windows:
            frame = trailing(order_by, partition_by, n)
            mp = n if min_periods is None else min_periods
            for s in stats:
                out.append(full(rolling_expr(F.col(c), s, frame), F.col(c), frame, mp)
                           .alias(name.format(c=c, s=s, n=n)))
    return df.select("*", *out)


# --------------------------------------------------------------------------- W3
def rolling_percentile_rank(df: DataFrame, cols: Sequence[str], windows: Sequence[int], order_by,
                            partition_by=None, name="{c}_percentile_{n}d") -> DataFrame:
    """Average-rank percentile of the current value within the last n rows
    (frame materialised as an array of at most n values, H4)."""
    out = []
    for c in cols:
        for n in windows:
            frame = trailing(order_by, partition_by, n)
            arr = F.collect_list(c).over(frame)
            x = F.col(c)
            less = F.size(F.filter(arr, lambda v: v < x))
            equal = F.size(F.filter(arr, lambda v: v == x))
            pct = (less + (equal + 1) / 2.0) / F.size(arr)
            out.append(full(F.when(x.isNotNull(), pct), x, frame, n).alias(name.format(c=c, n=n)))
    return df.select("*", *out)


# --------------------------------------------------------------------------- W4
def rolling_slope(df: DataFrame, cols: Sequence[str], windows: Sequence[int], order_by,
                  partition_by=None, name="{c}_slope_{n}") -> DataFrame:
    """OLS slope of the value against its row index over the last n rows."""
    idx = "__rs_idx"
    w = spec(order_by, partition_by)
    d = df.select("*", F.row_number().over(w).cast("double").alias(idx))
    out = []
    for c in cols:
        for n in windows:
            frame = trailing(order_by, partition_by, n)
            out.append(full(F.regr_slope(F.col(c), F.col(idx)).over(frame), F.col(c), frame, n)
                       .alias(name.format(c=c, n=n)))
    return d.select(*df.columns, *out)


# --------------------------------------------------------------------------- W5
def rolling_corr(df: DataFrame, a: str, b: str, n: int, order_by, partition_by=None,
                 name: str | None = None) -> DataFrame:
    frame = trailing(order_by, partition_by, n)
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(1))
    r = F.when(F.count(both).over(frame) >= n, F.corr(a, b).over(frame))
    return df.select("*", r.alias(name or f"{a}_{b}_corr_{n}"))


# ------------------------------------------------------------------------ W6-W8
def ffill_expr(x: Column, order_by, partition_by=None) -> Column:
    return F.last(x, ignorenulls=True).over(rows(order_by, partition_by, None, 0))


def bfill_expr(x: Column, order_by, partition_by=None) -> Column:
    return F.first(x, ignorenulls=True).over(rows(order_by, partition_by, 0, None))


def forward_fill(df: DataFrame, cols: Sequence[str], order_by, partition_by=None) -> DataFrame:
    cols = set(cols)
    return df.select(*[ffill_expr(F.col(c), order_by, partition_by).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def backward_fill(df: DataFrame, cols: Sequence[str], order_by, partition_by=None) -> DataFrame:
    cols = set(cols)
    return df.select(*[bfill_expr(F.col(c), order_by, partition_by).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def forward_then_backward_fill(df: DataFrame, cols, order_by, partition_by=None) -> DataFrame:
    cols = set(cols)
    return df.select(*[F.coalesce(ffill_expr(F.col(c), order_by, partition_by),
                                  bfill_expr(F.col(c), order_by, partition_by)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def interpolate_linear(df: DataFrame, cols: Sequence[str], order_by, partition_by=None,
                       fill_edges: bool = False) -> DataFrame:
    """Linear interpolation by row position (not by date) of inner gaps;
    trailing nulls take the last value, leading nulls stay null unless
    ``fill_edges`` (then backward filled, as interpolate + ffill + bfill)."""
    pos = "__ip_pos"
    d = df.select("*", F.row_number().over(spec(order_by, partition_by)).cast("double").alias(pos))
    past = rows(order_by, partition_by, None, 0)
    future = rows(order_by, partition_by, 0, None)
    out = []
    cols = set(cols)
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
            continue
        x = F.col(c)
        p = F.col(pos)
        pv = F.last(x, ignorenulls=True).over(past)
        pp = F.last(F.when(x.isNotNull(), p), ignorenulls=True).over(past)
        nv = F.first(x, ignorenulls=True).over(future)
        np_ = F.first(F.when(x.isNotNull(), p), ignorenulls=True).over(future)
        inner = pv + (nv - pv) * (p - pp) / (np_ - pp)
        v = F.when(x.isNotNull(), x).when(pv.isNotNull() & nv.isNotNull(), inner).otherwise(pv)
        if fill_edges:
            v = F.coalesce(v, nv)
        out.append(v.alias(c))
    return d.select(*out)


# --------------------------------------------------------------------------- W9
def rank_pct_expr(x: Column, partition_by: Sequence[str] | None = None) -> Column:
    """Average-rank percentile of ``x`` among non-null values (pandas
    ``rank(pct=True)``).  Unpartitioned form is for bounded tables; for
    fact tables use ``global_order.rank_pct``."""
    part = list(partition_by or [])
    w_order = (Window.partitionBy(*part) if part else Window).orderBy(x)
    w_all = Window.partitionBy(*part) if part else Window.partitionBy()
    w_tie = Window.partitionBy(*part, x)
    avg_rank = F.rank().over(w_order) + (F.count(F.lit(1)).over(w_tie) - 1) / 2.0
    return F.when(x.isNotNull(), avg_rank / F.count(x).over(w_all))


# -------------------------------------------------------------------------- W10
def cumulative_sum(df: DataFrame, col: str, order_by, partition_by=None,
                   name: str | None = None, share: bool = False) -> DataFrame:
    cum = F.sum(col).over(rows(order_by, partition_by, None, 0))
    cols = [cum.alias(name or f"{col}_cumsum")]
    if share:
        tot = F.sum(col).over(Window.partitionBy(*(partition_by or [])))
        cols.append(safe_div(cum, tot).alias(f"{col}_cumshare"))
    return df.select("*", *cols)


# -------------------------------------------------------------------------- W11
def longest_equal_run(df: DataFrame, cols: Sequence[str], order_by, partition_by=None) -> DataFrame:
    """Gaps-and-islands: longest run of equal consecutive values per column
    (nulls break a run, as NaN != NaN).  Long output: partition keys,
    ``column``, ``max_run``."""
    w = spec(order_by, partition_by)
    keys = list(partition_by or [])
    past = rows(order_by, partition_by, None, 0)
    parts = []
    for c in cols:
        same = F.coalesce(F.col(c) == F.lag(c, 1).over(w), F.lit(False))
        d = df.select(*keys, *order_by, F.when(same, 0).otherwise(1).alias("__chg"))
        d = d.select(*keys, F.sum("__chg").over(past).alias("__grp"))
        parts.append(d.groupBy(*keys, "__grp").agg(F.count(F.lit(1)).alias("__len"))
                      .groupBy(*keys).agg(F.max("__len").alias("max_run"))
                      .select(*keys, F.lit(c).alias("column"), "max_run"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -------------------------------------------------------------------------- W12
def dedupe(df: DataFrame, keys: Sequence[str], order_by, keep: str = "first") -> DataFrame:
    """Keep the first (or last) row per key in ``order_by`` order."""
    order = [F.col(c) if keep == "first" else F.col(c).desc() for c in order_by]
    rn = "__dd_rn"
    return (df.select("*", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias(rn))
              .where(F.col(rn) == 1).drop(rn))


# -------------------------------------------------------------------------- W13
def flows_from_balances(balances: DataFrame, entity="customer_id", order_by=("date",),
                        balance="balance") -> DataFrame:
    """Deposit flow = balance - previous balance; inflow/outflow split; the
    first row of each entity (no previous balance) is dropped."""
    w = spec(list(order_by), [entity])
    prev = F.lag(balance, 1).over(w)
    d = balances.select("*", prev.alias("balance_start"))
    flow = F.col(balance) - F.col("balance_start")
    return (d.where(F.col("balance_start").isNotNull())
             .select(*[c for c in balances.columns if c != balance],
                     flow.alias("deposit_flow"),
                     F.greatest(flow, F.lit(0.0)).alias("inflow"),
                     F.least(flow, F.lit(0.0)).alias("outflow"),
                     "balance_start", F.col(balance).alias("balance_end")))


# -------------------------------------------------------------------------- W14
def lag1_autocorr(df: DataFrame, col: str, order_by, partition_by=None, min_rows: int = 0,
                  name: str = "autocorr_lag1") -> DataFrame:
    """corr(x_t, x_{t-1}) per partition; fewer than ``min_rows`` rows or an
    undefined correlation gives 0."""
    w = spec(order_by, partition_by)
    d = df.select(*(partition_by or []), F.col(col).alias("__x"), F.lag(col, 1).over(w).alias("__xl"))
    keys = list(partition_by or [])
    r = nan_to_null(F.corr("__x", "__xl"))
    ok = F.count(F.lit(1)) > min_rows
    return d.groupBy(*keys).agg(F.coalesce(F.when(ok, r), F.lit(0.0)).alias(name))


# -------------------------------------------------------------------------- W15
def centred_decomposition(df: DataFrame, col: str, order_by, partition_by=None,
                          trend_window: int = 30, seasonal_window: int = 7) -> DataFrame:
    """trend = centred mean over ``trend_window`` rows (pandas center=True
    frame), detrended = x - trend, seasonal = centred mean of detrended over
    ``seasonal_window``, residual = detrended - seasonal."""
    def centred(n: int) -> WindowSpec:
        before = n // 2
        after = n - 1 - before
        return spec(order_by, partition_by).rowsBetween(-before, after)

    tf = centred(trend_window)
    x = F.col(col)
    d = df.select("*", full(F.avg(x).over(tf), x, tf, trend_window).alias(f"{col}_trend"))
    d = d.select("*", (F.col(col) - F.col(f"{col}_trend")).alias(f"{col}_detrended"))
    sf = centred(seasonal_window)
    dt = F.col(f"{col}_detrended")
    d = d.select("*", full(F.avg(dt).over(sf), dt, sf, seasonal_window).alias(f"{col}_seasonal"))
    return d.select("*", (F.col(f"{col}_detrended") - F.col(f"{col}_seasonal")).alias(f"{col}_residual"))


# -------------------------------------------------------------------------- W22
def lookback_sequences(df: DataFrame, cols: Sequence[str], lookback: int, target: str, order_by,
                       partition_by=None) -> DataFrame:
    """Previous ``lookback`` rows (excluding the current) as an array of
    feature arrays, with the current row's target; incomplete windows drop."""
    frame = spec(order_by, partition_by).rowsBetween(-lookback, -1)
    feats = F.array(*[F.col(c).cast("double") for c in cols])
    seq = F.collect_list(feats).over(frame)
    d = df.select(*(partition_by or []), *order_by, seq.alias("sequence"), F.col(target).alias("target"))
    return d.where(F.size("sequence") == lookback)
