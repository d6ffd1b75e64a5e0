"""Cleaning operators.

Column choice follows the modelled application's name rules (helpers over
``df.columns``, driver-side metadata only).  Statistics needed by a rule
(mean/std, quartiles, medians) come from one aggregation and are attached
as scalar subqueries; fact-size quantiles use the distributed value ladder.
Filters of the form "drop bad rows" keep NULL rows, as pandas does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import clean_double, clip, numeric_columns, with_row
from ..plans.column_ladder import column_ladder, wide_quantiles
from ..plans.global_order import exact_quantiles, join_groups
from ..schemas import SEGMENTS
from . import windows as W


# --------------------------------------------------------------------------- P1
def clean_numeric_data(df: DataFrame, cols: Sequence[str] | None = None, z_limit: float = 5.0) -> DataFrame:
    """+/-inf and NaN -> NULL, then |z| > 5 -> NULL (sample std, only where
    std > 0); statistics over the finite values."""
    cols = list(cols or numeric_columns(df))
    finite = df.select(*[clean_double(c).alias(c) if c in cols else F.col(c) for c in df.columns])
    st = finite.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                    *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(cols)])
    finite = with_row(finite, st, "__st")
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            m, s = F.col("__st")[f"m_{i}"], F.col("__st")[f"s_{i}"]
            bad = F.coalesce((s > 0) & (F.abs((F.col(c) - m) / s) > z_limit), F.lit(False))
            out.append(F.when(~bad, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return finite.select(*out)


# --------------------------------------------------------------------------- P2
def outlier_flag(df: DataFrame, col: str, method: str = "iqr", threshold: float | None = None,
                 by: Sequence[str] = (), name: str = "is_outlier") -> DataFrame:
    """iqr (default k 1.5), zscore (sample std, default 3), modified_zscore
    (0.6745*(x-median)/MAD, default 3.5); unknown method -> all False.
    NULL values are never outliers.  Quartiles/medians are exact, from the
    value ladder (per ``by`` group)."""
    x = F.col(col)
    keys = list(by)

    def attach(stats: DataFrame) -> DataFrame:
        if keys:
            return join_groups(df, stats, keys, "left")
        d = with_row(df, stats, "__stats")
        return d.select(*df.columns, *[F.col("__stats")[c].alias(c) for c in stats.columns])

    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        d = attach(exact_quantiles(df, col, [0.25, 0.75], ["__q1", "__q3"], by=keys))
        iqr = F.col("__q3") - F.col("__q1")
        cond = (x < F.col("__q1") - k * iqr) | (x > F.col("__q3") + k * iqr)
        drop = ["__q1", "__q3"]
    elif method == "zscore":
        k = 3.0 if threshold is None else threshold
        d = attach(df.groupBy(*keys).agg(F.avg(col).alias("__m"), F.stddev_samp(col).alias("__s")))
        cond = F.abs((x - F.col("__m")) / F.col("__s")) > k
        drop = ["__m", "__s"]
    elif method == "modified_zscore":
        k = 3.5 if threshold is None else threshold
        d = attach(exact_quantiles(df, col, [0.5], ["__med"], by=keys))
        dev = d.select(*keys, F.abs(x - F.col("__med")).alias("__dev"))
        mad = exact_quantiles(dev, "__dev", [0.5], ["__mad"], by=keys)
        d = join_groups(d, mad, keys, "left") if keys else d.select("*", mad.select("__mad").scalar().alias("__mad"))
        cond = F.abs(0.6745 * (x - F.col("__med")) / F.col("__mad")) > k
        drop = ["__med", "__mad"]
    else:
        return df.select("*", F.lit(False).alias(name))
    return d.select("*", F.coalesce(cond, F.lit(False)).alias(name)).drop(*drop)


# ------------------------------------------------------------------------ P3/P4
def fill_expr(df: DataFrame, c: str, method: str, order_by, partition_by=None,
              stats: DataFrame | None = None) -> Column:
    x = F.col(c)
    if method == "mean":
        return F.coalesce(x, df.agg(F.avg(c)).scalar())
    if method == "median":
        return F.coalesce(x, exact_quantiles(df, c, [0.5], ["m"]).scalar())
    if method == "mode":
        m = df.agg(F.mode(c, deterministic=True)).scalar()
        if isinstance(df.schema[c].dataType, T.StringType):
            return F.coalesce(x, m, F.lit("Unknown"))
        return F.coalesce(x, m)
    if method == "zero":
        return F.coalesce(x, F.lit(0).cast(df.schema[c].dataType))
    if method == "forward_fill":
        return W.ffill_expr(x, order_by, partition_by)
    if method == "backward_fill":
        return W.bfill_expr(x, order_by, partition_by)
    raise ValueError(method)


def handle_missing_values(df: DataFrame, strategy: Mapping[str, str] | None = None,
                          order_by: Sequence[str] = ("date",), partition_by=None) -> DataFrame:
    """Per-column strategy (drop, mean, median, mode, forward_fill,
    backward_fill, interpolate = linear + ffill + bfill, zero).  Default:
    numeric -> interpolate, others -> forward_fill.  Absent columns skip."""
    if strategy is None:
        num = set(numeric_columns(df, exclude=list(order_by)))
        strategy = {c: ("interpolate" if c in num else "forward_fill")
                    for c in df.columns if c not in order_by and c not in (partition_by or [])}
    strategy = {c: m for c, m in strategy.items() if c in df.columns}
    out = df
    for c, m in strategy.items():
        if m == "drop":
            out = out.where(F.col(c).isNotNull())
    interp = [c for c, m in strategy.items() if m == "interpolate"]
    if interp:
        out = W.interpolate_linear(out, interp, list(order_by), partition_by, fill_edges=True)
    sel = []
    for c in out.columns:
        m = strategy.get(c)
        if m in (None, "drop", "interpolate"):
            sel.append(F.col(c))
        else:
            sel.append(fill_expr(out, c, m, list(order_by), partition_by).alias(c))
    return out.select(*sel)


def handle_missing_frame(df: DataFrame, method: str = "forward_fill", order_by=("date",),
                         partition_by=None) -> DataFrame:
    """One method for the whole frame: forward_fill (then bfill),
    interpolate (numeric; then forward and backward fill of what is left),
    zero_fill (numeric), mean_fill (mean for numeric, mode or
    'Unknown' for the rest)."""
    cols = [c for c in df.columns if c not in order_by and c not in (partition_by or [])]
    num = set(numeric_columns(df))
    if method == "forward_fill":
        return W.forward_then_backward_fill(df, cols, list(order_by), partition_by)
    if method == "interpolate":
        inner = W.interpolate_linear(df, [c for c in cols if c in num], list(order_by), partition_by)
        return W.forward_then_backward_fill(inner, cols, list(order_by), partition_by)
    if method == "zero_fill":
        return df.select(*[F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c)
                           if c in num and c in cols else F.col(c) for c in df.columns])
    if method == "mean_fill":
        return df.select(*[fill_expr(df, c, "mean" if c in num else "mode", list(order_by)).alias(c)
                           if c in cols else F.col(c) for c in df.columns])
    raise ValueError(method)


# --------------------------------------------------------------------------- P5
MARKET_FILL = {"FED_FUNDS_RATE": "forward_fill", "TREASURY_10Y": "interpolate", "TREASURY_2Y": "interpolate",
               "TREASURY_3M": "interpolate", "VIX": "forward_fill", "EURUSD": "forward_fill",
               "GBPUSD": "forward_fill"}
FX_MARKERS = ["USD", "EUR", "GBP", "JPY"]


def clean_market_data(market: DataFrame, date_col: str = "date", ingest_order: str | None = None) -> DataFrame:
    """P5 in the modelled order: per-series fill; rates (name has RATE or
    TREASURY) outside [-2, 20] -> NULL; VIX outside [8, 100] -> NULL; FX
    outside (0, 10] -> NULL; duplicate dates keep the first (by
    ``ingest_order``, else arbitrary); linear interpolation; ffill; bfill.
    One row per day, so the unpartitioned windows are calendar bounded."""
    o = [date_col] + ([ingest_order] if ingest_order else [])
    d = handle_missing_values(market, MARKET_FILL, order_by=o)
    nums = numeric_columns(d, exclude=[date_col] + ([ingest_order] if ingest_order else []))
    sel = []
    for c in d.columns:
        x = F.col(c)
        if c not in nums:
            sel.append(x)
            continue
        if "RATE" in c or "TREASURY" in c:
            x = F.when(~F.coalesce((x < -2.0) | (x > 20.0), F.lit(False)), x)
        if c == "VIX":
            x = F.when(~F.coalesce((x < 8) | (x > 100), F.lit(False)), x)
        if any(m in c for m in FX_MARKERS):
            x = F.when(~F.coalesce((x <= 0) | (x > 10), F.lit(False)), x)
        sel.append(x.alias(c))
    d = d.select(*sel)
    d = W.dedupe(d, [date_col], [ingest_order] if ingest_order else [date_col], keep="first")
    if ingest_order:
        d = d.drop(ingest_order)
    return W.interpolate_linear(d, nums, [date_col], fill_edges=True)


# --------------------------------------------------------------------------- P6
CUSTOMER_FILL = {"balance_avg": "median", "rate_sensitivity": "mean", "loyalty_score": "mean",
                 "volatility_factor": "mean", "region": "mode", "industry": "mode"}


def clean_customer_data(customers: DataFrame, as_of: str, ingest_order: str | None = None) -> DataFrame:
    """Dedupe customer_id keep first; drop balance outside [0, 1e8]
    (NULL kept); clip the three scores to [0, 1]; drop invalid or NULL
    segments; drop opening dates before 1990-01-01 or after ``as_of``;
    fill medians/means/modes of the remaining rows."""
    d = W.dedupe(customers, ["customer_id"], [ingest_order or "customer_id"], keep="first")
    b = F.col("balance_avg")
    d = d.where(~F.coalesce((b < 0) | (b > 1e8), F.lit(False)))
    d = d.select(*[clip(c, 0.0, 1.0).alias(c) if c in ("rate_sensitivity", "loyalty_score", "volatility_factor")
                   else F.col(c) for c in d.columns])
    d = d.where(F.coalesce(F.col("segment").isin(*SEGMENTS), F.lit(False)))
    if "account_opening_date" in d.columns:
        od = F.col("account_opening_date").cast("date")
        d = d.where(~F.coalesce((od < F.lit("1990-01-01").cast("date")) | (od > F.lit(as_of).cast("date")),
                                F.lit(False)))
    return handle_missing_values(d, CUSTOMER_FILL, order_by=["customer_id"])


# --------------------------------------------------------------------------- P7
def clean_flow_data(flows: DataFrame, as_of: str, ingest_order: str | None = None,
                    iqr_k: float = 3.0) -> DataFrame:
    """Dedupe (customer_id, date) keep last; drop dates after
    ``as_of``; clip every column whose name contains 'flow' to
    [Q1 - 3 IQR, Q3 + 3 IQR] (exact quartiles); recompute balance_end where
    |end - (start + clipped flow)| > 0.01; negative balances -> 0; NULL
    flows -> 0; a ``balance`` column is forward filled per customer."""
    d = W.dedupe(flows, ["customer_id", "date"], [ingest_order or "date"], keep="last")
    d = d.where(~F.coalesce(F.col("date") > F.lit(as_of).cast("date"), F.lit(False)))
    flow_cols = [c for c in d.columns if "flow" in c.lower() and c in numeric_columns(d)]
    names = d.columns
    if flow_cols:
        quartiles = wide_quantiles(column_ladder(d, flow_cols), flow_cols, {"q1": 0.25, "q3": 0.75})
        d = with_row(d, quartiles, "__q")
    sel = []
    for c in names:
        x = F.col(c)
        if c in flow_cols:
            # a column without values has no quartiles, and is left as it is
            q1, q3 = F.col("__q")[c]["q1"], F.col("__q")[c]["q3"]
            lo, hi = q1 - iqr_k * (q3 - q1), q3 + iqr_k * (q3 - q1)
            x = F.when(x < lo, lo).when(x > hi, hi).otherwise(x).alias(c)
        sel.append(x)
    d = d.select(*sel)
    if {"balance_start", "balance_end", "deposit_flow"} <= set(d.columns):
        calc = F.col("balance_start") + F.col("deposit_flow")
        bad = F.coalesce(F.abs(F.col("balance_end") - calc) > 0.01, F.lit(False))
        d = d.withColumn("balance_end", F.when(bad, calc).otherwise(F.col("balance_end")))
    bal = [c for c in d.columns if "balance" in c.lower() and c in numeric_columns(d)]
    d = d.select(*[F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)).alias(c) if c in bal else F.col(c)
                   for c in d.columns])
    strategy = {"deposit_flow": "zero", "inflow": "zero", "outflow": "zero", "balance": "forward_fill"}
    return handle_missing_values(d, strategy, order_by=["date"], partition_by=["customer_id"])


# --------------------------------------------------------------------------- P8
def segment_band_case(balance: Column, bands) -> Column:
    """First band (in order) with min <= balance < max; NULL if none."""
    expr = F.lit(None).cast("string")
    for name, lo, hi in reversed(bands):
        cond = balance >= lo
        if hi is not None:
            cond = cond & (balance < hi)
        expr = F.when(cond, F.lit(name)).otherwise(expr)
    return expr


def apply_business_rules(customers: DataFrame, flows: DataFrame, as_of: str,
                         bands=None) -> tuple[DataFrame, DataFrame]:
    """Flag accounts opened within 30 days of ``as_of``; CORPORATE below
    1M -> SME; drop flows of customers whose std(flow)/balance_avg > 0.5;
    a customer outside its segment's band moves to the first band that
    holds its balance (unchanged when none does)."""
    from ..schemas import CORPORATE_MIN_BALANCE, MIN_HISTORY_DAYS, RELATIVE_VOLATILITY_LIMIT, SEGMENT_BANDS
    from .joins import relative_volatility
    bands = bands or SEGMENT_BANDS
    c = customers
    if "account_opening_date" in c.columns:
        cutoff = F.date_sub(F.lit(as_of).cast("date"), MIN_HISTORY_DAYS)
        c = c.withColumn("insufficient_history",
                         F.coalesce(F.col("account_opening_date").cast("date") > cutoff, F.lit(False)))
    b = F.col("balance_avg")
    c = c.withColumn("segment", F.when((F.col("segment") == "CORPORATE") & (b < CORPORATE_MIN_BALANCE),
                                       F.lit("SME")).otherwise(F.col("segment")))
    mismatch = F.lit(False)
    for name, lo, hi in bands:
        out_of = b < lo
        if hi is not None:
            out_of = out_of | (b > hi)
        mismatch = mismatch | ((F.col("segment") == name) & out_of)
    c = c.withColumn("segment", F.when(F.coalesce(mismatch, F.lit(False)),
                                       F.coalesce(segment_band_case(b, bands), F.col("segment")))
                     .otherwise(F.col("segment")))
    extreme = relative_volatility(flows, customers).where(
        F.col("relative_volatility") > RELATIVE_VOLATILITY_LIMIT).select("customer_id")
    f = flows.join(extreme, "customer_id", "left_anti")
    return c, f


# --------------------------------------------------------------------------- P9
def remove_anomalous_patterns(df: DataFrame, pattern_cols: Sequence[str], order_by, partition_by=None,
                              missing_threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Report (column, n_unique, is_constant, max_consecutive_equal,
    suspicious = max run > 10) and drop rows with more than 50 % numeric
    NULLs.  Returns (cleaned rows, report)."""
    num = numeric_columns(df)
    cleaned = df
    if num:
        nulls = sum((F.col(c).isNull().cast("int") for c in num), F.lit(0))
        cleaned = df.where(~(nulls / len(num) > missing_threshold))
    if not pattern_cols:
        return cleaned, None
    runs = W.longest_equal_run(df, pattern_cols, order_by, partition_by)
    uniq = df.agg(*[F.countDistinct(c).alias(c) for c in pattern_cols])
    uniq_long = uniq.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                         F.col(c).alias("n_unique")) for c in pattern_cols]))
                            .alias("s")).select("s.*")
    rep = runs.groupBy("column").agg(F.max("max_run").alias("max_run")).join(uniq_long, "column")
    rep = rep.select("column", "n_unique", (F.col("n_unique") == 1).alias("is_constant"),
                     (F.col("max_run") - 1).alias("max_consecutive_equal"),
                     (F.col("max_run") - 1 > 10).alias("suspicious"))
    return cleaned, rep


# -------------------------------------------------------------------------- P10
def convert_data_types(df: DataFrame, conversions: Mapping[str, str]) -> DataFrame:
    """numeric / datetime coerce (bad -> NULL), string, category (string),
    boolean, or any Spark type name via try_cast."""
    out = []
    for c in df.columns:
        t = conversions.get(c)
        x = F.col(c)
        if t is None:
            out.append(x)
        elif t == "numeric":
            out.append(x.cast("string").try_cast("double").alias(c))
        elif t == "datetime":
            out.append(F.try_to_timestamp(x.cast("string")).alias(c))
        elif t in ("string", "category"):
            out.append(x.cast("string").alias(c))
        elif t == "boolean":
            out.append(x.try_cast("boolean").alias(c))
        else:
            out.append(x.try_cast(t).alias(c))
    return df.select(*out)


# -------------------------------------------------------------------------- P11
_TYPE_CLASSES = {
    "numeric": T.NumericType, "int": T.IntegralType, "float": T.FractionalType, "string": T.StringType,
    "object": T.StringType, "bool": T.BooleanType, "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def validate_data_types(df: DataFrame, expected: Mapping[str, str]) -> dict[str, bool]:
    """{column: matches} from schema metadata (no job)."""
    out = {}
    for c, t in expected.items():
        if c not in df.columns:
            out[c] = False
            continue
        cls = _TYPE_CLASSES.get(t)
        dt = df.schema[c].dataType
        out[c] = isinstance(dt, cls) if cls else dt.simpleString() == t
    return out


def validate_types_frame(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    res = validate_data_types(df, expected)
    return df.sparkSession.createDataFrame([(k, v) for k, v in res.items()], "column string, valid boolean")
