"""Feature operators.

Market features are windows over one row per day (calendar bounded).
Customer features use one aggregation for the fitted statistics (means,
exact quantiles from the value ladder) attached as scalar subqueries.
The EMA recurrence of RSI/MACD is the one place that needs Python: it runs
per series in ``applyInPandas`` on the long form (one group per series).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import flow_date_flags
from ..functions.core import flag, safe_div, with_row
from ..plans.column_ladder import column_ladder, wide_quantiles
from ..plans.global_order import exact_quantiles, rank_pct
from . import windows as W


# ------------------------------------------------------------------------ P14
def yield_curve_features(market: DataFrame, date_col: str = "date") -> DataFrame:
    """10Y-2Y steepness and its change, 2Y-3M, 10Y-3M, butterfly 2Y+10Y-2*5Y."""
    w = W.spec([date_col])
    s = F.col("TREASURY_10Y") - F.col("TREASURY_2Y")
    d = market.select("*", s.alias("YIELD_CURVE_STEEPNESS"),
                      (F.col("TREASURY_2Y") - F.col("TREASURY_3M")).alias("SHORT_END_STEEPNESS"),
                      (F.col("TREASURY_10Y") - F.col("TREASURY_3M")).alias("SPREAD_10Y3M"),
                      (F.col("TREASURY_2Y") + F.col("TREASURY_10Y") - 2 * F.col("TREASURY_5Y"))
                      .alias("YIELD_CURVE_CURVATURE"))
    return d.select("*", (F.col("YIELD_CURVE_STEEPNESS") - F.lag("YIELD_CURVE_STEEPNESS").over(w))
                    .alias("YIELD_CURVE_STEEPNESS_change"))


# ------------------------------------------------------------------------ P15
def collector_regimes(market: DataFrame, curve_col: str = "YIELD_CURVE_SLOPE") -> DataFrame:
    """Rate <= 2 / (2, 5] / > 5; VIX <= 15 / (15, 25] / > 25; curve < 0 /
    [0, 1] / > 1 (NULL compares as false -> 0)."""
    r, v = F.col("FED_FUNDS_RATE"), F.col("VIX")
    cols = [flag(r <= 2.0).alias("RATE_REGIME_LOW"), flag((r > 2.0) & (r <= 5.0)).alias("RATE_REGIME_NORMAL"),
            flag(r > 5.0).alias("RATE_REGIME_HIGH"), flag(v <= 15).alias("VOL_REGIME_LOW"),
            flag((v > 15) & (v <= 25)).alias("VOL_REGIME_NORMAL"), flag(v > 25).alias("VOL_REGIME_HIGH")]
    if curve_col in market.columns:
        c = F.col(curve_col)
        cols += [flag(c < 0).alias("CURVE_INVERTED"), flag((c >= 0) & (c <= 1.0)).alias("CURVE_FLAT"),
                 flag(c > 1.0).alias("CURVE_STEEP")]
    return market.select("*", *cols)


# ------------------------------------------------------------------------ P16
def transformer_market_features(market: DataFrame, date_col: str = "date") -> DataFrame:
    """Spreads, log VIX, VIX < 20 / > 30 flags, VIX change and pct change,
    four rate bands, rate x VIX."""
    w = W.spec([date_col])
    r, v = F.col("FED_FUNDS_RATE"), F.col("VIX")
    s = F.col("TREASURY_10Y") - F.col("TREASURY_2Y")
    return market.select(
        "*", s.alias("yield_spread_10y2y"), (s - F.lag(s).over(w)).alias("yield_spread_change"),
        (F.col("TREASURY_2Y") - F.col("TREASURY_3M")).alias("yield_spread_2y3m"),
        F.when(v > 0, F.ln(v)).alias("VIX_log"), flag(v < 20).alias("VIX_regime_low"),
        flag(v > 30).alias("VIX_regime_high"), (v - F.lag(v).over(w)).alias("VIX_change"),
        (safe_div(v, F.lag(v).over(w)) - 1).alias("VIX_pct_change"),
        flag(r <= 0.25).alias("rate_regime_zero"), flag((r > 0.25) & (r <= 2.0)).alias("rate_regime_low"),
        flag((r > 2.0) & (r <= 5.0)).alias("rate_regime_normal"), flag(r > 5.0).alias("rate_regime_high"),
        (r * v).alias("rate_vix_interaction"))


# ------------------------------------------------------------------------ W18
def market_bundle(market: DataFrame, date_col: str = "date") -> DataFrame:
    """Per rate column (name with RATE or TREASURY) its change, 20-row
    std, 5- and 20-row means and 5-row mean change; the P16 features; calendar
    parts with the month as sine and cosine; what the windows leave empty is
    filled backward, then forward.  One row per day, so the windows over the
    whole table are bounded by the calendar."""
    o = [date_col]
    rates = [c for c in market.columns if "RATE" in c or "TREASURY" in c]
    w = W.spec(o)
    d = market.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_change") for c in rates])
    d = W.rolling_features(d, rates, [20], o, stats=("std",), name="{c}_volatility")
    d = W.rolling_features(d, rates, [5, 20], o, stats=("ma",), name="{c}_ma_{n}")
    d = W.rolling_features(d, [f"{c}_change" for c in rates], [5], o, stats=("ma",), name="{c}_mean")
    d = d.withColumnsRenamed({f"{c}_change_mean": f"{c}_momentum" for c in rates})
    d = transformer_market_features(d, date_col)
    t = F.col(date_col)
    angle = F.month(t) * (2 * math.pi / 12)
    d = d.select("*", F.year(t).alias("year"), F.month(t).alias("month"), F.quarter(t).alias("quarter"),
                 F.weekday(t).alias("day_of_week"), F.weekofyear(t).alias("week_of_year"),
                 F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"))
    cols = [c for c in d.columns if c != date_col]
    return d.select(date_col, *[F.coalesce(W.bfill_expr(F.col(c), o, None), W.ffill_expr(F.col(c), o, None)).alias(c)
                                for c in cols])


# ------------------------------------------------------------------------ P17
def engineer_regimes(market: DataFrame, date_col: str = "date") -> DataFrame:
    """VIX against its 21-row mean +/- 0.5 std (incomplete window: normal);
    rate bands; 21-row OLS slope > .01 tightening, < -.01 easing, else
    stable (NULL slope: all 0); unemployment vs 63-row mean when present."""
    f21 = W.trailing([date_col], None, 21)
    v, r = F.col("VIX"), F.col("FED_FUNDS_RATE")
    m = W.full(F.avg(v).over(f21), v, f21, 21)
    s = W.full(F.stddev_samp(v).over(f21), v, f21, 21)
    d = W.rolling_slope(market, ["FED_FUNDS_RATE"], [21], [date_col], name="__slope")
    low = F.coalesce(v < m - 0.5 * s, F.lit(False))
    high = F.coalesce(v > m + 0.5 * s, F.lit(False))
    sl = F.col("__slope")
    cols = [low.cast("int").alias("VIX_regime_low"), high.cast("int").alias("VIX_regime_high"),
            (~low & ~high).cast("int").alias("VIX_regime_normal"),
            flag(r <= 0.25).alias("RATE_regime_zero"), flag((r > 0.25) & (r <= 2.0)).alias("RATE_regime_low"),
            flag((r > 2.0) & (r <= 5.0)).alias("RATE_regime_normal"), flag(r > 5.0).alias("RATE_regime_high"),
            flag(sl > 0.01).alias("RATE_cycle_tightening"), flag(sl < -0.01).alias("RATE_cycle_easing"),
            flag((sl >= -0.01) & (sl <= 0.01)).alias("RATE_cycle_stable")]
    if "UNEMPLOYMENT" in market.columns:
        f63 = W.trailing([date_col], None, 63)
        u = F.col("UNEMPLOYMENT")
        t = u - W.full(F.avg(u).over(f63), u, f63, 63)
        cols += [flag(t > 0.5).alias("ECON_cycle_recession"), flag(t < -0.5).alias("ECON_cycle_recovery")]
    return d.select(*market.columns, *cols)


# ------------------------------------------------------------------------ P12
def interaction_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """a_X_b = a*b and a_over_b = a/(b + 1e-8) per pair."""
    cols = []
    for a, b in pairs:
        cols += [(F.col(a) * F.col(b)).alias(f"{a}_X_{b}"), (F.col(a) / (F.col(b) + 1e-8)).alias(f"{a}_over_{b}")]
    return df.select("*", *cols)


def default_interaction_pairs(df: DataFrame) -> list[tuple[str, str]]:
    """First 3 numeric 'rate' columns x first 2 numeric 'vix'/'vol' columns."""
    from ..functions.core import numeric_columns
    num = numeric_columns(df)
    rates = [c for c in num if "rate" in c.lower()][:3]
    vols = [c for c in num if "vix" in c.lower() or "vol" in c.lower()][:2]
    return [(a, b) for a in rates for b in vols if a != b]


# ------------------------------------------------------------------------ P19
def behavioral_risk_score(weights=(0.4, 0.3, 0.3)):
    a, b, c = weights
    return (F.col("rate_sensitivity") * a + (1 - F.col("loyalty_score")) * b + F.col("volatility_factor") * c)


# ------------------------------------------------------------------------ P20
def one_hot(df: DataFrame, col: str, domain: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
    """``prefix_value`` 0/1 columns over a supplied domain, else the sorted
    distinct values (a categorical domain: bounded, collected once)."""
    if domain is None:
        domain = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())
    p = prefix or col
    return df.select("*", *[flag(F.col(col) == v).alias(f"{p}_{v}") for v in domain])


# -------------------------------------------------------------------- P21/P22
def quartile_category(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """cut into (0,q25], (q25,q50], (q50,q75], (q75,inf) -> Q1..Q4 (rank
    1..4); values <= 0 fall outside every bin -> NULL."""
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], ["a", "b", "c"])
    d = with_row(df, q, "__q")
    a, b, c = F.col("__q")["a"], F.col("__q")["b"], F.col("__q")["c"]
    x = F.col(col)
    rank = F.when((x > 0) & (x <= a), 1).when((x > a) & (x <= b), 2).when((x > b) & (x <= c), 3).when(x > c, 4)
    n = name or f"{col}_category"
    return d.select(*df.columns, F.concat(F.lit("Q"), rank.cast("string")).alias(n), rank.alias(f"{n}_rank"))


def quintile_category(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """qcut into 5 equal-frequency bins (lowest edge included, right
    closed) with exact edges -> 1..5."""
    q = exact_quantiles(df, col, [0.0, 0.2, 0.4, 0.6, 0.8], ["e0", "e1", "e2", "e3", "e4"])
    d = with_row(df, q, "__q")
    e = [F.col("__q")[f"e{i}"] for i in range(5)]
    x = F.col(col)
    rank = (F.when((x >= e[0]) & (x <= e[1]), 1).when(x <= e[2], 2).when(x <= e[3], 3).when(x <= e[4], 4)
             .when(x.isNotNull(), 5))
    return d.select(*df.columns, rank.alias(name or f"{col}_quintile"))


# ------------------------------------------------------------------------- M1
def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    """Fitted parameters, one row per column: (column, center, scale).
    standard: mean / population std; minmax: min / (max - min);
    robust: median / IQR (exact quantiles)."""
    if method == "standard":
        fitted = {c: (F.avg(c), F.stddev_pop(c)) for c in cols}
    elif method == "minmax":
        fitted = {c: (F.min(c), F.max(c) - F.min(c)) for c in cols}
    elif method == "robust":
        q = wide_quantiles(column_ladder(df, cols), cols, {"q1": 0.25, "m": 0.5, "q3": 0.75})
        row = q.select(*[F.struct(F.col(c)["m"].alias("center"), (F.col(c)["q3"] - F.col(c)["q1"]).alias("scale")).alias(c)
                         for c in cols])
    else:
        raise ValueError(method)
    if method != "robust":
        row = df.agg(*[F.struct(m.cast("double").alias("center"), s.cast("double").alias("scale")).alias(c)
                       for c, (m, s) in fitted.items()])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["center"].alias("center"), F.col(c)["scale"].alias("scale"))
                     for c in cols])
    return row.select(F.explode(each).alias("__s")).select("__s.*")


def apply_scaler(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - center) / scale; a zero scale divides by 1 (as sklearn)."""
    # one scalar subquery holding every fitted (center, scale) pair
    wide = params.groupBy().pivot("column", list(cols)).agg(F.first(F.struct("center", "scale")))
    d = with_row(df, wide, "__p")
    sel = []
    for c in df.columns:
        if c in cols:
            ctr, sc = F.col("__p")[c]["center"], F.col("__p")[c]["scale"]
            sel.append(((F.col(c) - ctr) / F.when(sc == 0, F.lit(1.0)).otherwise(sc)).alias(c))
        else:
            sel.append(F.col(c))
    return d.select(*sel)


# ------------------------------------------------------------------------- M3
def select_features(df: DataFrame, target: str, candidates: Sequence[str], method: str = "correlation",
                    max_features: int = 50, min_variance: float = 0.01) -> DataFrame:
    """Ranked feature list: top |corr| with the target (target excluded),
    or population variance above ``min_variance``; at most ``max_features``."""
    cands = [c for c in candidates if c != target]
    if method == "correlation":
        wide = df.agg(*[F.corr(c, target).alias(c) for c in cands])
    else:
        wide = df.agg(*[F.var_pop(c).alias(c) for c in cands])
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("score")) for c in cands])
    long = wide.select(F.explode(arr).alias("s")).select("s.*")
    if method == "correlation":
        long = long.where(F.col("score").isNotNull()).select("feature", F.abs("score").alias("score"))
    else:
        long = long.where(F.col("score") > min_variance)
    # one row per candidate column: the top-k order is bounded by the column count;
    # scores equal to 9 decimals are ties, broken by name
    return long.orderBy(F.round("score", 9).desc(), "feature").limit(max_features)


# ------------------------------------------------------------------------- M5
def transform_customers(customers: DataFrame, as_of: str, segments: Sequence[str] | None = None) -> DataFrame:
    """One-hot segment/region, balance quartile category and log1p, balance
    percentile (average rank), behavioural risk score and its quintile,
    account age, segment mean/deviation of balance."""
    d = one_hot(customers, "segment", segments)
    d = one_hot(d, "region")
    d = quartile_category(d, "balance_avg", "balance_category")
    d = d.select("*", F.log1p(F.when(F.col("balance_avg") > -1, F.col("balance_avg"))).alias("balance_log"))
    d = rank_pct(d, "balance_avg", "balance_percentile")
    d = d.select("*", behavioral_risk_score().alias("behavioral_risk_score"))
    d = quintile_category(d, "behavioral_risk_score", "risk_quintile")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("account_opening_date"))
    # segment means by partial aggregation; one row per segment: broadcast
    seg = customers.groupBy("segment").agg(F.avg("balance_avg").alias("segment_balance_mean"))
    d = d.join(F.broadcast(seg), "segment", "left")
    return d.select("*", age.alias("account_age_days"), (age / 365.25).alias("account_age_years"),
                    (F.col("balance_avg") - F.col("segment_balance_mean")).alias("balance_vs_segment"))


# ------------------------------------------------------------------------ W19
def rate_change_features(market: DataFrame, cols: Sequence[str], date_col: str = "date") -> DataFrame:
    """diff 1/5/21, momentum (diff of diff), std of daily change over 5/21,
    percentile rank over 63/252 rows."""
    w = W.spec([date_col])
    d = market
    for c in cols:
        ch = F.col(c) - F.lag(c, 1).over(w)
        d = d.select("*", ch.alias(f"{c}_change_1d"), (F.col(c) - F.lag(c, 5).over(w)).alias(f"{c}_change_5d"),
                     (F.col(c) - F.lag(c, 21).over(w)).alias(f"{c}_change_21d"))
        d = d.select("*", (F.col(f"{c}_change_1d") - F.lag(f"{c}_change_1d").over(w)).alias(f"{c}_momentum"))
        d = W.rolling_features(d, [f"{c}_change_1d"], [5, 21], [date_col], stats=("std",),
                               name=c + "_volatility_{n}d")
        d = W.rolling_percentile_rank(d, [c], [63, 252], [date_col])
    return d


# ------------------------------------------------------------------------ W20
def _ema(x: pd.Series, span: int) -> pd.Series:
    return x.ewm(span=span, adjust=False).mean()


def _indicators(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("date")
    x = pdf["value"].astype(float)
    out = pd.DataFrame({"series": pdf["series"], "date": pdf["date"]})
    n = x.notna().sum()
    if n <= 50:
        for c in ("rsi_14", "macd", "macd_signal", "macd_histogram"):
            out[c] = float("nan")
        return out
    delta = x.diff()
    # the first row's change is unknown and counts as none, so it seeds both
    up, down = delta.where(delta > 0, 0.0), -delta.where(delta < 0, 0.0)
    # Wilder smoothing: EMA with alpha 1/14, min periods 14
    au = up.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    ad = down.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    rs = au / ad
    out["rsi_14"] = (100 - 100 / (1 + rs)).where(ad != 0, 100.0)
    fast = x.ewm(span=12, min_periods=12, adjust=False).mean()
    slow = x.ewm(span=26, min_periods=26, adjust=False).mean()
    macd = fast - slow
    sig = macd.ewm(span=9, min_periods=9, adjust=False).mean()
    out["macd"], out["macd_signal"], out["macd_histogram"] = macd, sig, macd - sig
    return out


def technical_indicators(market: DataFrame, cols: Sequence[str], date_col: str = "date") -> DataFrame:
    """RSI 14 and MACD 12/26/9 (EMA recurrences, pandas per series in
    ``applyInPandas``; the long form has one group per series, bounded by
    the calendar) plus Bollinger 20/2 and Williams %R 14 as window
    expressions; series with 50 or fewer values get NULL indicators.  Days
    without a value are left out of every window and have NULL indicators."""
    arr = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in cols])
    long = market.select(F.col(date_col).alias("date"), F.explode(arr).alias("s")).select("date", "s.*")
    days = long.select("series", "date")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    ema = long.groupBy("series").applyInPandas(
        _indicators, "series string, date date, rsi_14 double, macd double, macd_signal double, "
                     "macd_histogram double")
    f20 = W.trailing(["date"], ["series"], 20)
    f14 = W.trailing(["date"], ["series"], 14)
    v = F.col("value")
    mid = W.full(F.avg(v).over(f20), v, f20, 20)
    sd = W.full(F.stddev_pop(v).over(f20), v, f20, 20)
    hi, lo = W.full(F.max(v).over(f14), v, f14, 14), W.full(F.min(v).over(f14), v, f14, 14)
    cnt = F.count(v).over(W.spec(["date"], ["series"]).rowsBetween(-10**9, 10**9))
    ok = cnt > 50
    bb = long.select("series", "date", F.when(ok, mid + 2 * sd).alias("bb_upper"), F.when(ok, mid).alias("bb_middle"),
                     F.when(ok, mid - 2 * sd).alias("bb_lower"),
                     F.when(ok, safe_div(4 * sd, mid)).alias("bb_width"),
                     F.when(ok, safe_div(v - hi, hi - lo) * 100).alias("williams_r"))
    return days.join(bb.join(ema, ["series", "date"], "left"), ["series", "date"], "left")


# ------------------------------------------------------------------------ W21
def target_variables(segment_daily: DataFrame, horizons: Sequence[int] = (1, 5, 21),
                     value: str = "segment_sum_deposit_flow") -> DataFrame:
    """Per segment: value led by h rows, and the flow volatility and net flow
    rate led by h rows where the table has them; large outflow/inflow flags
    at 2 x the global sample std of the value (NULL target -> 0)."""
    w = W.spec(["date"], ["segment"])
    sd = segment_daily.agg(F.stddev_samp(value)).scalar()
    cols = []
    for h in horizons:
        t = F.lead(value, h).over(w)
        cols += [F.lead(c, h).over(w).alias(f"target_{n}_{h}d") for n, c in (
            ("flow_volatility", "segment_flow_volatility"), ("net_flow_rate", "segment_net_flow_rate"))
            if c in segment_daily.columns]
        cols += [t.alias(f"target_flow_{h}d"),
                 F.coalesce((t < -2 * sd).cast("int"), F.lit(0)).alias(f"target_large_outflow_{h}d"),
                 F.coalesce((t > 2 * sd).cast("int"), F.lit(0)).alias(f"target_large_inflow_{h}d")]
    return segment_daily.select("*", *cols)


# ------------------------------------------------------------------------ W23
def transform_flows(flows: DataFrame) -> DataFrame:
    """Per customer-day: calendar parts and flags; flow direction, magnitude
    and its log1p; the customer's flow mean, std, min, max and count with the
    distance and z-score of the flow; lags 1/5/10/21; means and stds over
    5/10/21 rows (min 1); per balance column log1p, change and relative
    change; volatility over 10/21/63 rows (min 5); the segment's daily sum,
    mean and count.  Empty values are filled forward within the customer,
    then by 0.  Windows are per customer (one row per day at most); the
    segment's days are a small table, joined on (date, segment)."""
    from pyspark.sql import Window
    f = F.col("deposit_flow")
    wc = Window.partitionBy("customer_id")
    o, p = ["date"], ["customer_id"]
    w = W.spec(o, p)
    t = F.col("date")
    flags = flow_date_flags(flows).drop("MONTH", "QUARTER", "DAY_OF_WEEK", "WEEK_OF_YEAR")
    d = flags.select(
        "*", F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"),
        F.weekday(t).alias("day_of_week"), F.weekofyear(t).alias("week_of_year"), F.quarter(t).alias("quarter"),
        flag(f > 0).alias("is_inflow"), flag(f < 0).alias("is_outflow"), F.abs(f).alias("flow_magnitude"),
        F.log1p(F.abs(f)).alias("flow_magnitude_log"),
        F.avg(f).over(wc).alias("mean_customer"), F.stddev_samp(f).over(wc).alias("std_customer"),
        F.min(f).over(wc).alias("min_customer"), F.max(f).over(wc).alias("max_customer"),
        F.count(f).over(wc).alias("count_customer"),
        *[F.lag(f, k).over(w).alias(f"deposit_flow_lag_{k}") for k in (1, 5, 10, 21)])
    away = f - F.col("mean_customer")
    d = d.select("*", away.alias("flow_vs_customer_mean"), (away / (F.col("std_customer") + 1e-8)).alias("flow_zscore"))
    for c in ("balance_start", "balance_end"):
        x = F.col(c)
        d = d.select("*", F.log1p(F.when(x > -1, x)).alias(f"{c}_log"), (x - F.lag(x).over(w)).alias(f"{c}_change"),
                     (safe_div(x, F.lag(x).over(w)) - 1).alias(f"{c}_pct_change"))
    d = W.rolling_features(d, ["deposit_flow"], [5, 10, 21], o, p, stats=("ma", "std"), min_periods=1)
    d = W.rolling_features(d, ["deposit_flow"], [10, 21, 63], o, p, stats=("std",), min_periods=5,
                           name="flow_volatility_{n}d")
    fill = [c for c in d.columns if c not in flows.columns]
    d = W.forward_fill(d, fill, o, p)
    daily = flows.groupBy("date", "segment").agg(
        F.sum(f).alias("segment_sum_deposit_flow"), F.avg(f).alias("segment_mean_deposit_flow"),
        F.count(f).alias("segment_count_deposit_flow"))
    d = d.join(daily, ["date", "segment"], "left")
    fill += daily.columns[2:]
    return d.select(*flows.columns, *[F.coalesce(F.col(c), F.lit(0).cast(d.schema[c].dataType)).alias(c) for c in fill])


# ------------------------------------------------------------------------ P13
def market_segment_interactions(unified: DataFrame, segments: Sequence[str]) -> DataFrame:
    """rate x VIX, rate / (VIX + 1), steepness x VIX, each segment flow x the
    first two rate columns, the first three segment flows x VIX."""
    r, v = F.col("FED_FUNDS_RATE"), F.col("VIX")
    cols = [(r * v).alias("RATE_VIX_interaction"), (r / (v + 1)).alias("RATE_VIX_ratio")]
    if "YIELD_CURVE_STEEPNESS" in unified.columns:
        cols.append((F.col("YIELD_CURVE_STEEPNESS") * v).alias("CURVE_VIX_interaction"))
    rates = [c for c in unified.columns if ("RATE" in c or "TREASURY" in c) and c.isupper()][:2]
    flows = [f"deposit_flow_sum_{s}" for s in segments if f"deposit_flow_sum_{s}" in unified.columns]
    for fcol in flows:
        for rc in rates:
            cols.append((F.col(fcol) * F.col(rc)).alias(f"{fcol}_X_{rc}"))
    for fcol in flows[:3]:
        cols.append((F.col(fcol) * v).alias(f"{fcol}_X_VIX"))
    return unified.select("*", *cols)


def segment_day_interactions(df: DataFrame) -> DataFrame:
    """P13 on rows of (date, segment) with the day's market values: rate x
    VIX, rate / (VIX + 1), steepness x VIX, each column of the segment's
    summed flow x the first two columns of the policy rate, and the first
    three of them x VIX.  Columns whose factors are absent are left out."""
    has, v = set(df.columns), F.col("VIX")
    sums = [c for c in df.columns if "segment_sum_deposit_flow" in c]
    cols = []
    if {"FED_FUNDS_RATE", "VIX"} <= has:
        r = F.col("FED_FUNDS_RATE")
        cols += [(r * v).alias("RATE_VIX_interaction"), safe_div(r, v + 1).alias("RATE_VIX_ratio")]
    if {"YIELD_CURVE_STEEPNESS", "VIX"} <= has:
        cols.append((F.col("YIELD_CURVE_STEEPNESS") * v).alias("STEEPNESS_VIX_interaction"))
    for s in sums:
        cols += [(F.col(s) * F.col(r)).alias(f"{s}_X_{r}") for r in [c for c in df.columns if "FED_FUNDS_RATE" in c][:2]]
    if "VIX" in has:
        cols += [(F.col(s) * v).alias(f"{s}_X_VIX") for s in sums[:3]]
    return df.select("*", *cols)


# ------------------------------------------------------------------------ P23
# fixed values: monthly seasonal deposit factors (January .. December)
SEASONAL_FACTORS = [0.1, 0.05, -0.1, -0.05, 0.0, 0.1, -0.05, -0.05, 0.05, 0.0, -0.1, 0.15]


def behavioral_impacts(df: DataFrame, balance: str = "balance", rate_change: str = "rate_change",
                       vix: str = "vix", date_col: str = "date") -> DataFrame:
    """Deterministic impact terms on a customer x day x market row:
    rate impact = dr * sens * balance * .1 (x1.5 when |dr| > .5);
    seasonal = balance * month factor * segment multiplier (retail 1.5,
    SME 1.2, else 1) * .01; volatility impact (VIX > 25 inflow, < 15
    outflow) damped by (1 - volatility factor); loyalty impact on rate
    moves beyond +/- .25."""
    b, dr, vx = F.col(balance), F.col(rate_change), F.col(vix)
    rate = dr * F.col("rate_sensitivity") * b * 0.1
    rate = F.when(F.abs(dr) > 0.5, rate * 1.5).otherwise(rate)
    month_factor = F.element_at(F.array(*[F.lit(x) for x in SEASONAL_FACTORS]), F.month(date_col))
    mult = (F.when(F.col("segment").startswith("RETAIL"), 1.5).when(F.col("segment") == "SME", 1.2)
             .otherwise(1.0))
    vol = (F.when(vx > 25, b * 0.002 * (vx - 25) / 10).when(vx < 15, -b * 0.001 * (15 - vx) / 5)
            .otherwise(0.0)) * (1 - F.col("volatility_factor"))
    loy = (F.when(dr < -0.25, b * 0.001 * F.col("loyalty_score"))
            .when(dr > 0.25, b * 0.0005 * F.col("loyalty_score")).otherwise(0.0))
    return df.select("*", rate.alias("rate_impact"), (b * month_factor * mult * 0.01).alias("seasonal_impact"),
                     vol.alias("volatility_impact"), loy.alias("loyalty_impact"))


# ------------------------------------------------------------------------- M2
def pca_components(df: DataFrame, cols: Sequence[str], k: int = 3, names: Sequence[str] | None = None,
                   keys: Sequence[str] = ("date",), min_rows: int = 10) -> DataFrame:
    """Principal components of the complete rows (centred first: Spark's
    PCA does not centre), signs fixed so the largest |loading| of each
    component is positive; no rows unless there are more than ``min_rows``."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    import numpy as np
    d = df.select(*keys, *cols).dropna(subset=list(cols))
    means = d.agg(*[F.avg(c).alias(c) for c in cols]).first()
    n = d.count()
    names = list(names or [f"PC_{j + 1}" for j in range(k)])
    if n <= min_rows:
        return d.select(*keys, *[F.lit(None).cast("double").alias(c) for c in names]).limit(0)
    centred = d.select(*keys, *[(F.col(c) - float(means[c])).alias(c) for c in cols])
    vec = VectorAssembler(inputCols=list(cols), outputCol="__v").transform(centred)
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(vec)
    loadings = model.pc.toArray()  # len(cols) x k, tiny
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(vec).select(*keys, vector_to_array("__pc").alias("__a"))
    return out.select(*keys, *[(F.col("__a")[j] * signs[j]).alias(names[j]) for j in range(k)])
