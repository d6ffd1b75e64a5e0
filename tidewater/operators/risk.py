"""Liquidity, concentration and behavioural risk measures.

Each measure is one (or two) aggregation passes returning a one-row frame,
or one row per group when ``by`` is given.  Second passes that need a
first-pass statistic (expected shortfall, violations) join the per-group
statistics back; with no grouping they use a scalar subquery instead of a
join.  Global-order quantities (Gini, top-k shares) come from the value
ladder of :mod:`tidewater.plans.global_order`, never from a one-task sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import combine_rows, np_round, safe_div, scalar_fields, with_row
from ..plans.global_order import exact_quantiles, join_groups, value_count_ladder
from ..schemas import LCR_BUFFER, LCR_MINIMUM
from . import windows as W


def risk_level(ratio: Column) -> Column:
    return (F.when(ratio >= LCR_MINIMUM + LCR_BUFFER, "Low")
             .when(ratio >= LCR_MINIMUM, "Medium").otherwise("High"))


# --------------------------------------------------------------------------- R1
def lcr_ratio(deposits: DataFrame, by: Sequence[str] = (), balance_col: str | None = "balance",
              flow_col: str | None = "deposit_flow", liquid_assets: float | None = None) -> DataFrame:
    """Liquid assets = 0.15 * sum(balance) (1e9 without a balance column);
    30-day outflow = 30 * mean |flow| over outflow rows (0 if none; 10 % of
    liquid assets without a flow column)."""
    cols = set(deposits.columns)
    if liquid_assets is not None:
        liquid = F.lit(float(liquid_assets))
    elif balance_col and balance_col in cols:
        liquid = F.coalesce(F.sum(balance_col), F.lit(0.0)) * 0.15
    else:
        liquid = F.lit(1e9 * 0.15)
    if flow_col and flow_col in cols:
        f = F.col(flow_col)
        avg_out = F.coalesce(F.avg(F.when(f < 0, F.abs(f))), F.lit(0.0))
        net30 = avg_out * 30
    else:
        avg_out = F.lit(None).cast("double")
        net30 = liquid * 0.1
    agg = deposits.groupBy(*by).agg(liquid.alias("liquid_assets"), net30.alias("net_30day_outflow"),
                                    avg_out.alias("avg_daily_outflow"))
    ratio = F.col("liquid_assets") / (F.col("net_30day_outflow") + 1e-8)
    return agg.select(*by, ratio.alias("lcr_ratio"), "liquid_assets", "net_30day_outflow",
                      F.lit(LCR_MINIMUM).alias("minimum_required"),
                      F.lit(LCR_MINIMUM + LCR_BUFFER).alias("buffer_target"),
                      risk_level(ratio).alias("risk_level"),
                      (F.col("liquid_assets") - F.col("net_30day_outflow") * LCR_MINIMUM).alias("excess_liquidity"),
                      (F.col("liquid_assets") / (F.col("avg_daily_outflow") + 1e-8)).alias("days_to_depletion"))


# --------------------------------------------------------------------------- R2
def deposit_at_risk(flows: DataFrame, confidence: float = 0.95, by: Sequence[str] = (),
                    flow_col: str = "deposit_flow", min_rows: int = 30) -> DataFrame:
    """Historical (linear percentile) and parametric VaR, expected
    shortfall, skew/kurtosis (population, as scipy), violation share.
    Groups with fewer than ``min_rows`` non-null flows are dropped."""
    z = NormalDist().inv_cdf(1 - confidence)
    f = flows.select(*by, F.col(flow_col).alias("__f")).where(F.col("__f").isNotNull())
    hv = exact_quantiles(f, "__f", [1 - confidence], ["historical_var"], by=by)
    s1 = f.groupBy(*by).agg(F.count("__f").alias("n"),
                            F.avg("__f").alias("mean"), F.stddev_samp("__f").alias("std"),
                            F.skewness("__f").alias("skewness"), F.kurtosis("__f").alias("kurtosis"),
                            F.min("__f").alias("min"), F.max("__f").alias("max")) \
        .where(F.col("n") >= min_rows)
    s1 = s1.join(hv, list(by)) if by else s1.select("*", hv.select("historical_var").scalar()
                                                    .alias("historical_var"))
    j = join_groups(f, s1.select(*by, "historical_var"), list(by), "left") if by else \
        with_row(f, s1.select("historical_var"), "__h").select("*", F.col("__h")["historical_var"].alias("historical_var"))
    s2 = j.groupBy(*by).agg(F.avg(F.when(F.col("__f") <= F.col("historical_var"), F.col("__f")))
                            .alias("__es"),
                            F.count(F.when(F.col("__f") < F.col("historical_var"), 1)).alias("__viol"))
    out = s1.join(s2, list(by), "inner") if by else with_row(s1, s2, "__s2").select(
        "*", F.col("__s2")["__es"].alias("__es"), F.col("__s2")["__viol"].alias("__viol"))
    return out.select(*by, F.lit(confidence).alias("confidence_level"), "n", "historical_var",
                      (F.col("mean") + z * F.col("std")).alias("parametric_var"),
                      F.coalesce(F.col("__es"), F.col("historical_var")).alias("expected_shortfall"),
                      (F.abs(F.col("historical_var")) / (F.col("std") + 1e-8)).alias("var_ratio"),
                      "mean", "std", "skewness", "kurtosis", "min", "max",
                      (F.col("__viol") / F.col("n")).alias("backtesting_violations"))


def monte_carlo_var(flows: DataFrame, confidence: float = 0.95, n_sim: int = 10_000,
                    seed: int = 42, flow_col: str = "deposit_flow") -> DataFrame:
    """Monte Carlo VaR: percentile of ``n_sim`` normal draws with the
    flows' mean and sample std (own seed; statistically, not bit, equal)."""
    stats = flows.agg(F.avg(flow_col).alias("m"), F.stddev_samp(flow_col).alias("s"))
    sims = flows.sparkSession.range(n_sim).select(F.randn(seed).alias("z"))
    sf = scalar_fields(stats)
    return sims.select((F.col("z") * sf["s"] + sf["m"]).alias("x")) \
        .agg(F.percentile("x", 1 - confidence).alias("monte_carlo_var"))


# --------------------------------------------------------------------------- R3
def segment_shares(customers: DataFrame, key: str = "segment", balance: str = "balance_avg") -> DataFrame:
    """Exposure share per key value (sum(balance)/total)."""
    per = customers.groupBy(key).agg(F.sum(balance).alias("exposure"))
    total = customers.agg(F.sum(balance)).scalar()
    return per.select(key, "exposure", (F.col("exposure") / total).alias("share"))


def concentration_parts(customers: DataFrame, balance: str = "balance_avg") -> list[DataFrame]:
    """One-row inputs of R3: segment shares summary, region summary, large
    depositors above the exact 95th percentile."""
    seg = segment_shares(customers, "segment", balance)
    # one row per segment value: collecting shares is bounded by the segment domain
    seg_row = seg.agg(F.sum(F.col("share") * F.col("share")).alias("hhi_index"),
                      F.aggregate(F.slice(F.sort_array(F.collect_list("share"), asc=False), 1, 3),
                                  F.lit(0.0), lambda a, x: a + x).alias("top_3_concentration"),
                      F.max("share").alias("max_segment_exposure"),
                      F.count(F.lit(1)).alias("n_segments"))
    reg = segment_shares(customers, "region", balance)
    reg_row = reg.agg(F.max("share").alias("max_region_exposure"), F.count(F.lit(1)).alias("n_regions"))
    thr = exact_quantiles(customers, balance, [0.95], ["t"]).scalar()
    b = F.col(balance)
    big = customers.agg(F.lit(thr).alias("threshold"),
                        F.count(F.when(b >= thr, 1)).alias("n_large_depositors"),
                        (F.sum(F.when(b >= thr, b)) / F.sum(b)).alias("large_depositor_concentration"),
                        F.avg(F.when(b >= thr, b)).alias("avg_large_depositor_balance"),
                        F.max(b).alias("largest_depositor_balance"))
    return [seg_row, reg_row, big]


def concentration_finish(out: DataFrame) -> DataFrame:
    f1 = F.coalesce(F.col("top_3_concentration") > 0.7, F.lit(False))
    f2 = F.coalesce(F.col("large_depositor_concentration") > 0.3, F.lit(False))
    flags = F.array_compact(F.array(F.when(f1, F.lit("High segment concentration")),
                                    F.when(f2, F.lit("High large depositor concentration"))))
    n = f1.cast("int") + f2.cast("int")
    return out.select("*", flags.alias("risk_flags"),
                      F.when(n >= 2, "High").when(n == 1, "Medium").otherwise("Low").alias("overall_risk"))


def concentration_risk(customers: DataFrame, balance: str = "balance_avg") -> DataFrame:
    """HHI, top-3 and max segment share, region max share, large
    depositors (>= exact 95th percentile): count, share, mean, max; flags
    and level."""
    return concentration_finish(combine_rows(concentration_parts(customers, balance)))


# --------------------------------------------------------------------------- R4
RISK_WEIGHTS_RISK = (0.4, 0.35, 0.25)


def behavioral_risk_score(rate_sensitivity="rate_sensitivity", loyalty="loyalty_score",
                          volatility="volatility_factor", weights=RISK_WEIGHTS_RISK) -> Column:
    """w1*rate_sens + w2*(1 - loyalty) + w3*volatility."""
    a, b, c = weights
    return (F.col(rate_sensitivity) * a + (1 - F.col(loyalty)) * b + F.col(volatility) * c)


def segment_behavioral_risk(customers: DataFrame) -> DataFrame:
    """R4 segment scores, rounded half-even to 4, with risk-weighted exposure."""
    c = customers.select("*", behavioral_risk_score().alias("behavioral_risk_score"))
    g = c.groupBy("segment").agg(
        np_round(F.avg("behavioral_risk_score"), 4).alias("mean_behavioral_risk_score"),
        np_round(F.stddev_samp("behavioral_risk_score"), 4).alias("std_behavioral_risk_score"),
        F.count("behavioral_risk_score").alias("count_behavioral_risk_score"),
        np_round(F.sum("balance_avg"), 4).alias("sum_balance_avg"),
        np_round(F.avg("rate_sensitivity"), 4).alias("mean_rate_sensitivity"),
        np_round(F.avg("loyalty_score"), 4).alias("mean_loyalty_score"),
        np_round(F.avg("volatility_factor"), 4).alias("mean_volatility_factor"))
    return g.select("*", (F.col("mean_behavioral_risk_score") * F.col("sum_balance_avg"))
                    .alias("risk_weighted_exposure"))


def segment_flow_risk(flows: DataFrame, min_rows: int = 10, parity_order: bool = False) -> DataFrame:
    """R4 flow part: per-segment flow std/mean/count/min/max and lag-1
    persistence.  Persistence is computed on the segment-daily total series
    (bounded by the calendar) unless ``parity_order``, where rows are taken
    in (customer_id, date) order inside the segment."""
    stats = flows.groupBy("segment").agg(F.stddev_samp("deposit_flow").alias("flow_std"),
                                         F.avg("deposit_flow").alias("flow_mean"),
                                         F.count("deposit_flow").alias("flow_count"),
                                         F.min("deposit_flow").alias("flow_min"),
                                         F.max("deposit_flow").alias("flow_max"))
    if parity_order:
        series, order = flows.select("segment", "customer_id", "date", "deposit_flow"), ["customer_id", "date"]
    else:
        series = flows.groupBy("segment", "date").agg(F.sum("deposit_flow").alias("deposit_flow"))
        order = ["date"]
    pers = W.lag1_autocorr(series, "deposit_flow", order, ["segment"], min_rows=min_rows,
                           name="persistence")
    return stats.join(pers, "segment", "left")


# --------------------------------------------------------------------------- R5
def gini_and_top_shares(df: DataFrame, col: str, shares: Sequence[float] = (0.10, 0.05, 0.01),
                        ladder: DataFrame | None = None) -> DataFrame:
    """Gini = sum((2i-n-1) x_(i)) / (n sum x) over ascending x, and the share
    of the total held by the top int(n*p) values, both from the value ladder:
    a value v with count c and ``below`` smaller values contributes
    v*c*(2*below + c - n); ties need no order.  The k-th largest value t
    is the largest v with at least k values >= v; the top-k sum is
    sum(x > t) + (k - count(x > t)) * t."""
    lad = ladder if ladder is not None else value_count_ladder(df, col)
    v, c, below, n = F.col(col), F.col("c"), F.col("below"), F.col("__n")
    ks = [F.floor(n * F.lit(p)) for p in shares]
    base = lad.agg(F.first("__n").alias("n"),
                   (F.sum(v * c * (2 * below + c - n)) / (F.first("__n") * F.sum(v * c))).alias("gini_coefficient"),
                   F.sum(v * c).alias("total"),
                   *[F.max(F.when(n - below >= k, v)).alias(f"__t{i}") for i, k in enumerate(ks)])
    lad2 = with_row(lad, base, "__b")
    above = lad2.agg(*[x for i in range(len(shares)) for x in (
        F.coalesce(F.sum(F.when(v > F.col("__b")[f"__t{i}"], v * c)), F.lit(0.0)).alias(f"s{i}"),
        F.coalesce(F.sum(F.when(v > F.col("__b")[f"__t{i}"], c)), F.lit(0)).alias(f"m{i}"))])
    r = with_row(base, above, "__a")
    res = [F.col("gini_coefficient"), F.col("total"), F.col("n")]
    for i, p in enumerate(shares):
        k = F.floor(F.col("n") * F.lit(p))
        t = F.col(f"__t{i}")
        top = F.when(k > 0, F.col("__a")[f"s{i}"] + (k - F.col("__a")[f"m{i}"]) * t).otherwise(F.lit(0.0))
        res.append((top / F.col("total")).alias(f"top_{int(round(p * 100))}_pct_share"))
    return r.select(*res)


# --------------------------------------------------------------------------- R7
def market_liquidity_risk(market: DataFrame, order_by: str = "date") -> DataFrame:
    """Latest-row market stress: VIX vs its 63-row mean, 30-row rate change,
    10Y-2Y spread, with labels.  Market is bounded by the calendar, so its
    unpartitioned windows are fine."""
    w = W.spec([order_by])
    f63 = W.trailing([order_by], None, 63)
    m = market.select(order_by, "VIX", "FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_2Y",
                      W.full(F.avg("VIX").over(f63), F.col("VIX"), f63, 63).alias("avg_vix_3m"),
                      (F.col("FED_FUNDS_RATE") - F.lag("FED_FUNDS_RATE", 30).over(w)).alias("rate_change_30d"))
    last = m.agg(F.max_by(F.struct(*[c for c in m.columns]), F.col(order_by)).alias("r")).select("r.*")
    vix, rate = F.col("VIX"), F.col("FED_FUNDS_RATE")
    spread = F.col("TREASURY_10Y") - F.col("TREASURY_2Y")
    return last.select(
        F.col(order_by).alias("as_of"), vix.alias("current_vix"), "avg_vix_3m",
        safe_div(vix, F.col("avg_vix_3m")).alias("vix_stress_indicator"),
        F.when(vix > 30, "High").when(vix > 20, "Medium").otherwise("Low").alias("stress_level"),
        rate.alias("current_rate"), "rate_change_30d",
        F.when(rate > 5, "High").when(rate > 1, "Normal").otherwise("Low").alias("rate_regime"),
        spread.alias("current_spread"),
        F.when(spread < 0, "Inverted").when(spread < 0.5, "Flat").otherwise("Normal").alias("curve_shape"))


# ------------------------------------------------------------------------ R6/R8
def funding_stability(flows: DataFrame, flow_col: str = "deposit_flow") -> DataFrame:
    """R6 funding stability: std, skew, kurtosis, share of positive days,
    share below -2 std, min, mean of flows below -std."""
    d = with_row(flows, flows.agg(F.stddev_samp(flow_col).alias("sd")), "__sd")
    f = F.col(flow_col)
    sd = F.col("__sd")["sd"]
    return d.agg(F.stddev_samp(f).alias("flow_volatility"), F.skewness(f).alias("flow_skewness"),
                     F.kurtosis(f).alias("flow_kurtosis"),
                     (F.count(F.when(f > 0, 1)) / F.count(F.lit(1))).alias("positive_flow_days"),
                     (F.count(F.when(f < -2 * sd, 1)) / F.count(F.lit(1))).alias("large_outflow_days"),
                     F.min(f).alias("max_single_day_outflow"),
                     F.avg(F.when(f < -sd, f)).alias("avg_outflow_on_stress_days"))


def overall_liquidity_risk_score(lcr: Column, top10: Column, flow_vol: Column, violations: Column,
                                 n_warnings: Column) -> Column:
    """0-10 weighted score (.3 LCR, .25 concentration, .2 volatility,
    .15 VaR violations, .1 warnings); missing inputs take neutral values."""
    lcr = F.coalesce(lcr, F.lit(1.0))
    top10 = F.coalesce(top10, F.lit(0.3))
    flow_vol = F.coalesce(flow_vol, F.lit(0.0))
    violations = F.coalesce(violations, F.lit(0.0))
    lcr_s = F.when(lcr < 1.0, 4.0).when(lcr < 1.1, 2.0).otherwise(0.0)
    conc_s = F.when(top10 > 0.3, F.least(F.lit(4.0), (top10 - 0.3) / 0.2 * 4.0)).otherwise(0.0)
    vol_s = F.when(flow_vol > 0, F.least(F.lit(4.0), flow_vol / 1_000_000 * 2)).otherwise(0.0)
    var_s = F.when(violations > 0.05, F.least(F.lit(4.0), violations / 0.1 * 4.0)).otherwise(0.0)
    warn_s = F.least(F.lit(4.0), n_warnings * 1.5)
    return F.least(F.lit(10.0), lcr_s * 0.3 + conc_s * 0.25 + vol_s * 0.2 + var_s * 0.15 + warn_s * 0.1)


def liquidity_parts(deposits: DataFrame, market: DataFrame | None = None,
                    balance_col: str | None = "balance", flow_col: str = "deposit_flow") -> list[DataFrame]:
    """The one-row inputs of R6 (R1, R2, funding stability, distribution,
    R7), to be combined side by side."""
    lcr = lcr_ratio(deposits, balance_col=balance_col, flow_col=flow_col)
    dar = deposit_at_risk(deposits, flow_col=flow_col)
    fs = funding_stability(deposits, flow_col)
    parts = [lcr.select("lcr_ratio", "risk_level", "liquid_assets", "net_30day_outflow"),
             dar.select("historical_var", "parametric_var", "expected_shortfall", "backtesting_violations"),
             fs]
    if balance_col and balance_col in deposits.columns:
        b = F.col(balance_col)
        # one value ladder serves the median, the Gini and the top shares
        lad = value_count_ladder(deposits, balance_col)
        med = exact_quantiles(deposits, balance_col, [0.5], ["m"], ladder=lad).scalar()
        dist = deposits.agg(F.sum(b).alias("total_deposits"), F.avg(b).alias("avg_deposit"),
                            F.lit(med).alias("median_deposit"))
        parts += [dist, gini_and_top_shares(deposits, balance_col, ladder=lad).drop("total", "n")]
    if market is not None:
        parts.append(market_liquidity_risk(market).drop("as_of"))
    return parts


def liquidity_finish(row: DataFrame) -> DataFrame:
    """Early warnings and the R8 score on a combined R6 row."""
    top10 = F.col("top_10_pct_share") if "top_10_pct_share" in row.columns else F.lit(None).cast("double")
    warnings = F.array_compact(F.array(
        F.when(F.coalesce(F.col("lcr_ratio"), F.lit(1.0)) < 1.1, F.lit("LCR below buffer threshold")),
        F.when(F.coalesce(F.col("backtesting_violations"), F.lit(0.0)) > 0.05, F.lit("High VaR violations")),
        F.when(F.coalesce(top10, F.lit(0.0)) > 0.5, F.lit("High deposit concentration"))))
    row = row.select("*", warnings.alias("early_warnings"))
    return row.select("*", overall_liquidity_risk_score(
        F.col("lcr_ratio"), top10, F.col("flow_volatility"), F.col("backtesting_violations"),
        F.size("early_warnings")).alias("overall_risk_score"))


def liquidity_metrics(deposits: DataFrame, market: DataFrame | None = None,
                      balance_col: str | None = "balance", flow_col: str = "deposit_flow") -> DataFrame:
    """One row combining R1, R2, deposit distribution (when a balance
    column exists), funding stability, R7, early warnings and R8."""
    return liquidity_finish(combine_rows(liquidity_parts(deposits, market, balance_col, flow_col)))


# -------------------------------------------------------------------------- R10
# fixed values: the alert texts
ALERT_LCR_MINIMUM = "CRITICAL: LCR below regulatory minimum"
ALERT_LCR_BUFFER = "WARNING: LCR below buffer threshold"
ALERT_MARKET = "HIGH STRESS: Elevated market volatility"
ALERT_FLOWS = "ATTENTION: High deposit flow volatility"


def dashboard_alerts(lcr: Column, vix: Column, flow_std: Column, flow_mean: Column) -> Column:
    """R10 rule array: LCR < 1 critical, < 1.1 warning, VIX > 30, flow std >
    .5 * mean (a negative mean always alerts)."""
    return F.array_compact(F.array(
        F.when(lcr < 1.0, F.lit(ALERT_LCR_MINIMUM)).when(lcr < 1.1, F.lit(ALERT_LCR_BUFFER)),
        F.when(vix > 30, F.lit(ALERT_MARKET)),
        F.when(flow_std > 0.5 * flow_mean, F.lit(ALERT_FLOWS))))


# --------------------------------------------------------------------------- R9
def risk_report(deposits: DataFrame, customers: DataFrame, market: DataFrame | None = None,
                balance_col: str | None = "balance") -> DataFrame:
    """One row: data period and size, R6 liquidity metrics, R3
    concentration, and the executive summary: risk level (> 7 High, > 4
    Medium, else Low), number of flags and recommendation rules.  All
    one-row inputs are combined in a single level."""
    period = deposits.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"),
                          F.count(F.lit(1)).alias("n_observations"))
    parts = [period] + liquidity_parts(deposits, market, balance_col) + concentration_parts(customers)
    row = concentration_finish(liquidity_finish(combine_rows(parts)))
    row = row.withColumnRenamed("overall_risk", "concentration_risk")
    score, lcr = F.col("overall_risk_score"), F.coalesce(F.col("lcr_ratio"), F.lit(1.0))
    n_flags = F.size("early_warnings")
    recs = F.array_compact(F.array(
        F.when(lcr < 1.1, F.lit("Increase liquid asset buffer to improve LCR ratio")),
        F.when(n_flags > 2, F.lit("Implement enhanced monitoring due to multiple risk flags")),
        F.when(F.col("concentration_risk") == "High", F.lit("Diversify deposit base to reduce concentration risk")),
        F.when(score > 6, F.lit("Consider stress testing and contingency funding plan review"))))
    recs = F.when(F.size(recs) == 0, F.array(F.lit("Current risk profile is acceptable, maintain monitoring"))) \
            .otherwise(recs)
    return row.select("*", F.when(score > 7, "High").when(score > 4, "Medium").otherwise("Low").alias("summary_risk_level"),
                      n_flags.alias("n_risk_flags"), recs.alias("recommendations"))


def alerts(deposits: DataFrame, market: DataFrame, balance_col: str = "balance") -> DataFrame:
    """Dashboard alert list from the LCR, the latest VIX and flow
    dispersion (one row)."""
    lcr = lcr_ratio(deposits, balance_col=balance_col).select("lcr_ratio")
    vix = market.agg(F.max_by("VIX", "date").alias("vix"))
    fl = deposits.agg(F.stddev_samp("deposit_flow").alias("flow_std"), F.avg("deposit_flow").alias("flow_mean"))
    row = combine_rows([lcr, vix, fl])
    return row.select("*", dashboard_alerts(F.col("lcr_ratio"), F.col("vix"), F.col("flow_std"),
                                            F.col("flow_mean")).alias("alerts"))
