"""Registered queries: feature engineering."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import calendar as CAL
from ..functions.core import round_doubles
from ..operators import features as FE
from ..operators import reports as RP
from ..operators.flows import segment_behavioral_features
from ..schemas import SEGMENTS
from .registry import register

AS_OF = "2024-01-31"


def rd(expr: str, name: str) -> str:
    return f"round({expr}, 4) AS {name}"


M = fx.sql_with("market")


@register("p14_p16_market_features", M + """,
b AS (SELECT date, FED_FUNDS_RATE AS r, VIX AS v, TREASURY_10Y AS t10, TREASURY_5Y AS t5, TREASURY_2Y AS t2,
             TREASURY_3M AS t3 FROM market)
SELECT date, """ + ", ".join([
    rd("t10 - t2", "YIELD_CURVE_STEEPNESS"), rd("t2 - t3", "SHORT_END_STEEPNESS"), rd("t10 - t3", "SPREAD_10Y3M"),
    rd("t2 + t10 - 2 * t5", "YIELD_CURVE_CURVATURE"),
    rd("(t10 - t2) - LAG(t10 - t2) OVER w", "YIELD_CURVE_STEEPNESS_change"),
    rd("CASE WHEN v > 0 THEN ln(v) END", "VIX_log"),
    "CAST(COALESCE(v < 20, false) AS INTEGER) AS VIX_regime_low",
    "CAST(COALESCE(v > 30, false) AS INTEGER) AS VIX_regime_high",
    rd("v - LAG(v) OVER w", "VIX_change"), rd("v / NULLIF(LAG(v) OVER w, 0) - 1", "VIX_pct_change"),
    "CAST(COALESCE(r <= 0.25, false) AS INTEGER) AS rate_regime_zero",
    "CAST(COALESCE(r > 0.25 AND r <= 2.0, false) AS INTEGER) AS rate_regime_low",
    "CAST(COALESCE(r > 2.0 AND r <= 5.0, false) AS INTEGER) AS rate_regime_normal",
    "CAST(COALESCE(r > 5.0, false) AS INTEGER) AS rate_regime_high",
    rd("r * v", "rate_vix_interaction")]) + """
FROM b WINDOW w AS (ORDER BY date)""")
def p14_p16_market_features(spark, sf_dir):
    m = fx.market(spark, sf_dir)
    d = FE.yield_curve_features(m)
    d = FE.transformer_market_features(d.drop("yield_spread_10y2y"))
    keep = ["date", "YIELD_CURVE_STEEPNESS", "SHORT_END_STEEPNESS", "SPREAD_10Y3M", "YIELD_CURVE_CURVATURE",
            "YIELD_CURVE_STEEPNESS_change", "VIX_log", "VIX_regime_low", "VIX_regime_high", "VIX_change",
            "VIX_pct_change", "rate_regime_zero", "rate_regime_low", "rate_regime_normal", "rate_regime_high",
            "rate_vix_interaction"]
    return round_doubles(d.select(*keep))


@register("p15_collector_regimes", M + """
SELECT date, CAST(COALESCE(FED_FUNDS_RATE <= 2.0, false) AS INTEGER) AS RATE_REGIME_LOW,
  CAST(COALESCE(FED_FUNDS_RATE > 2.0 AND FED_FUNDS_RATE <= 5.0, false) AS INTEGER) AS RATE_REGIME_NORMAL,
  CAST(COALESCE(FED_FUNDS_RATE > 5.0, false) AS INTEGER) AS RATE_REGIME_HIGH,
  CAST(COALESCE(VIX <= 15, false) AS INTEGER) AS VOL_REGIME_LOW,
  CAST(COALESCE(VIX > 15 AND VIX <= 25, false) AS INTEGER) AS VOL_REGIME_NORMAL,
  CAST(COALESCE(VIX > 25, false) AS INTEGER) AS VOL_REGIME_HIGH,
  CAST(COALESCE(TREASURY_10Y - TREASURY_2Y < 0, false) AS INTEGER) AS CURVE_INVERTED,
  CAST(COALESCE(TREASURY_10Y - TREASURY_2Y >= 0 AND TREASURY_10Y - TREASURY_2Y <= 1.0, false) AS INTEGER) AS CURVE_FLAT,
  CAST(COALESCE(TREASURY_10Y - TREASURY_2Y > 1.0, false) AS INTEGER) AS CURVE_STEEP
FROM market""")
def p15_collector_regimes(spark, sf_dir):
    m = fx.market(spark, sf_dir)
    m = m.select("date", "FED_FUNDS_RATE", "VIX", (F.col("TREASURY_10Y") - F.col("TREASURY_2Y")).alias("YIELD_CURVE_SLOPE"))
    return FE.collector_regimes(m).drop("FED_FUNDS_RATE", "VIX", "YIELD_CURVE_SLOPE")


@register("p17_engineer_regimes", M + """,
b AS (SELECT date, FED_FUNDS_RATE AS r, VIX AS v, CAST(row_number() OVER (ORDER BY date) AS DOUBLE) AS rn,
        CASE WHEN COUNT(VIX) OVER w21 >= 21 THEN AVG(VIX) OVER w21 END AS m,
        CASE WHEN COUNT(VIX) OVER w21 >= 21 THEN STDDEV_SAMP(VIX) OVER w21 END AS s
      FROM market WINDOW w21 AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN COUNT(r) OVER w21 >= 21 THEN regr_slope(r, rn) OVER w21 END AS sl,
        COALESCE(v < m - 0.5 * s, false) AS lo, COALESCE(v > m + 0.5 * s, false) AS hi
      FROM b WINDOW w21 AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))
SELECT date, CAST(lo AS INTEGER) AS VIX_regime_low, CAST(hi AS INTEGER) AS VIX_regime_high,
  CAST(NOT lo AND NOT hi AS INTEGER) AS VIX_regime_normal,
  CAST(COALESCE(r <= 0.25, false) AS INTEGER) AS RATE_regime_zero,
  CAST(COALESCE(r > 0.25 AND r <= 2.0, false) AS INTEGER) AS RATE_regime_low,
  CAST(COALESCE(r > 2.0 AND r <= 5.0, false) AS INTEGER) AS RATE_regime_normal,
  CAST(COALESCE(r > 5.0, false) AS INTEGER) AS RATE_regime_high,
  CAST(COALESCE(sl > 0.01, false) AS INTEGER) AS RATE_cycle_tightening,
  CAST(COALESCE(sl < -0.01, false) AS INTEGER) AS RATE_cycle_easing,
  CAST(COALESCE(sl >= -0.01 AND sl <= 0.01, false) AS INTEGER) AS RATE_cycle_stable
FROM c""")
def p17_engineer_regimes(spark, sf_dir):
    m = fx.market(spark, sf_dir).select("date", "FED_FUNDS_RATE", "VIX")
    return FE.engineer_regimes(m).drop("FED_FUNDS_RATE", "VIX")


@register("p12_interaction_features", M + """
SELECT date, """ + ", ".join(
    rd(f"{a} * {b}", f"{a}_X_{b}") + ", " + rd(f"{a} / ({b} + 1e-8)", f"{a}_over_{b}")
    for a, b in (("FED_FUNDS_RATE", "VIX"), ("TREASURY_10Y", "VIX"))) + " FROM market")
def p12_interaction_features(spark, sf_dir):
    m = fx.market(spark, sf_dir).select("date", "FED_FUNDS_RATE", "TREASURY_10Y", "VIX")
    d = FE.interaction_features(m, [("FED_FUNDS_RATE", "VIX"), ("TREASURY_10Y", "VIX")])
    return round_doubles(d.drop("FED_FUNDS_RATE", "TREASURY_10Y", "VIX"))


C = fx.sql_with("customers")


@register("m5_transform_customers", C + f""",
q AS (SELECT quantile_cont(balance_avg, 0.25) AS a, quantile_cont(balance_avg, 0.5) AS b,
             quantile_cont(balance_avg, 0.75) AS c FROM customers),
s AS (SELECT *, rate_sensitivity * 0.4 + (1 - loyalty_score) * 0.3 + volatility_factor * 0.3 AS score FROM customers),
e AS (SELECT quantile_cont(score, 0.0) AS e0, quantile_cont(score, 0.2) AS e1, quantile_cont(score, 0.4) AS e2,
             quantile_cont(score, 0.6) AS e3, quantile_cont(score, 0.8) AS e4 FROM s),
k AS (SELECT s.*, CASE WHEN balance_avg > 0 AND balance_avg <= a THEN 1 WHEN balance_avg > a AND balance_avg <= b THEN 2
                       WHEN balance_avg > b AND balance_avg <= c THEN 3 WHEN balance_avg > c THEN 4 END AS bcr,
             CASE WHEN score >= e0 AND score <= e1 THEN 1 WHEN score <= e2 THEN 2 WHEN score <= e3 THEN 3
                  WHEN score <= e4 THEN 4 WHEN score IS NOT NULL THEN 5 END AS rq,
             (rank() OVER (ORDER BY balance_avg) + (COUNT(*) OVER (PARTITION BY balance_avg) - 1) / 2.0)
               / COUNT(*) OVER () AS pct
      FROM s, q, e)
SELECT customer_id,
  {", ".join(f"CAST(COALESCE(segment = '{v}', false) AS INTEGER) AS segment_{v}" for v in
             ["CORPORATE", "RETAIL_LARGE", "RETAIL_MEDIUM", "RETAIL_SMALL", "SME"])},
  'Q' || CAST(bcr AS VARCHAR) AS balance_category, bcr AS balance_category_rank,
  round(CASE WHEN balance_avg > -1 THEN ln(1 + balance_avg) END, 4) AS balance_log,
  round(pct, 4) AS balance_percentile, round(score, 4) AS behavioral_risk_score, rq AS risk_quintile,
  datediff('day', account_opening_date, DATE '{AS_OF}') AS account_age_days,
  round(datediff('day', account_opening_date, DATE '{AS_OF}') / 365.25, 4) AS account_age_years,
  round(AVG(balance_avg) OVER (PARTITION BY segment), 4) AS segment_balance_mean,
  round(balance_avg - AVG(balance_avg) OVER (PARTITION BY segment), 4) AS balance_vs_segment
FROM k""")
def m5_transform_customers(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    d = FE.transform_customers(c, AS_OF)
    d = d.select(["customer_id"] + [f"segment_{v}" for v in ["CORPORATE", "RETAIL_LARGE", "RETAIL_MEDIUM",
                                                             "RETAIL_SMALL", "SME"]]
                 + ["balance_category", "balance_category_rank", "balance_log", "balance_percentile",
                    "behavioral_risk_score", "risk_quintile", "account_age_days", "account_age_years",
                    "segment_balance_mean", "balance_vs_segment"])
    return round_doubles(d)


@register("m1_standard_scaling", C + """,
p AS (SELECT AVG(balance_avg) AS mb, STDDEV_POP(balance_avg) AS sb, AVG(rate_sensitivity) AS mr,
             STDDEV_POP(rate_sensitivity) AS sr FROM customers)
SELECT customer_id, round((balance_avg - mb) / CASE WHEN sb = 0 THEN 1.0 ELSE sb END, 4) AS balance_avg,
       round((rate_sensitivity - mr) / CASE WHEN sr = 0 THEN 1.0 ELSE sr END, 4) AS rate_sensitivity
FROM customers, p""")
def m1_standard_scaling(spark, sf_dir):
    c = fx.customers(spark, sf_dir).select("customer_id", "balance_avg", "rate_sensitivity")
    cols = ["balance_avg", "rate_sensitivity"]
    return round_doubles(FE.apply_scaler(c, FE.fit_scaler(c, cols, "standard"), cols))


@register("m1_robust_scaling", C + """,
p AS (SELECT quantile_cont(loyalty_score, 0.5) AS m, quantile_cont(loyalty_score, 0.75)
             - quantile_cont(loyalty_score, 0.25) AS s FROM customers)
SELECT customer_id, round((loyalty_score - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END, 4) AS loyalty_score
FROM customers, p""")
def m1_robust_scaling(spark, sf_dir):
    c = fx.customers(spark, sf_dir).select("customer_id", "loyalty_score")
    return round_doubles(FE.apply_scaler(c, FE.fit_scaler(c, ["loyalty_score"], "robust"), ["loyalty_score"]))


_FEATS = ["FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_5Y", "TREASURY_2Y", "TREASURY_3M"]


@register("m3_select_features", M + """,
c AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, VIX)) AS score FROM market" for c in _FEATS)
    + """)
SELECT feature, round(score, 4) AS score FROM c WHERE score IS NOT NULL ORDER BY round(score, 9) DESC, feature LIMIT 50""")
def m3_select_features(spark, sf_dir):
    m = fx.market(spark, sf_dir)
    return round_doubles(FE.select_features(m, "VIX", _FEATS + ["VIX"]))


_BEHAVIOR = ["rate_sensitivity", "loyalty_score", "volatility_factor", "balance_avg"]


@register("p26_behavioral_features", fx.sql_with("customers", "flows") + """,
t AS (SELECT customer_id, SUM(deposit_flow) AS target FROM flows GROUP BY customer_id),
x AS (SELECT c.*, COALESCE(t.target, 0) AS target, """ + ", ".join(f"CASE WHEN segment = '{s}' THEN 1.0 ELSE 0.0 END AS segment_{s}" for s in SEGMENTS) + """
      FROM customers c LEFT JOIN t ON c.customer_id = t.customer_id),
i AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, target)) AS importance FROM x" for c in _BEHAVIOR + [f"segment_{s}" for s in SEGMENTS]) + """),
b AS (SELECT *, row_number() OVER (ORDER BY round(importance, 9) DESC, feature) AS rank FROM i
      WHERE importance IS NOT NULL AND NOT isnan(importance) AND regexp_matches(lower(feature), 'rate_sensitivity|loyalty|volatility|behavioral|segment'))
SELECT CAST(rank AS INTEGER) AS rank, feature, round(importance, 4) AS importance,
  CASE WHEN rank <= 5 THEN CASE WHEN feature LIKE '%rate_sensitivity%' THEN 'Rate sensitivity is a key driver of deposit behavior'
    WHEN feature LIKE '%loyalty%' THEN 'Customer loyalty significantly impacts deposit stability'
    WHEN feature LIKE '%volatility%' THEN 'Customer volatility factor affects flow predictability'
    ELSE 'Customer segment is important for behavioral prediction' END END AS insight,
  CASE WHEN rank <= 5 THEN format('{:.1f}%', CAST(round(importance, 9) * 100 AS DOUBLE)) END AS importance_text
FROM b WHERE rank <= 10""")
def p26_behavioral_features(spark, sf_dir):
    """Features of customers by the correlation with their total flow; the
    behavioural ones among them."""
    c = fx.customers(spark, sf_dir)
    t = fx.daily_flows(spark, sf_dir).groupBy("customer_id").agg(F.sum("deposit_flow").alias("target"))
    x = c.join(t, "customer_id", "left").select(
        *_BEHAVIOR, F.coalesce("target", F.lit(0.0)).alias("target"), *[F.when(F.col("segment") == s, 1.0).otherwise(0.0).alias(f"segment_{s}") for s in SEGMENTS])
    scores = FE.select_features(x, "target", x.columns).select("feature", F.col("score").alias("importance"))
    return round_doubles(RP.behavioral_features(scores))


def _rank_sql(n: int) -> str:
    """Average-rank percentile of the value within the last n rows, once
    there are n."""
    return (f"CASE WHEN COUNT(x) OVER w{n} >= {n} AND x IS NOT NULL THEN (len(list_filter(l{n}, lambda v: v < x)) + "
            f"(len(list_filter(l{n}, lambda v: v = x)) + 1) / 2.0) / len(l{n}) END")


@register("w19_rate_change_features", M + """,
b AS (SELECT date, FED_FUNDS_RATE AS x, FED_FUNDS_RATE - LAG(FED_FUNDS_RATE) OVER (ORDER BY date) AS ch FROM market),
l AS (SELECT *, list(x) FILTER (x IS NOT NULL) OVER (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS l63,
  list(x) FILTER (x IS NOT NULL) OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS l252 FROM b)
SELECT date, """ + ", ".join([
    rd("x", "FED_FUNDS_RATE"), rd("ch", "FED_FUNDS_RATE_change_1d"),
    rd("x - LAG(x, 5) OVER w", "FED_FUNDS_RATE_change_5d"), rd("x - LAG(x, 21) OVER w", "FED_FUNDS_RATE_change_21d"),
    rd("ch - LAG(ch) OVER w", "FED_FUNDS_RATE_momentum"),
    *[rd(f"CASE WHEN COUNT(ch) OVER w{n} >= {n} THEN STDDEV_SAMP(ch) OVER w{n} END", f"FED_FUNDS_RATE_volatility_{n}d")
      for n in (5, 21)],
    *[rd(_rank_sql(n), f"FED_FUNDS_RATE_percentile_{n}d") for n in (63, 252)]]) + """
FROM l WINDOW w AS (ORDER BY date), """ + ", ".join(
    f"w{n} AS (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 21, 63, 252)))
def w19_rate_change_features(spark, sf_dir):
    m = fx.market(spark, sf_dir).select("date", "FED_FUNDS_RATE")
    return round_doubles(FE.rate_change_features(m, ["FED_FUNDS_RATE"]))


_BUNDLE_RATES = ["FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_5Y", "TREASURY_2Y", "TREASURY_3M"]


def _bundle_sql() -> str:
    ch = ", ".join(f"{c} - LAG({c}) OVER (ORDER BY date) AS {c}_change" for c in _BUNDLE_RATES)
    full = lambda f, c, n: f"CASE WHEN COUNT({c}) OVER w{n} >= {n} THEN {f}({c}) OVER w{n} END"
    cols = {c: c for c in [*_BUNDLE_RATES, "VIX"]}
    for c in _BUNDLE_RATES:
        cols |= {f"{c}_change": f"{c}_change", f"{c}_volatility": full("STDDEV_SAMP", c, 20), f"{c}_ma_5": full("AVG", c, 5),
                 f"{c}_ma_20": full("AVG", c, 20), f"{c}_momentum": full("AVG", f"{c}_change", 5)}
    spread = "(TREASURY_10Y - TREASURY_2Y)"
    flags = {"VIX_regime_low": "VIX < 20", "VIX_regime_high": "VIX > 30", "rate_regime_zero": "FED_FUNDS_RATE <= 0.25",
             "rate_regime_low": "FED_FUNDS_RATE > 0.25 AND FED_FUNDS_RATE <= 2.0",
             "rate_regime_normal": "FED_FUNDS_RATE > 2.0 AND FED_FUNDS_RATE <= 5.0", "rate_regime_high": "FED_FUNDS_RATE > 5.0"}
    cols |= {"yield_spread_10y2y": spread, "yield_spread_change": f"{spread} - LAG({spread}) OVER w",
             "yield_spread_2y3m": "TREASURY_2Y - TREASURY_3M", "VIX_log": "CASE WHEN VIX > 0 THEN ln(VIX) END",
             "VIX_change": "VIX - LAG(VIX) OVER w", "VIX_pct_change": "VIX / NULLIF(LAG(VIX) OVER w, 0) - 1",
             "rate_vix_interaction": "FED_FUNDS_RATE * VIX", "year": "year(date)", "month": "month(date)",
             "quarter": "quarter(date)", "day_of_week": "isodow(date) - 1", "week_of_year": "weekofyear(date)",
             "month_sin": "sin(2 * pi() * month(date) / 12)", "month_cos": "cos(2 * pi() * month(date) / 12)"}
    cols |= {k: f"CAST(COALESCE({v}, false) AS DOUBLE)" for k, v in flags.items()}
    inner = ", ".join(f"{v} AS f_{k}" for k, v in cols.items())
    outer = ", ".join(rd(f"COALESCE(first_value(f_{k} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
                         f"last_value(f_{k} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING))", k) for k in cols)
    return M + f""",
b AS (SELECT *, {ch} FROM market),
f AS (SELECT date, {inner} FROM b WINDOW w AS (ORDER BY date), w5 AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  w20 AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT date, {outer} FROM f"""


@register("w18_market_bundle", _bundle_sql())
def w18_market_bundle(spark, sf_dir):
    d = FE.market_bundle(fx.market(spark, sf_dir).select("date", *_BUNDLE_RATES, "VIX"))
    return round_doubles(d.select("date", *[F.col(c).cast("double").alias(c) for c in d.columns if c != "date"]))


def _ema_sql(x: str, keep: str, add: str) -> str:
    """An exponential mean as a fold over the rows so far."""
    return f"list_reduce(list(CAST({x} AS DOUBLE)) FILTER ({x} IS NOT NULL) OVER p, lambda a, v: a * {keep} + v * {add})"


_SO_FAR = "p AS (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING)"


@register("w20_technical_indicators", fx.sql_with("market_gappy") + f""",
long AS (SELECT 'FED_FUNDS_RATE' AS series, date, FED_FUNDS_RATE AS value FROM market_gappy
         UNION ALL SELECT 'VIX', date, VIX FROM market_gappy),
v AS (SELECT series, date, value, row_number() OVER s AS rn, COUNT(*) OVER (PARTITION BY series) AS n,
        value - LAG(value) OVER s AS d FROM long WHERE value IS NOT NULL WINDOW s AS (PARTITION BY series ORDER BY date)),
u AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS up, CASE WHEN d < 0 THEN -d ELSE 0 END AS down FROM v),
l AS (SELECT *, {_ema_sql('up', '(13 / 14)', '(1 / 14)')} AS au, {_ema_sql('down', '(13 / 14)', '(1 / 14)')} AS ad,
        {_ema_sql('value', '(11 / 13)', '(2 / 13)')} AS fast, {_ema_sql('value', '(25 / 27)', '(2 / 27)')} AS slow
      FROM u WINDOW {_SO_FAR}),
m AS (SELECT *, CASE WHEN rn >= 26 THEN fast - slow END AS macd FROM l),
g AS (SELECT *, CASE WHEN rn >= 34 THEN {_ema_sql('macd', '0.8', '0.2')} END AS sig,
        CASE WHEN rn >= 20 THEN AVG(value) OVER w20 END AS mid, STDDEV_POP(value) OVER w20 AS sd,
        CASE WHEN rn >= 14 THEN MAX(value) OVER w14 END AS hi, MIN(value) OVER w14 AS lo
      FROM m WINDOW {_SO_FAR}, w20 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
        w14 AS (PARTITION BY series ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT long.series, long.date, """ + ", ".join(rd(f"CASE WHEN n > 50 THEN {e} END", c) for c, e in (
    ("bb_upper", "mid + 2 * sd"), ("bb_middle", "mid"), ("bb_lower", "mid - 2 * sd"), ("bb_width", "4 * sd / NULLIF(mid, 0)"),
    ("williams_r", "(g.value - hi) / NULLIF(hi - lo, 0) * 100"),
    ("rsi_14", "CASE WHEN rn >= 14 THEN CASE WHEN ad = 0 THEN 100 ELSE 100 - 100 / (1 + au / ad) END END"),
    ("macd", "macd"), ("macd_signal", "sig"), ("macd_histogram", "macd - sig"))) + """
FROM long LEFT JOIN g ON long.series = g.series AND long.date = g.date""")
def w20_technical_indicators(spark, sf_dir):
    m = fx.market_gappy(spark, sf_dir).select("date", "FED_FUNDS_RATE", "VIX")
    return round_doubles(FE.technical_indicators(m, ["FED_FUNDS_RATE", "VIX"]))


@register("w21_target_variables", fx.sql_with("flows") + """,
g AS (SELECT date, segment, round_even(SUM(deposit_flow), 4) AS x, round_even(AVG(deposit_flow), 4) AS m,
        round_even(STDDEV_SAMP(deposit_flow), 4) AS sd, round_even(SUM(inflow), 4) AS i, round_even(SUM(outflow), 4) AS o
      FROM flows GROUP BY date, segment),
d AS (SELECT date, segment, x, sd / (abs(m) + 1) AS vol, x / (i + abs(o) + 1) AS nfr FROM g),
sd AS (SELECT STDDEV_SAMP(x) AS s FROM d)
SELECT date, segment, round(x, 4) AS segment_sum_deposit_flow, """ + ", ".join(
    f"round(LEAD(x, {h}) OVER w, 4) AS target_flow_{h}d, round(LEAD(vol, {h}) OVER w, 4) AS target_flow_volatility_{h}d, "
    f"round(LEAD(nfr, {h}) OVER w, 4) AS target_net_flow_rate_{h}d, "
    f"COALESCE(CAST(LEAD(x, {h}) OVER w < -2 * s AS INTEGER), 0) AS target_large_outflow_{h}d, "
    f"COALESCE(CAST(LEAD(x, {h}) OVER w > 2 * s AS INTEGER), 0) AS target_large_inflow_{h}d"
    for h in (1, 5, 21)) + """
FROM d, sd WINDOW w AS (PARTITION BY segment ORDER BY date)""")
def w21_target_variables(spark, sf_dir):
    d = segment_behavioral_features(fx.flows(spark, sf_dir), windows=())
    d = d.select("date", "segment", "segment_sum_deposit_flow", "segment_flow_volatility", "segment_net_flow_rate")
    return round_doubles(FE.target_variables(d).drop("segment_flow_volatility", "segment_net_flow_rate"))


def _flow_bundle_sql() -> str:
    w = {n: f"(PARTITION BY customer_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10, 21, 63)}
    f = "deposit_flow"
    cols = {"is_month_end": "CAST(last_day(date) = date AS INTEGER)",
            "is_quarter_end": "CAST(CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) = date AS INTEGER)",
            "is_year_end": "CAST(month(date) = 12 AND day(date) = 31 AS INTEGER)", "is_weekend": "CAST(isodow(date) >= 6 AS INTEGER)",
            "year": "year(date)", "month": "month(date)", "day": "day(date)", "day_of_week": "isodow(date) - 1",
            "week_of_year": "weekofyear(date)", "quarter": "quarter(date)", "is_inflow": f"CAST({f} > 0 AS INTEGER)",
            "is_outflow": f"CAST({f} < 0 AS INTEGER)", "flow_magnitude": f"abs({f})", "flow_magnitude_log": f"ln(1 + abs({f}))",
            "mean_customer": f"AVG({f}) OVER c", "std_customer": f"STDDEV_SAMP({f}) OVER c", "min_customer": f"MIN({f}) OVER c",
            "max_customer": f"MAX({f}) OVER c", "count_customer": f"COUNT({f}) OVER c", "flow_vs_customer_mean": f"{f} - AVG({f}) OVER c",
            "flow_zscore": f"({f} - AVG({f}) OVER c) / (STDDEV_SAMP({f}) OVER c + 1e-8)"}
    cols |= {f"deposit_flow_lag_{k}": f"LAG({f}, {k}) OVER o" for k in (1, 5, 10, 21)}
    for b in ("balance_start", "balance_end"):
        cols |= {f"{b}_log": f"CASE WHEN {b} > -1 THEN ln(1 + {b}) END", f"{b}_change": f"{b} - LAG({b}) OVER o",
                 f"{b}_pct_change": f"{b} / NULLIF(LAG({b}) OVER o, 0) - 1"}
    for n in (5, 10, 21):
        cols |= {f"deposit_flow_ma_{n}": f"AVG({f}) OVER {w[n]}", f"deposit_flow_std_{n}": f"STDDEV_SAMP({f}) OVER {w[n]}"}
    for n in (10, 21, 63):
        cols[f"flow_volatility_{n}d"] = f"CASE WHEN COUNT({f}) OVER {w[n]} >= 5 THEN STDDEV_SAMP({f}) OVER {w[n]} END"
    own = ["deposit_flow", "inflow", "outflow", "balance_start", "balance_end"]
    filled = ", ".join(rd(f"CAST(COALESCE(last_value(f_{k} IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY b.date ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE)", k)
                       for k in cols)
    return fx.sql_with("flows") + f""",
b AS (SELECT customer_id, date, segment, {', '.join(own)}, {', '.join(f'{v} AS f_{k}' for k, v in cols.items())} FROM flows
  WINDOW c AS (PARTITION BY customer_id), o AS (PARTITION BY customer_id ORDER BY date)),
s AS (SELECT date, segment, SUM({f}) AS x, AVG({f}) AS m, COUNT({f}) AS n FROM flows GROUP BY date, segment)
SELECT customer_id, b.date, b.segment, {', '.join(rd(c, c) for c in own)}, {filled}, {rd('COALESCE(s.x, 0)', 'segment_sum_deposit_flow')},
  {rd('COALESCE(s.m, 0)', 'segment_mean_deposit_flow')}, CAST(COALESCE(s.n, 0) AS DOUBLE) AS segment_count_deposit_flow
FROM b LEFT JOIN s ON b.date = s.date AND b.segment = s.segment"""


@register("w23_transform_flows", _flow_bundle_sql())
def w23_transform_flows(spark, sf_dir):
    d = FE.transform_flows(fx.flows(spark, sf_dir))
    keep = ("customer_id", "date", "segment")
    return round_doubles(d.select(*keep, *[F.col(c).cast("double").alias(c) for c in d.columns if c not in keep]))


TWO_PI = repr(2 * math.pi)


@register("c1_calendar_features", M + f"""
SELECT date, year(date) AS year, month(date) AS month, day(date) AS day, isodow(date) - 1 AS dayofweek,
  dayofyear(date) AS dayofyear, weekofyear(date) AS week, quarter(date) AS quarter,
  round(sin({TWO_PI} * month(date) / 12), 4) AS month_sin, round(cos({TWO_PI} * month(date) / 12), 4) AS month_cos,
  round(sin({TWO_PI} * (isodow(date) - 1) / 7), 4) AS dayofweek_sin,
  round(cos({TWO_PI} * (isodow(date) - 1) / 7), 4) AS dayofweek_cos,
  round(sin({TWO_PI} * dayofyear(date) / 365), 4) AS dayofyear_sin,
  round(cos({TWO_PI} * dayofyear(date) / 365), 4) AS dayofyear_cos,
  CAST(isodow(date) - 1 < 5 AS INTEGER) AS is_weekday, CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend,
  CAST(day(date) <= 3 AS INTEGER) AS is_month_start, CAST(day(date) >= 28 AS INTEGER) AS is_month_end,
  CAST(month(date) IN (1, 4, 7, 10) AND day(date) <= 3 AS INTEGER) AS is_quarter_start,
  CAST(month(date) IN (3, 6, 9, 12) AND day(date) >= 28 AS INTEGER) AS is_quarter_end,
  CAST(month(date) = 1 AND day(date) <= 3 AS INTEGER) AS is_year_start,
  CAST(month(date) = 12 AND day(date) >= 28 AS INTEGER) AS is_year_end,
  CAST(month(date) = 1 AS INTEGER) AS is_january, CAST(month(date) = 12 AS INTEGER) AS is_december,
  CAST(month(date) IN (3, 4) AS INTEGER) AS is_tax_season
FROM market""")
def c1_calendar_features(spark, sf_dir):
    return round_doubles(CAL.calendar_features(fx.market(spark, sf_dir).select("date")))


@register("c3_flow_date_flags", fx.sql_with("flows") + """
SELECT customer_id, date, CAST(last_day(date) = date AS INTEGER) AS is_month_end,
  CAST(CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) = date AS INTEGER) AS is_quarter_end,
  CAST(month(date) = 12 AND day(date) = 31 AS INTEGER) AS is_year_end,
  CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend, month(date) AS MONTH, quarter(date) AS QUARTER,
  isodow(date) - 1 AS DAY_OF_WEEK, weekofyear(date) AS WEEK_OF_YEAR
FROM flows""")
def c3_flow_date_flags(spark, sf_dir):
    return CAL.flow_date_flags(fx.flows(spark, sf_dir).select("customer_id", "date"))


@register("c4_account_age", C + f"""
SELECT customer_id, datediff('day', account_opening_date, DATE '{AS_OF}') AS account_age_days,
  round(datediff('day', account_opening_date, DATE '{AS_OF}') / 365.25, 4) AS account_age_years,
  CAST(datediff('day', account_opening_date, DATE '{AS_OF}') / 365.25 < 1 AS INTEGER) AS is_new_account,
  CAST(datediff('day', account_opening_date, DATE '{AS_OF}') / 365.25 > 5 AS INTEGER) AS is_mature_account
FROM customers""")
def c4_account_age(spark, sf_dir):
    c = fx.customers(spark, sf_dir).select("customer_id", "account_opening_date")
    return round_doubles(CAL.account_age(c, "account_opening_date", AS_OF).drop("account_opening_date"))
