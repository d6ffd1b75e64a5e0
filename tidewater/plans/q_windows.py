"""Registered queries: window operators (W1-W15, W22) on the fixtures.

Market-based queries use unpartitioned windows over one row per day (a
calendar-bounded table); flow-based ones partition by customer or segment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import flows as A
from ..operators import windows as W
from .global_order import rank_pct
from .registry import register

RATE, VIX = "FED_FUNDS_RATE", "VIX"


def rd(expr: str, name: str) -> str:
    return f"round({expr}, 4) AS {name}"


def _market2(spark, sf_dir):
    return fx.market(spark, sf_dir).select("date", RATE, VIX)


# ---------------------------------------------------------------------- W1
@register("w1_market_lag_diff_pct", fx.sql_with("market") + """
SELECT date, """ + ", ".join(
    [rd(RATE, RATE), rd(VIX, VIX)]
    + [rd(f"LAG({c}, {n}) OVER w", f"{c}_lag_{n}") for c in (RATE, VIX) for n in (1, 5, 21)]
    + [rd(f"{c} - LAG({c}, {n}) OVER w", f"{c}_diff_{n}") for c in (RATE, VIX) for n in (1, 5, 21)]
    + [rd(f"{c} / NULLIF(LAG({c}, {n}) OVER w, 0) - 1", f"{c}_pct_change_{n}") for c in (RATE, VIX)
       for n in (1, 12)]
    + [rd(f"LEAD({RATE}, {n}) OVER w", f"{RATE}_lead_{n}") for n in (1, 5)]) + """
FROM market WINDOW w AS (ORDER BY date)""")
def w1_market_lag_diff_pct(spark, sf_dir):
    m = _market2(spark, sf_dir)
    d = W.lag_features(m, [RATE, VIX], [1, 5, 21], ["date"])
    d = W.diff_features(d, [RATE, VIX], [1, 5, 21], ["date"])
    d = W.pct_change_features(d, [RATE, VIX], [1, 12], ["date"])
    d = W.lead_features(d, [RATE], [1, 5], ["date"])
    return round_doubles(d)


@register("w1_customer_flow_lags", fx.sql_with("flows") + """
SELECT customer_id, date, round(deposit_flow, 4) AS deposit_flow, """ + ", ".join(
    [rd(f"LAG(deposit_flow, {n}) OVER w", f"deposit_flow_lag_{n}") for n in (1, 5, 10, 21)]
    + [rd(f"balance_end - LAG(balance_end, {n}) OVER w", f"balance_end_diff_{n}") for n in (1, 5)]) + """
FROM flows WINDOW w AS (PARTITION BY customer_id ORDER BY date)""")
def w1_customer_flow_lags(spark, sf_dir):
    f = fx.flows(spark, sf_dir).select("customer_id", "date", "deposit_flow", "balance_end")
    d = W.lag_features(f, ["deposit_flow"], [1, 5, 10, 21], ["date"], ["customer_id"])
    d = W.diff_features(d, ["balance_end"], [1, 5], ["date"], ["customer_id"])
    return round_doubles(d.drop("balance_end"))


# ---------------------------------------------------------------------- W2
_STAT_SQL = {"ma": "AVG({c})", "std": "STDDEV_SAMP({c})", "min": "MIN({c})", "max": "MAX({c})",
             "q25": "quantile_cont({c}, 0.25)", "q75": "quantile_cont({c}, 0.75)"}


def _rolling_sql(c: str, n: int, part: str = "") -> list[str]:
    w = f"({part} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return [rd(f"CASE WHEN COUNT({c}) OVER {w} >= {n} THEN {e.format(c=c)} OVER {w} END", f"{c}_{s}_{n}")
            for s, e in _STAT_SQL.items()]


@register("w2_market_rolling", fx.sql_with("market") + """
SELECT date, """ + ", ".join([rd(RATE, RATE), rd(VIX, VIX)] + _rolling_sql(RATE, 5) + _rolling_sql(RATE, 21)
                            + _rolling_sql(VIX, 20)) + """
FROM market""")
def w2_market_rolling(spark, sf_dir):
    m = _market2(spark, sf_dir)
    d = W.rolling_features(m, [RATE], [5, 21], ["date"])
    d = W.rolling_features(d, [VIX], [20], ["date"])
    return round_doubles(d)


@register("w2_segment_rolling_min_periods", fx.sql_with("flows") + """,
d AS (SELECT date, segment, SUM(deposit_flow) AS deposit_flow FROM flows GROUP BY date, segment)
SELECT date, segment, round(deposit_flow, 4) AS deposit_flow, """ + ", ".join(
    rd(f"CASE WHEN COUNT(deposit_flow) OVER w{n} >= 1 THEN {e} OVER w{n} END", f"deposit_flow_{s}_{n}")
    for n in (7, 21) for s, e in (("ma", "AVG(deposit_flow)"), ("std", "STDDEV_SAMP(deposit_flow)"))) + """
FROM d WINDOW w7 AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
              w21 AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def w2_segment_rolling_min_periods(spark, sf_dir):
    d = fx.flows(spark, sf_dir).groupBy("date", "segment").agg(F.sum("deposit_flow").alias("deposit_flow"))
    return round_doubles(W.rolling_features(d, ["deposit_flow"], [7, 21], ["date"], ["segment"],
                                            stats=("ma", "std"), min_periods=1))


# ---------------------------------------------------------------------- W3
def _pct_rank_sql(windows: list[int]) -> str:
    """Average-rank percentile of the value within its last n rows, for each n."""
    parts = ",".join(f"""
p{n} AS (SELECT a.date, CASE WHEN COUNT(b.x) >= {n} AND a.x IS NOT NULL THEN
  round((SUM(CASE WHEN b.x < a.x THEN 1 ELSE 0 END) + (SUM(CASE WHEN b.x = a.x THEN 1 ELSE 0 END) + 1) / 2.0) / COUNT(b.x), 4) END AS v
  FROM m a JOIN m b ON b.rn BETWEEN a.rn - {n - 1} AND a.rn GROUP BY a.date, a.x)""" for n in windows)
    return (fx.sql_with("market") + f",\nm AS (SELECT date, {RATE} AS x, row_number() OVER (ORDER BY date) AS rn FROM market)," + parts
            + f"\nSELECT m.date, round(x, 4) AS {RATE}, " + ", ".join(f"p{n}.v AS {RATE}_percentile_{n}d" for n in windows)
            + " FROM m " + " ".join(f"JOIN p{n} ON p{n}.date = m.date" for n in windows))


@register("w3_rolling_percentile_rank", _pct_rank_sql([63, 252]))
def w3_rolling_percentile_rank(spark, sf_dir):
    m = fx.market(spark, sf_dir).select("date", RATE)
    return round_doubles(W.rolling_percentile_rank(m, [RATE], [63, 252], ["date"]))


# ---------------------------------------------------------------------- W4
@register("w4_rolling_slope", fx.sql_with("market") + f""",
m AS (SELECT date, {RATE}, {VIX}, CAST(row_number() OVER (ORDER BY date) AS DOUBLE) AS rn FROM market)
SELECT date, {rd(RATE, RATE)}, {rd(VIX, VIX)},
  {rd(f"CASE WHEN COUNT({RATE}) OVER w21 >= 21 THEN regr_slope({RATE}, rn) OVER w21 END", RATE + "_slope_21")},
  {rd(f"CASE WHEN COUNT({VIX}) OVER w6 >= 6 THEN regr_slope({VIX}, rn) OVER w6 END", VIX + "_slope_6")}
FROM m WINDOW w21 AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
              w6 AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def w4_rolling_slope(spark, sf_dir):
    m = _market2(spark, sf_dir)
    d = W.rolling_slope(m, [RATE], [21], ["date"])
    d = W.rolling_slope(d, [VIX], [6], ["date"])
    return round_doubles(d)


# ---------------------------------------------------------------------- W5
@register("w5_rolling_corr", fx.sql_with("market") + f"""
SELECT date, {rd(RATE, RATE)}, {rd(VIX, VIX)},
  {rd(f"CASE WHEN COUNT(CASE WHEN {RATE} IS NOT NULL AND {VIX} IS NOT NULL THEN 1 END) OVER w >= 30 "
      f"THEN corr({RATE}, {VIX}) OVER w END", f"{RATE}_{VIX}_corr_30")}
FROM market WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def w5_rolling_corr(spark, sf_dir):
    return round_doubles(W.rolling_corr(_market2(spark, sf_dir), RATE, VIX, 30, ["date"]))


# ------------------------------------------------------------------- W6-W8
@register("w6_w8_fill_interpolate", fx.sql_with("market_gappy") + f""",
g AS (SELECT date, {RATE} AS x, {VIX} AS v, CAST(row_number() OVER (ORDER BY date) AS DOUBLE) AS rn
      FROM market_gappy),
h AS (SELECT *,
        last_value(x IGNORE NULLS) OVER past AS xp,
        last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER past AS xpp,
        first_value(x IGNORE NULLS) OVER fut AS xn,
        first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER fut AS xnp,
        last_value(v IGNORE NULLS) OVER past AS vp,
        last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER past AS vpp,
        first_value(v IGNORE NULLS) OVER fut AS vn,
        first_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER fut AS vnp
      FROM g WINDOW past AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    fut AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT date, round(x, 4) AS {RATE}, round(v, 4) AS {VIX},
  round(xp, 4) AS {RATE}_ffill, round(vn, 4) AS {VIX}_bfill,
  round(COALESCE(xp, xn), 4) AS {RATE}_ffill_bfill,
  round(CASE WHEN x IS NOT NULL THEN x WHEN xp IS NOT NULL AND xn IS NOT NULL
             THEN xp + (xn - xp) * (rn - xpp) / (xnp - xpp) ELSE xp END, 4) AS {RATE}_interp,
  round(CASE WHEN v IS NOT NULL THEN v WHEN vp IS NOT NULL AND vn IS NOT NULL
             THEN vp + (vn - vp) * (rn - vpp) / (vnp - vpp) ELSE vp END, 4) AS {VIX}_interp
FROM h""")
def w6_w8_fill_interpolate(spark, sf_dir):
    g = fx.market_gappy(spark, sf_dir).select("date", RATE, VIX)
    o = ["date"]
    d = g.select("date", RATE, VIX,
                 W.ffill_expr(F.col(RATE), o).alias(f"{RATE}_ffill"),
                 W.bfill_expr(F.col(VIX), o).alias(f"{VIX}_bfill"),
                 F.col(RATE).alias(f"{RATE}_ffill_bfill"),
                 F.col(RATE).alias(f"{RATE}_interp"), F.col(VIX).alias(f"{VIX}_interp"))
    d = W.forward_then_backward_fill(d, [f"{RATE}_ffill_bfill"], o)
    d = W.interpolate_linear(d, [f"{RATE}_interp", f"{VIX}_interp"], o)
    return round_doubles(d)


# ---------------------------------------------------------------------- W9
@register("w9_balance_rank_pct", fx.sql_with("customers") + """
SELECT customer_id, round(balance_avg, 4) AS balance_avg,
       round((rank() OVER (ORDER BY balance_avg) + (COUNT(*) OVER (PARTITION BY balance_avg) - 1) / 2.0)
             / COUNT(*) OVER (), 4) AS balance_avg_rank_pct
FROM customers""")
def w9_balance_rank_pct(spark, sf_dir):
    c = fx.customers(spark, sf_dir).select("customer_id", "balance_avg")
    return round_doubles(rank_pct(c, "balance_avg"))


# --------------------------------------------------------------------- W10
@register("w10_segment_cumulative_flow", fx.sql_with("flows") + """,
d AS (SELECT date, segment, SUM(deposit_flow) AS deposit_flow FROM flows GROUP BY date, segment)
SELECT date, segment, round(deposit_flow, 4) AS deposit_flow,
  round(SUM(deposit_flow) OVER (PARTITION BY segment ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW), 4) AS deposit_flow_cumsum,
  round(SUM(deposit_flow) OVER (PARTITION BY segment ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW) / NULLIF(SUM(deposit_flow) OVER (PARTITION BY segment), 0), 4) AS deposit_flow_cumshare
FROM d""")
def w10_segment_cumulative_flow(spark, sf_dir):
    d = fx.flows(spark, sf_dir).groupBy("date", "segment").agg(F.sum("deposit_flow").alias("deposit_flow"))
    return round_doubles(W.cumulative_sum(d, "deposit_flow", ["date"], ["segment"], share=True))


# --------------------------------------------------------------------- W11
@register("w11_longest_equal_run", fx.sql_with("market") + """,
m AS (SELECT date, round(VIX) AS v, round(FED_FUNDS_RATE, 1) AS r FROM market),
c AS (SELECT date, v, r,
        CASE WHEN v = LAG(v) OVER (ORDER BY date) THEN 0 ELSE 1 END AS cv,
        CASE WHEN r = LAG(r) OVER (ORDER BY date) THEN 0 ELSE 1 END AS cr FROM m),
g AS (SELECT SUM(cv) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS gv,
             SUM(cr) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS gr FROM c)
SELECT 'vix_level' AS "column", MAX(n) AS max_run FROM (SELECT gv, COUNT(*) AS n FROM g GROUP BY gv)
UNION ALL
SELECT 'rate_level' AS "column", MAX(n) AS max_run FROM (SELECT gr, COUNT(*) AS n FROM g GROUP BY gr)""")
def w11_longest_equal_run(spark, sf_dir):
    m = fx.market(spark, sf_dir).select("date", F.round("VIX").alias("vix_level"),
                                         F.round("FED_FUNDS_RATE", 1).alias("rate_level"))
    return W.longest_equal_run(m, ["vix_level", "rate_level"], ["date"])


# --------------------------------------------------------------------- W12
@register("w12_dedupe_keep_last", fx.sql_with("flows") + """
SELECT customer_id, date, round(balance_end, 4) AS balance_end FROM (
  SELECT customer_id, date, balance_end,
         row_number() OVER (PARTITION BY customer_id ORDER BY date DESC) AS rn FROM flows) WHERE rn = 1""")
def w12_dedupe_keep_last(spark, sf_dir):
    f = fx.flows(spark, sf_dir).select("customer_id", "date", "balance_end")
    return round_doubles(W.dedupe(f, ["customer_id"], ["date"], keep="last"))


# --------------------------------------------------------------------- W13
@register("w13_flows_from_balances", fx.sql_with("flows") + """,
b AS (SELECT customer_id, date, segment, balance_end AS balance,
             LAG(balance_end) OVER (PARTITION BY customer_id ORDER BY date) AS prev FROM flows)
SELECT customer_id, date, segment, round(balance - prev, 4) AS deposit_flow,
       round(greatest(balance - prev, 0.0), 4) AS inflow, round(least(balance - prev, 0.0), 4) AS outflow,
       round(prev, 4) AS balance_start, round(balance, 4) AS balance_end
FROM b WHERE prev IS NOT NULL""")
def w13_flows_from_balances(spark, sf_dir):
    bal = fx.flows(spark, sf_dir).select("customer_id", "date", "segment",
                                         F.col("balance_end").alias("balance"))
    return round_doubles(W.flows_from_balances(bal))


# --------------------------------------------------------------------- W14
@register("w14_segment_autocorr", fx.sql_with("flows") + """,
d AS (SELECT segment, date, SUM(deposit_flow) AS x FROM flows GROUP BY segment, date),
l AS (SELECT segment, x, LAG(x) OVER (PARTITION BY segment ORDER BY date) AS xl FROM d)
SELECT segment, round(COALESCE(CASE WHEN COUNT(*) > 10 THEN corr(x, xl) END, 0.0), 4) AS autocorr_lag1
FROM l GROUP BY segment""")
def w14_segment_autocorr(spark, sf_dir):
    d = fx.flows(spark, sf_dir).groupBy("segment", "date").agg(F.sum("deposit_flow").alias("x"))
    return round_doubles(W.lag1_autocorr(d, "x", ["date"], ["segment"], min_rows=10))


# --------------------------------------------------------------------- W15
@register("w15_centred_decomposition", fx.sql_with("market") + """,
t AS (SELECT date, VIX, CASE WHEN COUNT(VIX) OVER w30 >= 30 THEN AVG(VIX) OVER w30 END AS trend
      FROM market WINDOW w30 AS (ORDER BY date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)),
s AS (SELECT *, VIX - trend AS detr FROM t),
u AS (SELECT *, CASE WHEN COUNT(detr) OVER w7 >= 7 THEN AVG(detr) OVER w7 END AS seas
      FROM s WINDOW w7 AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT date, round(VIX, 4) AS VIX, round(trend, 4) AS VIX_trend, round(detr, 4) AS VIX_detrended,
       round(seas, 4) AS VIX_seasonal, round(detr - seas, 4) AS VIX_residual FROM u""")
def w15_centred_decomposition(spark, sf_dir):
    m = fx.market(spark, sf_dir).select("date", VIX)
    return round_doubles(W.centred_decomposition(m, VIX, ["date"]))


# --------------------------------------------------------------------- W22
def _sequence_sql(n: int) -> str:
    return fx.sql_with("flows") + f""",
d AS (SELECT segment, date, SUM(deposit_flow) AS x, SUM(inflow) AS i FROM flows GROUP BY segment, date),
s AS (SELECT segment, date, x AS target,
        list([round(x, 4), round(i, 4)]) OVER (PARTITION BY segment ORDER BY date
             ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS sequence FROM d)
SELECT segment, date, sequence, round(target, 4) AS target FROM s WHERE len(sequence) = {n}"""


def _sequences(spark, sf_dir, n):
    d = fx.flows(spark, sf_dir).groupBy("segment", "date").agg(
        F.round(F.sum("deposit_flow"), 4).alias("x"), F.round(F.sum("inflow"), 4).alias("i"))
    return round_doubles(W.lookback_sequences(d, ["x", "i"], n, "x", ["date"], ["segment"]))


@register("w22_lookback_sequences", _sequence_sql(30))
def w22_lookback_sequences(spark, sf_dir):
    return _sequences(spark, sf_dir, 30)


@register("w22_short_lookback_sequences", _sequence_sql(5))
def w22_short_lookback_sequences(spark, sf_dir):
    """As above with five rows, for tables with few days."""
    return _sequences(spark, sf_dir, 5)


# ---------------------------------------------------------------------- A2
@register("a2_segment_behavioral_features", fx.sql_with("flows") + """,
g AS (SELECT date, segment,
        round_even(SUM(deposit_flow), 4) AS s, round_even(AVG(deposit_flow), 4) AS m,
        round_even(STDDEV_SAMP(deposit_flow), 4) AS sd, COUNT(deposit_flow) AS n,
        round_even(SUM(inflow), 4) AS i, round_even(SUM(outflow), 4) AS o
      FROM flows GROUP BY date, segment),
h AS (SELECT *, s / (i + abs(o) + 1) AS nfr, i / (abs(o) + 1) AS ior, sd / (abs(m) + 1) AS vol FROM g)
SELECT date, segment, round(s, 4) AS segment_sum_deposit_flow, round(m, 4) AS segment_mean_deposit_flow,
  round(sd, 4) AS segment_std_deposit_flow, n AS segment_count_deposit_flow,
  round(i, 4) AS segment_sum_inflow, round(o, 4) AS segment_sum_outflow,
  round(nfr, 4) AS segment_net_flow_rate, round(ior, 4) AS segment_inflow_outflow_ratio,
  round(vol, 4) AS segment_flow_volatility, """ + ", ".join(
    rd(f"AVG({c}) OVER w{n}", f"{name}_ma_{n}") + ", " + rd(f"STDDEV_SAMP({c}) OVER w{n}", f"{name}_std_{n}")
    for name, c in (("segment_sum_deposit_flow", "s"), ("segment_net_flow_rate", "nfr"),
                    ("segment_flow_volatility", "vol"))
    for n in (7, 21, 63)) + """
FROM h WINDOW w7 AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
              w21 AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
              w63 AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def a2_segment_behavioral_features(spark, sf_dir):
    return round_doubles(A.segment_behavioral_features(fx.flows(spark, sf_dir)))
