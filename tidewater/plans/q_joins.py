"""Registered queries: joins (J1-J10) and simple aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import flows as A
from ..operators import joins as J
from ..schemas import SEGMENTS
from .registry import register


def rd(expr: str, name: str) -> str:
    return f"round({expr}, 4) AS {name}"


MKT = ["FED_FUNDS_RATE", "TREASURY_10Y", "TREASURY_5Y", "TREASURY_2Y", "TREASURY_3M", "VIX"]


# ---------------------------------------------------------------------- J1
@register("j1_merge_datasets", fx.sql_with("market", "flows") + """,
d AS (SELECT date, SUM(deposit_flow) AS total_flow, COUNT(deposit_flow) AS n_flows,
             SUM(inflow) AS total_inflow, SUM(outflow) AS total_outflow FROM flows GROUP BY date),
s AS (SELECT date, segment, SUM(deposit_flow) AS total_flow FROM flows GROUP BY date, segment)
SELECT m.date, """ + ", ".join(rd(f"m.{c}", c) for c in ("FED_FUNDS_RATE", "VIX")) + """,
       round(d.total_flow, 4) AS total_flow, d.n_flows, round(d.total_inflow, 4) AS total_inflow,
       round(d.total_outflow, 4) AS total_outflow, round(s.total_flow, 4) AS total_flow_segments, s.segment
FROM market m JOIN d ON m.date = d.date JOIN s ON m.date = s.date""")
def j1_merge_datasets(spark, sf_dir):
    m = fx.market(spark, sf_dir).select("date", "FED_FUNDS_RATE", "VIX")
    f = fx.flows(spark, sf_dir)
    d = A.daily_totals(f)
    s = f.groupBy("date", "segment").agg(F.sum("deposit_flow").alias("total_flow"))
    return round_doubles(J.merge_datasets({"market": m, "flows": d, "segments": s}, "date", "inner"))


# ---------------------------------------------------------------------- J2
@register("j2_assemble_market_sources", fx.sql_with("market") + """,
rates AS (SELECT date, FED_FUNDS_RATE, TREASURY_10Y FROM market),
vol AS (SELECT date, VIX, TREASURY_10Y FROM market),
dates AS (SELECT date FROM rates UNION SELECT date FROM vol),
j AS (SELECT d.date, r.FED_FUNDS_RATE, COALESCE(r.TREASURY_10Y, v.TREASURY_10Y) AS TREASURY_10Y, v.VIX
      FROM dates d LEFT JOIN rates r ON d.date = r.date LEFT JOIN vol v ON d.date = v.date)
SELECT date,
  round(last_value(FED_FUNDS_RATE IGNORE NULLS) OVER w, 4) AS FED_FUNDS_RATE,
  round(last_value(TREASURY_10Y IGNORE NULLS) OVER w, 4) AS TREASURY_10Y,
  round(last_value(VIX IGNORE NULLS) OVER w, 4) AS VIX
FROM j WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def j2_assemble_market_sources(spark, sf_dir):
    m = fx.market(spark, sf_dir)
    rates = m.select("date", "FED_FUNDS_RATE", "TREASURY_10Y")
    vol = m.select("date", "VIX", "TREASURY_10Y")
    return round_doubles(J.assemble_on_date([rates, vol], "date", fill="ffill"))


# ---------------------------------------------------------------------- J4
def _unified_sql(rounded: bool = True) -> str:
    piv = ",\n".join(
        f"COALESCE({agg}(CASE WHEN segment = '{s}' THEN {col} END), 0.0) AS {m}_{s}"
        for m, agg, col in (("deposit_flow_mean", "AVG", "deposit_flow"), ("deposit_flow_sum", "SUM", "deposit_flow"),
                            ("inflow_sum", "SUM", "inflow"), ("outflow_sum", "SUM", "outflow"))
        for s in SEGMENTS)
    cols = MKT + [f"{m}_{s}" for m in J.UNIFIED_METRICS for s in SEGMENTS]
    fill = ",\n".join((f"round(last_value({c} IGNORE NULLS) OVER w, 4) AS {c}" if rounded else
                       f"last_value({c} IGNORE NULLS) OVER w AS {c}") for c in cols)
    return fx.sql_with("market", "flows") + f""",
p AS (SELECT date, {piv} FROM flows GROUP BY date),
u AS (SELECT COALESCE(m.date, p.date) AS date, {", ".join("m." + c for c in MKT)},
             {", ".join("p." + c for c in cols[len(MKT):])}
      FROM market m FULL OUTER JOIN p ON m.date = p.date)
SELECT date, {fill}
FROM u WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("j4_unified_timeseries", _unified_sql())
def j4_unified_timeseries(spark, sf_dir):
    return round_doubles(J.unified_timeseries(fx.market(spark, sf_dir), fx.flows(spark, sf_dir)))


# ---------------------------------------------------------------------- J5
@register("j5_segment_features_with_market", fx.sql_with("market", "flows") + """,
d AS (SELECT date, segment, SUM(deposit_flow) AS deposit_flow, COUNT(*) AS n FROM flows GROUP BY date, segment)
SELECT d.date, d.segment, round(d.deposit_flow, 4) AS deposit_flow, d.n,
       round(m.FED_FUNDS_RATE, 4) AS FED_FUNDS_RATE, round(m.VIX, 4) AS VIX
FROM d LEFT JOIN market m ON d.date = m.date""")
def j5_segment_features_with_market(spark, sf_dir):
    d = fx.flows(spark, sf_dir).groupBy("date", "segment").agg(
        F.sum("deposit_flow").alias("deposit_flow"), F.count(F.lit(1)).alias("n"))
    m = fx.market(spark, sf_dir).select("date", "FED_FUNDS_RATE", "VIX")
    return round_doubles(J.segment_features_with_market(d, m))


# ---------------------------------------------------------------------- J6
@register("j6_asof_market_conditions", fx.sql_with("market", "flows") + """,
m AS (SELECT date, FED_FUNDS_RATE, TREASURY_10Y, VIX, TREASURY_10Y - TREASURY_2Y AS YIELD_SPREAD_10Y2Y,
             FED_FUNDS_RATE - LAG(FED_FUNDS_RATE) OVER (ORDER BY date) AS FED_FUNDS_RATE_CHANGE
      FROM market),
e AS (SELECT * FROM m ORDER BY date LIMIT 1),
j AS (SELECT f.customer_id, f.date, f.deposit_flow, m.date AS mdate, m.FED_FUNDS_RATE, m.TREASURY_10Y, m.VIX,
             m.YIELD_SPREAD_10Y2Y, m.FED_FUNDS_RATE_CHANGE
      FROM flows f ASOF LEFT JOIN m ON f.date >= m.date)
SELECT j.customer_id, j.date, round(j.deposit_flow, 4) AS deposit_flow,
  round(CASE WHEN j.mdate IS NULL THEN e.FED_FUNDS_RATE ELSE j.FED_FUNDS_RATE END, 4) AS fed_funds_rate,
  round(CASE WHEN j.mdate IS NULL THEN e.TREASURY_10Y ELSE j.TREASURY_10Y END, 4) AS treasury_10y,
  round(CASE WHEN j.mdate IS NULL THEN e.VIX ELSE j.VIX END, 4) AS vix,
  round(CASE WHEN j.mdate IS NULL THEN e.YIELD_SPREAD_10Y2Y ELSE j.YIELD_SPREAD_10Y2Y END, 4) AS yield_spread,
  round(CASE WHEN j.mdate IS NULL THEN e.FED_FUNDS_RATE_CHANGE ELSE j.FED_FUNDS_RATE_CHANGE END, 4) AS rate_change
FROM j, e""")
def j6_asof_market_conditions(spark, sf_dir):
    from ..operators import windows as W
    m = fx.market(spark, sf_dir)
    m = m.select("date", "FED_FUNDS_RATE", "TREASURY_10Y", "VIX",
                 (F.col("TREASURY_10Y") - F.col("TREASURY_2Y")).alias("YIELD_SPREAD_10Y2Y"),
                 (F.col("FED_FUNDS_RATE") - F.lag("FED_FUNDS_RATE").over(W.spec(["date"])))
                 .alias("FED_FUNDS_RATE_CHANGE"))
    f = fx.flows(spark, sf_dir).select("customer_id", "date", "deposit_flow")
    return round_doubles(J.asof_join_market(f, m))


@register("j6_asof_entity_balances", fx.sql_with("flows") + """,
b AS (SELECT customer_id, date AS ts, balance_end FROM flows),
q AS (SELECT customer_id, date AS ts, deposit_flow FROM flows)
SELECT q.customer_id, q.ts, round(q.deposit_flow, 4) AS deposit_flow, round(b.balance_end, 4) AS balance_end
FROM q ASOF LEFT JOIN b ON q.customer_id = b.customer_id AND q.ts >= b.ts""")
def j6_asof_entity_balances(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    right = f.select("customer_id", F.col("date").alias("ts"), "balance_end")
    left = f.select("customer_id", F.col("date").alias("ts"), "deposit_flow")
    return round_doubles(J.asof_join_entity(left, right, "customer_id", "ts", ["balance_end"]))


# ---------------------------------------------------------------------- J9
@register("j9_customers_without_flows", fx.sql_with("flows") + """
SELECT c.customer_id, c.segment, round(c.balance_avg, 4) AS balance_avg FROM customers c
WHERE NOT EXISTS (SELECT 1 FROM flows f WHERE f.customer_id = c.customer_id)""")
def j9_customers_without_flows(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    return round_doubles(J.anti_join(c.select("customer_id", "segment", "balance_avg"),
                                     fx.flows(spark, sf_dir, c), ["customer_id"]))


# ---------------------------------------------------------------------- J10
@register("j10_relative_volatility", fx.sql_with("flows") + """,
s AS (SELECT customer_id, STDDEV_SAMP(deposit_flow) AS flow_std FROM flows GROUP BY customer_id)
SELECT s.customer_id, round(s.flow_std, 4) AS flow_std, round(c.balance_avg, 4) AS balance_avg,
       round(s.flow_std / NULLIF(c.balance_avg, 0), 4) AS relative_volatility
FROM s JOIN customers c ON s.customer_id = c.customer_id""")
def j10_relative_volatility(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    return round_doubles(J.relative_volatility(fx.flows(spark, sf_dir, c), c))


# ---------------------------------------------------------------------- J7
@register("j7_customer_stats_to_rows", fx.sql_with("flows") + """
SELECT customer_id, date, round(deposit_flow, 4) AS deposit_flow,
  round(AVG(deposit_flow) OVER w, 4) AS customer_flow_mean, round(STDDEV_SAMP(deposit_flow) OVER w, 4) AS customer_flow_std,
  round(MIN(deposit_flow) OVER w, 4) AS customer_flow_min, round(MAX(deposit_flow) OVER w, 4) AS customer_flow_max,
  COUNT(deposit_flow) OVER w AS customer_flow_count,
  round((deposit_flow - AVG(deposit_flow) OVER w) / (STDDEV_SAMP(deposit_flow) OVER w + 1e-8), 4) AS customer_flow_zscore
FROM flows WINDOW w AS (PARTITION BY customer_id)""")
def j7_customer_stats_to_rows(spark, sf_dir):
    f = fx.flows(spark, sf_dir).select("customer_id", "date", "deposit_flow")
    return round_doubles(A.group_stats_to_rows(f, "customer_id", "deposit_flow", "customer_flow"))


# ---------------------------------------------------------------------- A3
@register("a3_segment_balance_summary", fx.sql_with("customers") + """
SELECT segment, round_even(SUM(balance_avg), 2) AS total, round_even(AVG(balance_avg), 2) AS mean,
       round_even(STDDEV_SAMP(balance_avg), 2) AS std, round_even(MIN(balance_avg), 2) AS min,
       round_even(MAX(balance_avg), 2) AS max, COUNT(balance_avg) AS count
FROM customers GROUP BY segment""")
def a3_segment_balance_summary(spark, sf_dir):
    return A.grouped_summary(fx.customers(spark, sf_dir), ["segment"], "balance_avg", digits=2)


# ---------------------------------------------------------------------- A4
@register("a4_daily_flow_totals", fx.sql_with("flows") + """
SELECT date, round(SUM(deposit_flow), 4) AS total_flow, COUNT(deposit_flow) AS n_flows,
       round(SUM(inflow), 4) AS total_inflow, round(SUM(outflow), 4) AS total_outflow
FROM flows GROUP BY date""")
def a4_daily_flow_totals(spark, sf_dir):
    return round_doubles(A.daily_totals(fx.flows(spark, sf_dir)))


@register("a4_latest_segment_days", fx.sql_with("flows") + """
SELECT date, segment, round(flow, 4) AS deposit_flow FROM (
  SELECT date, segment, SUM(deposit_flow) AS flow FROM flows GROUP BY date, segment
  ORDER BY date DESC, segment LIMIT 200)""")
def a4_latest_segment_days(spark, sf_dir):
    d = fx.flows(spark, sf_dir).groupBy("date", "segment").agg(F.sum("deposit_flow").alias("deposit_flow"))
    # the last rows of the daily table are the feature (a top-k report)
    return round_doubles(d.orderBy(F.col("date").desc(), "segment").limit(200))


# ---------------------------------------------------------------------- A5
@register("a5_segment_value_counts", fx.sql_with("customers") + """
SELECT segment, COUNT(*) AS count, round(COUNT(*) / SUM(COUNT(*)) OVER (), 4) AS share
FROM customers WHERE segment IS NOT NULL GROUP BY segment""")
def a5_segment_value_counts(spark, sf_dir):
    return round_doubles(A.value_counts(fx.customers(spark, sf_dir), "segment", normalize=True))


# ---------------------------------------------------------------------- A6
@register("a6_distinct_counts", fx.sql_with("customers") + """
SELECT 'segment' AS "column", COUNT(DISTINCT segment) AS n_unique FROM customers UNION ALL
SELECT 'region', COUNT(DISTINCT region) FROM customers UNION ALL
SELECT 'industry', COUNT(DISTINCT industry) FROM customers UNION ALL
SELECT 'customer_id', COUNT(DISTINCT customer_id) FROM customers""")
def a6_distinct_counts(spark, sf_dir):
    return A.distinct_counts(fx.customers(spark, sf_dir), ["segment", "region", "industry", "customer_id"])


# ---------------------------------------------------------------------- A18
@register("a18_flow_stability_by_segment", fx.sql_with("flows") + """
SELECT segment, round(least(greatest(1 - STDDEV_SAMP(deposit_flow) / NULLIF(AVG(abs(deposit_flow)), 0), 0.0), 1.0), 4)
       AS flow_stability
FROM flows GROUP BY segment""")
def a18_flow_stability_by_segment(spark, sf_dir):
    return round_doubles(A.flow_stability_index(fx.flows(spark, sf_dir), ["segment"]))


# ---------------------------------------------------------------------- A20
@register("a20_target_encoding", fx.sql_with("flows") + """,
g AS (SELECT AVG(deposit_flow) AS gm FROM flows),
s AS (SELECT segment, AVG(deposit_flow) AS m, COUNT(deposit_flow) AS n FROM flows
      WHERE segment IS NOT NULL GROUP BY segment),
e AS (SELECT segment, (m * n + gm * 10.0) / (n + 10.0) AS enc FROM s, g)
SELECT f.customer_id, f.date, f.segment, round(COALESCE(e.enc, g.gm), 4) AS segment_target_encoded
FROM flows f LEFT JOIN e ON f.segment = e.segment, g""")
def a20_target_encoding(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    enc = A.target_encoding_fit(f, "segment", "deposit_flow", smoothing=10.0)
    return round_doubles(A.target_encoding_apply(f.select("customer_id", "date", "segment"), enc, "segment"))
