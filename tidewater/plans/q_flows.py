"""Registered queries: flow aggregation, windows and joins on the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import flows as A
from ..operators import risk as R
from ..operators import windows as W
from .registry import register

def r4(*cols: str) -> str:
    return ", ".join(f"round({c}, 4) AS {c.split('.')[-1]}" for c in cols)


# ----------------------------------------------------------------------------
def flagship(spark, sf_dir):
    """J8 -> A1 -> W2 (7-row mean per segment) -> R1 per segment."""
    cust = fx.customers(spark, sf_dir)
    flows = fx.flows(spark, sf_dir, cust)
    daily = A.segment_daily_flows(flows)
    rolled = W.rolling_features(daily, ["deposit_flow"], [7], ["date"], ["segment"], stats=("ma",))
    # one row per segment value: bounded by the segment domain
    lcr = R.lcr_ratio(flows, by=["segment"], balance_col="balance_end").select(
        "segment", "lcr_ratio", "risk_level")
    out = rolled.join(F.broadcast(lcr), "segment", "left")
    return round_doubles(out.select("date", "segment", "deposit_flow", "inflow", "outflow",
                                    "active_customers", "net_flow_rate", "deposit_flow_ma_7",
                                    "lcr_ratio", "risk_level"))


FLAGSHIP_SQL = fx.sql_with("flows") + """,
daily AS (
  SELECT date, segment, SUM(deposit_flow) AS deposit_flow, SUM(inflow) AS inflow,
         SUM(outflow) AS outflow, COUNT(DISTINCT customer_id) AS active_customers,
         SUM(deposit_flow) / NULLIF(SUM(balance_start), 0) AS net_flow_rate
  FROM flows GROUP BY date, segment),
rolled AS (
  SELECT *, CASE WHEN COUNT(deposit_flow) OVER w >= 7 THEN AVG(deposit_flow) OVER w END AS deposit_flow_ma_7
  FROM daily WINDOW w AS (PARTITION BY segment ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
lcr AS (
  SELECT segment,
         (0.15 * COALESCE(SUM(balance_end), 0)) /
           (30 * COALESCE(AVG(CASE WHEN deposit_flow < 0 THEN abs(deposit_flow) END), 0) + 1e-8) AS lcr_ratio
  FROM flows GROUP BY segment)
SELECT r.date, r.segment, """ + r4("r.deposit_flow", "r.inflow", "r.outflow") + """,
       r.active_customers, """ + r4("r.net_flow_rate", "r.deposit_flow_ma_7", "l.lcr_ratio") + """,
       CASE WHEN l.lcr_ratio >= 1.1 THEN 'Low' WHEN l.lcr_ratio >= 1.0 THEN 'Medium' ELSE 'High' END AS risk_level
FROM rolled r LEFT JOIN lcr l ON r.segment = l.segment
"""

register("flagship_segment_liquidity", FLAGSHIP_SQL)(flagship)


# ---------------------------------------------------------------------- A1
@register("a1_segment_daily_flows", fx.sql_with("flows") + """
SELECT date, segment, round(SUM(deposit_flow), 4) AS deposit_flow,
       round(SUM(inflow), 4) AS inflow, round(SUM(outflow), 4) AS outflow,
       COUNT(DISTINCT customer_id) AS active_customers,
       round(SUM(deposit_flow) / NULLIF(SUM(balance_start), 0), 4) AS net_flow_rate
FROM flows GROUP BY date, segment""")
def a1_segment_daily_flows(spark, sf_dir):
    return round_doubles(A.segment_daily_flows(fx.flows(spark, sf_dir)))


# ---------------------------------------------------------------------- J8
@register("j8_flows_with_segment", fx.sql_with("flows") + """
SELECT customer_id, date, round(deposit_flow, 4) AS deposit_flow, round(inflow, 4) AS inflow,
       round(outflow, 4) AS outflow, segment, round(balance_start, 4) AS balance_start,
       round(balance_end, 4) AS balance_end
FROM flows""")
def j8_flows_with_segment(spark, sf_dir):
    return round_doubles(fx.flows(spark, sf_dir))
