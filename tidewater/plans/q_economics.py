"""Queries for economic indicators (M6, J3) and rank correlation."""

from __future__ import annotations

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import economics as EC
from ..operators import reports as RP
from .registry import register

_DERIVED = """,
q AS (SELECT date, 100 * (GDP_REAL / LAG(GDP_REAL) OVER w - 1) AS GDP_GROWTH_QOQ,
             100 * (GDP_REAL / LAG(GDP_REAL, 4) OVER w - 1) AS GDP_GROWTH_YOY FROM growth WINDOW w AS (ORDER BY date)),
m0 AS (SELECT date, 100 * (CPI_ALL / LAG(CPI_ALL, 12) OVER w - 1) AS CPI_ALL_YOY, 100 * (PCE_CORE / LAG(PCE_CORE, 12) OVER w - 1) AS PCE_CORE_YOY,
              100 * (CPI_ALL / LAG(CPI_ALL, 3) OVER w - 1) AS INFLATION_MOMENTUM,
              CASE WHEN COUNT(*) OVER six = 6 THEN regr_slope(LEADING_INDEX, CAST(rn AS DOUBLE)) OVER six END AS slope,
              JOB_OPENINGS / NULLIF(UNEMPLOYMENT_RATE, 0) AS BEVERIDGE_CURVE
       FROM (SELECT *, row_number() OVER (ORDER BY date) AS rn FROM monthly)
       WINDOW w AS (ORDER BY date), six AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, INFLATION_MOMENTUM - LAG(INFLATION_MOMENTUM) OVER (ORDER BY date) AS INFLATION_ACCELERATION,
             CASE WHEN slope > 0.1 THEN 1.0 WHEN slope < -0.1 THEN -1.0 ELSE 0.0 END AS BUSINESS_CYCLE_PHASE FROM m0),
b AS (SELECT b.date, CREDIT_SPREAD_BAA - CREDIT_SPREAD_AAA AS CREDIT_RISK_SPREAD,
             ((VIX - (SELECT AVG(VIX) FROM business)) / (SELECT stddev_samp(VIX) FROM business)
              + (CREDIT_SPREAD_BAA - (SELECT AVG(CREDIT_SPREAD_BAA) FROM business)) / (SELECT stddev_samp(CREDIT_SPREAD_BAA) FROM business)
              + (u.UNEMPLOYMENT_RATE - (SELECT AVG(UNEMPLOYMENT_RATE) FROM monthly)) / (SELECT stddev_samp(UNEMPLOYMENT_RATE) FROM monthly)) / 3 AS ECONOMIC_STRESS_INDEX
      FROM business b LEFT JOIN monthly u ON b.date = u.date)"""
_FROM = {"GDP_GROWTH_QOQ": "q", "GDP_GROWTH_YOY": "q", "CPI_ALL_YOY": "m", "PCE_CORE_YOY": "m", "INFLATION_MOMENTUM": "m", "INFLATION_ACCELERATION": "m",
         "BUSINESS_CYCLE_PHASE": "m", "BEVERIDGE_CURVE": "m", "CREDIT_RISK_SPREAD": "b", "ECONOMIC_STRESS_INDEX": "b"}
_BASE = {"growth": ["GDP_REAL"], "monthly": ["UNEMPLOYMENT_RATE", "JOB_OPENINGS", "CPI_ALL", "PCE_CORE", "LEADING_INDEX"], "business": ["VIX", "CREDIT_SPREAD_BAA", "CREDIT_SPREAD_AAA"]}


@register("m6_economic_indicators", fx.sql_with("growth", "monthly", "business") + _DERIVED + "\n" + " UNION ALL ".join(
    f"SELECT date, '{c}' AS series, round({c}, 4) AS value FROM {t} WHERE {c} IS NOT NULL" for c, t in _FROM.items()))
def m6_economic_indicators(spark, sf_dir):
    """Every derived series, on its own observations."""
    return round_doubles(EC.economic_indicators(EC.long_series(fx.economic_groups(spark, sf_dir))))


_ALL = [c for cols in _BASE.values() for c in cols] + list(_FROM)


@register("j3_economic_composite", fx.sql_with("growth", "monthly", "business") + _DERIVED + """,
d AS (SELECT date FROM growth UNION SELECT date FROM monthly UNION SELECT date FROM business),
j AS (SELECT d.date, """ + ", ".join(_ALL) + """ FROM d LEFT JOIN growth ON growth.date = d.date LEFT JOIN monthly ON monthly.date = d.date
      LEFT JOIN business ON business.date = d.date LEFT JOIN q ON q.date = d.date LEFT JOIN (SELECT * EXCLUDE (slope) FROM m) m ON m.date = d.date LEFT JOIN b ON b.date = d.date)
SELECT date, """ + ", ".join(f"round(COALESCE(last_value({c} IGNORE NULLS) OVER p, first_value({c} IGNORE NULLS) OVER f), 4) AS {c}" for c in _ALL) + """
FROM j WINDOW p AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def j3_economic_composite(spark, sf_dir):
    """All series and what is derived from them, on the union of their dates."""
    return round_doubles(EC.economic_composite(fx.economic_groups(spark, sf_dir)))


# ---------------------------------------------------------------------- A9
_RANKED = ["balance_avg", "rate_sensitivity", "loyalty_score", "volatility_factor"]


@register("a9_kendall_correlation", fx.sql_with("customers") + ",\np AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS var1, '{b}' AS var2, SUM(sign(s.{a} - t.{a}) * sign(s.{b} - t.{b})) AS c,
  SUM(CASE WHEN s.{a} <> t.{a} THEN 1 ELSE 0 END) AS nx, SUM(CASE WHEN s.{b} <> t.{b} THEN 1 ELSE 0 END) AS ny
  FROM customers s JOIN customers t ON s.customer_id < t.customer_id""" for a in _RANKED for b in _RANKED) + """)
SELECT var1, var2, round(CASE WHEN (SELECT COUNT(*) FROM customers) >= 10 THEN c / NULLIF(sqrt(CAST(nx AS DOUBLE) * ny), 0) END, 4) AS corr FROM p""")
def a9_kendall_correlation(spark, sf_dir):
    return round_doubles(RP.correlation_matrix(fx.customers(spark, sf_dir), _RANKED, "kendall"))
