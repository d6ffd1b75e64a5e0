"""Registered queries: stress scenarios."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import scenarios as N
from ..schemas import ECONOMIC_SHOCKS, STANDARD_SCENARIOS
from ..session import checkpoint_dir
from ..sources.io import append_runs, last_runs
from .registry import register


def _sc_values() -> str:
    shocks = {s[0]: s[1:] for s in ECONOMIC_SHOCKS}
    rows = [N.BASE] + list(STANDARD_SCENARIOS)
    vals = []
    for name, bps, out, vix, econ in rows:
        imp, mult, inc = shocks.get(econ, (1.0, 1.0, 0.0))
        vals.append(f"('{name}', {float(bps)}, {float(out)}, {float(vix)}, '{econ}', {imp}, {mult}, {inc})")
    return ("sc AS (SELECT scenario, CAST(bps AS DOUBLE) AS bps, CAST(outr AS DOUBLE) AS outr, "
            "CAST(vix AS DOUBLE) AS vix, econ, CAST(imp AS DOUBLE) AS imp FROM (VALUES "
            + ", ".join(vals) + ") AS t(scenario, bps, outr, vix, econ, imp, mult, inc))")


def _deposits(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    f = fx.flows(spark, sf_dir, c).select("customer_id", "date", "segment", "deposit_flow",
                                          F.col("balance_end").alias("balance"))
    return c, f


_SHOCKED = fx.sql_with("flows") + ", " + _sc_values() + """,
seg AS (SELECT segment, AVG(rate_sensitivity) AS rs, AVG(loyalty_score) AS loy, AVG(volatility_factor) AS vol
        FROM customers GROUP BY segment),
rates AS (SELECT sc.scenario, seg.segment,
                 least(0.8, sc.outr * (1 + seg.rs * abs(sc.bps) / 100) * (1 + seg.vol) * (2 - seg.loy)) AS r
          FROM sc, seg),
d AS (SELECT f.customer_id, f.date, f.segment, f.deposit_flow, f.balance_end AS balance, sc.*
      FROM flows f, sc),
o AS (SELECT d.*, rates.r,
        CASE WHEN d.outr > 0 AND rates.r IS NOT NULL THEN d.balance * (1 - rates.r) ELSE d.balance END AS b1,
        CASE WHEN d.outr > 0 AND rates.r IS NOT NULL THEN -(d.balance * (1 - rates.r) * rates.r)
             ELSE d.deposit_flow END AS f1
      FROM d LEFT JOIN rates ON d.scenario = rates.scenario AND d.segment = rates.segment),
shocked AS (SELECT scenario, customer_id, date, segment, f1 AS deposit_flow,
                   CASE WHEN econ <> 'none' THEN b1 * imp ELSE b1 END AS balance FROM o)"""


@register("n1_shocked_market", fx.sql_with("market") + ", " + _sc_values() + """
SELECT sc.scenario, m.date, round(m.FED_FUNDS_RATE + sc.bps / 100, 4) AS FED_FUNDS_RATE,
  round(m.TREASURY_10Y + sc.bps / 100 * 0.8, 4) AS TREASURY_10Y,
  round(CASE WHEN sc.vix <> 0 THEN greatest(10.0, m.VIX + sc.vix) ELSE m.VIX END, 4) AS VIX
FROM market m, sc""")
def n1_shocked_market(spark, sf_dir):
    m = fx.market(spark, sf_dir).select("date", "FED_FUNDS_RATE", "TREASURY_10Y", "VIX")
    return round_doubles(N.shock_market(m))


@register("n2_segment_outflow_rates", fx.sql_with("customers") + ", " + _sc_values() + """,
seg AS (SELECT segment, AVG(rate_sensitivity) AS rs, AVG(loyalty_score) AS loy, AVG(volatility_factor) AS vol
        FROM customers GROUP BY segment)
SELECT sc.scenario, seg.segment,
  round(least(0.8, sc.outr * (1 + seg.rs * abs(sc.bps) / 100) * (1 + seg.vol) * (2 - seg.loy)), 4) AS outflow_rate
FROM sc, seg""")
def n2_segment_outflow_rates(spark, sf_dir):
    return round_doubles(N.segment_outflow_rates(fx.customers(spark, sf_dir)))


@register("n2_n3_shocked_deposits", _SHOCKED + """
SELECT scenario, customer_id, date, segment, round(deposit_flow, 4) AS deposit_flow, round(balance, 4) AS balance
FROM shocked""")
def n2_n3_shocked_deposits(spark, sf_dir):
    c, f = _deposits(spark, sf_dir)
    s = N.shock_deposits(f, c)
    return round_doubles(s.select("scenario", "customer_id", "date", "segment", "deposit_flow", "balance"))


@register("n3_shocked_deposits_with_noise")
def n3_shocked_deposits_with_noise(spark, sf_dir):
    """Random economic-shock noise (seeded): rows-only check."""
    c, f = _deposits(spark, sf_dir)
    return N.shock_deposits(f, c, noise=True).select("scenario", "customer_id", "date", "deposit_flow", "balance")


_METRICS = _SHOCKED + """,
g AS (SELECT scenario, COALESCE(SUM(balance), 0) AS total_deposits, AVG(deposit_flow) AS avg_daily_flow,
             STDDEV_SAMP(deposit_flow) AS flow_volatility, MIN(deposit_flow) AS max_daily_outflow,
             COUNT(CASE WHEN deposit_flow < 0 THEN 1 END) AS outflow_days_count, COUNT(deposit_flow) AS n,
             COALESCE(AVG(CASE WHEN deposit_flow < 0 THEN abs(deposit_flow) END), 0) AS ao,
             quantile_cont(deposit_flow, 0.05) AS v
      FROM shocked GROUP BY scenario),
m AS (SELECT *, total_deposits * 0.15 / (ao * 30 + 1e-8) AS lcr FROM g),
metrics AS (SELECT scenario, total_deposits, avg_daily_flow, flow_volatility, max_daily_outflow, outflow_days_count,
                   lcr AS stressed_lcr_ratio, lcr < 1.0 AS lcr_breach,
                   CASE WHEN n >= 30 THEN v END AS stressed_dar_95,
                   CASE WHEN lcr < 1.0 THEN greatest(0.0, abs(max_daily_outflow) * 30 - total_deposits * 0.15)
                        ELSE 0.0 END AS funding_gap FROM m)"""


@register("n4_scenario_metrics", _METRICS + """
SELECT scenario, round(total_deposits, 4) AS total_deposits, round(avg_daily_flow, 4) AS avg_daily_flow,
  round(flow_volatility, 4) AS flow_volatility, round(max_daily_outflow, 4) AS max_daily_outflow,
  outflow_days_count, round(stressed_lcr_ratio, 4) AS stressed_lcr_ratio, lcr_breach,
  round(stressed_dar_95, 4) AS stressed_dar_95, round(funding_gap, 4) AS funding_gap
FROM metrics""")
def n4_scenario_metrics(spark, sf_dir):
    c, f = _deposits(spark, sf_dir)
    return round_doubles(N.scenario_metrics(N.shock_deposits(f, c)))


_CMP = _METRICS + """,
b AS (SELECT * FROM metrics WHERE scenario = 'base'),
cmp AS (SELECT m.scenario, m.total_deposits - b.total_deposits AS deposit_change_abs,
               (m.total_deposits - b.total_deposits) / b.total_deposits * 100 AS deposit_change_pct,
               m.stressed_lcr_ratio - b.stressed_lcr_ratio AS lcr_change, m.lcr_breach AS lcr_breach_risk,
               m.stressed_dar_95 - COALESCE(b.stressed_dar_95, 0) AS dar_change, m.funding_gap
        FROM metrics m, b WHERE m.scenario <> 'base')"""


@register("n5_compare_scenarios", _CMP + """
SELECT scenario, round(deposit_change_abs, 4) AS deposit_change_abs, round(deposit_change_pct, 4) AS deposit_change_pct,
  round(lcr_change, 4) AS lcr_change, lcr_breach_risk, round(dar_change, 4) AS dar_change,
  round(funding_gap, 4) AS funding_gap,
  CASE WHEN deposit_change_pct < -20 THEN 'High' WHEN deposit_change_pct < -10 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM cmp""")
def n5_compare_scenarios(spark, sf_dir):
    c, f = _deposits(spark, sf_dir)
    return round_doubles(N.compare_scenarios(N.scenario_metrics(N.shock_deposits(f, c))))


@register("n6_assess_scenarios", _CMP + """,
j AS (SELECT m.*, abs(cmp.deposit_change_pct) AS loss FROM metrics m JOIN cmp ON m.scenario = cmp.scenario),
s AS (SELECT scenario, lcr_breach, loss, funding_gap,
        (CASE WHEN lcr_breach THEN 40 WHEN stressed_lcr_ratio < 1.1 THEN 20 ELSE 0 END)
        + (CASE WHEN loss > 30 THEN 30 WHEN loss > 15 THEN 20 WHEN loss > 5 THEN 10 ELSE 0 END)
        + (CASE WHEN funding_gap > 1e9 THEN 20 WHEN funding_gap > 5e8 THEN 15 WHEN funding_gap > 1e8 THEN 10 ELSE 0 END)
        + (CASE WHEN COALESCE(flow_volatility, 0) > 3e6 THEN 10 WHEN COALESCE(flow_volatility, 0) > 2e6 THEN 5 ELSE 0 END)
        AS risk_score FROM j)
SELECT scenario, risk_score, risk_score >= 70 AS critical, lcr_breach, loss > 20 AS high_deposit_loss,
       funding_gap > 1e8 AS large_funding_gap FROM s""")
def n6_assess_scenarios(spark, sf_dir):
    c, f = _deposits(spark, sf_dir)
    m = N.scenario_metrics(N.shock_deposits(f, c))
    return N.assess_scenarios(m, N.compare_scenarios(m))


@register("n8_n9_quick_impact_presets", fx.sql_with("flows") + """,
b AS (SELECT COALESCE(SUM(balance_avg), 1e9) AS bd FROM customers),
fl AS (SELECT COALESCE(SUM(deposit_flow), 0.0) AS bf FROM flows),
p AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', {float(o)}, {float(b)})" for n, o, b in N.SCENARIO_PRESETS) + """)
      AS v(scenario, outr, bps)),
x AS (SELECT scenario, bd, bf, outr, bps, bd * (1 - outr) AS sd, 1.15 * (1 - outr * 0.5) AS lcr FROM b, fl, p)
SELECT scenario, round(bd, 4) AS base_deposits, round(sd, 4) AS scenario_deposits, round(lcr, 4) AS scenario_lcr,
  round(bf * (1 + bps / 10000 * 10), 4) AS scenario_flows, round(sd - bd, 4) AS deposit_change,
  round((sd - bd) / bd * 100, 4) AS deposit_change_pct, round(round(lcr - 1.15, 9) * 10000) / 10000 AS lcr_change,
  round(bf * (1 + bps / 10000 * 10) - bf, 4) AS flow_change,
  round(greatest(0.0, (bd - sd) - bd * 0.15), 4) AS funding_gap, round(lcr / 1.15, 4) AS stress_ratio,
  CASE WHEN lcr / 1.15 < 0.8 THEN 'High' WHEN lcr / 1.15 < 0.9 THEN 'Medium' ELSE 'Low' END AS risk_level,
  lcr < 1.0 AS lcr_breach,
  list_filter([CASE WHEN lcr < 1.0 THEN 'LCR below regulatory minimum' END,
               CASE WHEN outr > 0.2 THEN 'High deposit outflow' END,
               CASE WHEN greatest(0.0, (bd - sd) - bd * 0.15) > bd * 0.1 THEN 'Significant funding gap' END], lambda x: x IS NOT NULL) AS critical_metrics
FROM x""")
def n8_n9_quick_impact_presets(spark, sf_dir):
    c, f = _deposits(spark, sf_dir)
    return round_doubles(N.quick_impact(c, f, N.SCENARIO_PRESETS))


@register("n7_scenario_report", _CMP + """,
j AS (SELECT m.*, abs(cmp.deposit_change_pct) AS loss FROM metrics m JOIN cmp ON m.scenario = cmp.scenario),
a AS (SELECT scenario, lcr_breach, loss, funding_gap,
        (CASE WHEN lcr_breach THEN 40 WHEN stressed_lcr_ratio < 1.1 THEN 20 ELSE 0 END)
        + (CASE WHEN loss > 30 THEN 30 WHEN loss > 15 THEN 20 WHEN loss > 5 THEN 10 ELSE 0 END)
        + (CASE WHEN funding_gap > 1e9 THEN 20 WHEN funding_gap > 5e8 THEN 15 WHEN funding_gap > 1e8 THEN 10 ELSE 0 END)
        + (CASE WHEN COALESCE(flow_volatility, 0) > 3e6 THEN 10 WHEN COALESCE(flow_volatility, 0) > 2e6 THEN 5 ELSE 0 END)
        AS risk_score FROM j)
SELECT m.scenario, round(m.total_deposits, 4) AS total_deposits, round(m.avg_daily_flow, 4) AS avg_daily_flow,
  round(m.flow_volatility, 4) AS flow_volatility, round(m.max_daily_outflow, 4) AS max_daily_outflow,
  m.outflow_days_count, round(m.stressed_lcr_ratio, 4) AS stressed_lcr_ratio, m.lcr_breach,
  round(m.stressed_dar_95, 4) AS stressed_dar_95, round(m.funding_gap, 4) AS funding_gap,
  round(c.deposit_change_abs, 4) AS deposit_change_abs, round(c.deposit_change_pct, 4) AS deposit_change_pct,
  round(c.lcr_change, 4) AS lcr_change, c.lcr_breach_risk, round(c.dar_change, 4) AS dar_change,
  CASE WHEN c.scenario IS NOT NULL THEN CASE WHEN c.deposit_change_pct < -20 THEN 'High'
       WHEN c.deposit_change_pct < -10 THEN 'Medium' ELSE 'Low' END END AS risk_level,
  a.risk_score, a.risk_score >= 70 AS critical, a.loss > 20 AS high_deposit_loss,
  a.funding_gap > 1e8 AS large_funding_gap
FROM metrics m LEFT JOIN cmp c ON m.scenario = c.scenario LEFT JOIN a ON m.scenario = a.scenario""")
def n7_scenario_report(spark, sf_dir):
    c, f = _deposits(spark, sf_dir)
    return round_doubles(N.scenario_report(f, c))


@register("n10_scenario_waterfall", _CMP + """
SELECT scenario, round(deposit_change_abs, 4) AS increment,
  round((SELECT total_deposits FROM b) + SUM(deposit_change_abs) OVER (ORDER BY scenario ROWS UNBOUNDED PRECEDING), 4)
    AS running_total
FROM cmp""")
def n10_scenario_waterfall(spark, sf_dir):
    c, f = _deposits(spark, sf_dir)
    m = N.scenario_metrics(N.shock_deposits(f, c))
    base = m.where(F.col("scenario") == "base").select("total_deposits").scalar()
    return round_doubles(N.waterfall(N.compare_scenarios(m), base))


@register("n10_last_runs_comparison", fx.sql_with("customers") + """,
b AS (SELECT COALESCE(SUM(balance_avg), 1e9) AS bd FROM customers),
p AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{n}', {float(o)})" for i, (n, o, _) in enumerate(N.SCENARIO_PRESETS)) + """)
      AS v(run_id, scenario, outr)),
x AS (SELECT run_id, scenario, bd, bd * (1 - outr) AS sd, 1.15 * (1 - outr * 0.5) AS lcr FROM b, p
      ORDER BY run_id DESC LIMIT 5)
SELECT CAST(run_id AS BIGINT) AS run_id, scenario, round((sd - bd) / bd * 100, 4) AS deposit_change_pct,
  round(round(lcr - 1.15, 9) * 10000) / 10000 AS lcr_change,
  round(greatest(0.0, (bd - sd) - bd * 0.15) / 1e6, 4) AS funding_gap_millions,
  CASE WHEN lcr / 1.15 < 0.8 THEN 'High' WHEN lcr / 1.15 < 0.9 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM x""")
def n10_last_runs_comparison(spark, sf_dir):
    """Each preset is a run of the log; its five newest runs are compared."""
    c, f = _deposits(spark, sf_dir)
    ids = F.create_map(*[x for i, (n, _, _) in enumerate(N.SCENARIO_PRESETS) for x in (F.lit(n), F.lit(i).cast("long"))])
    runs = N.quick_impact(c, f, N.SCENARIO_PRESETS).withColumn("run_id", ids[F.col("scenario")])
    log = os.path.join(checkpoint_dir(spark), f"scenario_runs-{uuid.uuid4().hex}")
    append_runs(runs, log)
    return round_doubles(N.compare_runs(last_runs(spark, log, 5)))
