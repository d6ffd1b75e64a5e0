"""Registered queries: risk measures."""

from __future__ import annotations

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import risk as R
from .registry import register


@register("r1_lcr_by_segment", fx.sql_with("flows") + """,
a AS (
  SELECT segment, 0.15 * COALESCE(SUM(balance_end), 0) AS liquid_assets,
         COALESCE(AVG(CASE WHEN deposit_flow < 0 THEN abs(deposit_flow) END), 0) AS avg_out
  FROM flows GROUP BY segment)
SELECT segment, round(liquid_assets / (30 * avg_out + 1e-8), 4) AS lcr_ratio,
       round(liquid_assets, 4) AS liquid_assets, round(30 * avg_out, 4) AS net_30day_outflow,
       CAST(1.0 AS DOUBLE) AS minimum_required, CAST(1.1 AS DOUBLE) AS buffer_target,
       CASE WHEN liquid_assets / (30 * avg_out + 1e-8) >= 1.1 THEN 'Low'
            WHEN liquid_assets / (30 * avg_out + 1e-8) >= 1.0 THEN 'Medium' ELSE 'High' END AS risk_level,
       round(liquid_assets - 30 * avg_out * 1.0, 4) AS excess_liquidity,
       round(liquid_assets / (avg_out + 1e-8), 4) AS days_to_depletion
FROM a""")
def r1_lcr_by_segment(spark, sf_dir):
    return round_doubles(R.lcr_ratio(fx.flows(spark, sf_dir), by=["segment"], balance_col="balance_end"))

# ---------------------------------------------------------------------------
from statistics import NormalDist  # noqa: E402

from ..operators import reports as RP  # noqa: E402

Z05 = repr(NormalDist().inv_cdf(0.05))


def _dar_sql(group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    on = f"ON f.{group} = s.{group}" if group else "ON true"
    sel_g = f"s.{group}, " if group else ""
    return fx.sql_with("flows") + f""",
s AS (SELECT {g}COUNT(deposit_flow) AS n, quantile_cont(deposit_flow, 0.05) AS hv, AVG(deposit_flow) AS m,
             STDDEV_SAMP(deposit_flow) AS sd, MIN(deposit_flow) AS mn, MAX(deposit_flow) AS mx
      FROM flows WHERE deposit_flow IS NOT NULL {gb}),
t AS (SELECT {sel_g}s.n, s.hv, s.m, s.sd, s.mn, s.mx,
        AVG((f.deposit_flow - s.m) * (f.deposit_flow - s.m)) AS m2,
        AVG((f.deposit_flow - s.m) * (f.deposit_flow - s.m) * (f.deposit_flow - s.m)) AS m3,
        AVG((f.deposit_flow - s.m) * (f.deposit_flow - s.m) * (f.deposit_flow - s.m) * (f.deposit_flow - s.m)) AS m4,
        AVG(CASE WHEN f.deposit_flow <= s.hv THEN f.deposit_flow END) AS es,
        COUNT(CASE WHEN f.deposit_flow < s.hv THEN 1 END) AS viol
      FROM flows f JOIN s {on} WHERE f.deposit_flow IS NOT NULL AND s.n >= 30
      GROUP BY {sel_g}s.n, s.hv, s.m, s.sd, s.mn, s.mx)
SELECT {g}CAST(0.95 AS DOUBLE) AS confidence_level, n, round(hv, 4) AS historical_var,
  round(m + {Z05} * sd, 4) AS parametric_var, round(COALESCE(es, hv), 4) AS expected_shortfall,
  round(abs(hv) / (sd + 1e-8), 4) AS var_ratio, round(m, 4) AS mean, round(sd, 4) AS std,
  round(m3 / pow(m2, 1.5), 4) AS skewness, round(m4 / (m2 * m2) - 3, 4) AS kurtosis,
  round(mn, 4) AS min, round(mx, 4) AS max, round(viol / n, 4) AS backtesting_violations
FROM t"""


@register("r2_deposit_at_risk", _dar_sql())
def r2_deposit_at_risk(spark, sf_dir):
    return round_doubles(R.deposit_at_risk(fx.flows(spark, sf_dir)))


@register("r2_deposit_at_risk_by_segment", _dar_sql("segment"))
def r2_deposit_at_risk_by_segment(spark, sf_dir):
    return round_doubles(R.deposit_at_risk(fx.flows(spark, sf_dir), by=["segment"]))


@register("r2_monte_carlo_var")
def r2_monte_carlo_var(spark, sf_dir):
    """Random draws: rows-only check (own seed)."""
    return R.monte_carlo_var(fx.flows(spark, sf_dir))


# ---------------------------------------------------------------------- R3
@register("r3_segment_shares", fx.sql_with("customers") + """
SELECT segment, round(SUM(balance_avg), 4) AS exposure,
       round(SUM(balance_avg) / (SELECT SUM(balance_avg) FROM customers), 4) AS share
FROM customers GROUP BY segment""")
def r3_segment_shares(spark, sf_dir):
    return round_doubles(R.segment_shares(fx.customers(spark, sf_dir)))


@register("r3_concentration_risk", fx.sql_with("customers") + """,
tot AS (SELECT SUM(balance_avg) AS t FROM customers),
seg AS (SELECT segment, SUM(balance_avg) / (SELECT t FROM tot) AS share FROM customers GROUP BY segment),
sr AS (SELECT SUM(share * share) AS hhi, MAX(share) AS mx, COUNT(*) AS n,
              (SELECT SUM(share) FROM (SELECT share FROM seg ORDER BY share DESC LIMIT 3)) AS top3 FROM seg),
reg AS (SELECT region, SUM(balance_avg) / (SELECT t FROM tot) AS share FROM customers GROUP BY region),
rr AS (SELECT MAX(share) AS mx, COUNT(*) AS n FROM reg),
thr AS (SELECT quantile_cont(balance_avg, 0.95) AS th FROM customers),
big AS (SELECT COUNT(CASE WHEN balance_avg >= th THEN 1 END) AS nl,
               SUM(CASE WHEN balance_avg >= th THEN balance_avg END) / SUM(balance_avg) AS conc,
               AVG(CASE WHEN balance_avg >= th THEN balance_avg END) AS avg_l, MAX(balance_avg) AS largest
        FROM customers, thr)
SELECT round(sr.hhi, 4) AS hhi_index, round(sr.top3, 4) AS top_3_concentration, round(sr.mx, 4) AS max_segment_exposure,
  sr.n AS n_segments, round(rr.mx, 4) AS max_region_exposure, rr.n AS n_regions, round(thr.th, 4) AS threshold,
  big.nl AS n_large_depositors, round(big.conc, 4) AS large_depositor_concentration,
  round(big.avg_l, 4) AS avg_large_depositor_balance, round(big.largest, 4) AS largest_depositor_balance,
  list_filter([CASE WHEN sr.top3 > 0.7 THEN 'High segment concentration' END,
               CASE WHEN big.conc > 0.3 THEN 'High large depositor concentration' END], lambda x: x IS NOT NULL) AS risk_flags,
  CASE WHEN (CASE WHEN sr.top3 > 0.7 THEN 1 ELSE 0 END) + (CASE WHEN big.conc > 0.3 THEN 1 ELSE 0 END) >= 2 THEN 'High'
       WHEN (CASE WHEN sr.top3 > 0.7 THEN 1 ELSE 0 END) + (CASE WHEN big.conc > 0.3 THEN 1 ELSE 0 END) = 1 THEN 'Medium'
       ELSE 'Low' END AS overall_risk
FROM sr, rr, thr, big""")
def r3_concentration_risk(spark, sf_dir):
    return round_doubles(R.concentration_risk(fx.customers(spark, sf_dir)))


# ---------------------------------------------------------------------- R4
@register("r4_segment_behavioral_risk", fx.sql_with("customers") + """,
c AS (SELECT *, rate_sensitivity * 0.4 + (1 - loyalty_score) * 0.35 + volatility_factor * 0.25 AS score FROM customers),
g AS (SELECT segment, round_even(AVG(score), 4) AS ms, round_even(STDDEV_SAMP(score), 4) AS ss, COUNT(score) AS cs,
             round_even(SUM(balance_avg), 4) AS sb, round_even(AVG(rate_sensitivity), 4) AS mr,
             round_even(AVG(loyalty_score), 4) AS ml, round_even(AVG(volatility_factor), 4) AS mv
      FROM c GROUP BY segment)
SELECT segment, round(ms, 4) AS mean_behavioral_risk_score, round(ss, 4) AS std_behavioral_risk_score,
  cs AS count_behavioral_risk_score, round(sb, 4) AS sum_balance_avg, round(mr, 4) AS mean_rate_sensitivity,
  round(ml, 4) AS mean_loyalty_score, round(mv, 4) AS mean_volatility_factor,
  round(ms * sb, 4) AS risk_weighted_exposure
FROM g""")
def r4_segment_behavioral_risk(spark, sf_dir):
    return round_doubles(R.segment_behavioral_risk(fx.customers(spark, sf_dir)))


@register("r4_segment_flow_risk", fx.sql_with("flows") + """,
st AS (SELECT segment, STDDEV_SAMP(deposit_flow) AS flow_std, AVG(deposit_flow) AS flow_mean,
              COUNT(deposit_flow) AS flow_count, MIN(deposit_flow) AS flow_min, MAX(deposit_flow) AS flow_max
       FROM flows GROUP BY segment),
d AS (SELECT segment, date, SUM(deposit_flow) AS x FROM flows GROUP BY segment, date),
l AS (SELECT segment, x, LAG(x) OVER (PARTITION BY segment ORDER BY date) AS xl FROM d),
p AS (SELECT segment, COALESCE(CASE WHEN COUNT(*) > 10 THEN corr(x, xl) END, 0.0) AS persistence
      FROM l GROUP BY segment)
SELECT st.segment, round(flow_std, 4) AS flow_std, round(flow_mean, 4) AS flow_mean, flow_count,
  round(flow_min, 4) AS flow_min, round(flow_max, 4) AS flow_max, round(persistence, 4) AS persistence
FROM st LEFT JOIN p ON st.segment = p.segment""")
def r4_segment_flow_risk(spark, sf_dir):
    return round_doubles(R.segment_flow_risk(fx.flows(spark, sf_dir)))


# ---------------------------------------------------------------------- R5
@register("r5_gini_top_shares", fx.sql_with("customers") + """,
o AS (SELECT balance_avg AS x, row_number() OVER (ORDER BY balance_avg) AS i, COUNT(*) OVER () AS n
      FROM customers WHERE balance_avg IS NOT NULL),
d AS (SELECT balance_avg AS x, row_number() OVER (ORDER BY balance_avg DESC) AS j FROM customers
      WHERE balance_avg IS NOT NULL),
nn AS (SELECT COUNT(*) AS n, SUM(x) AS t FROM o)
SELECT round((SELECT SUM((2 * i - n - 1) * x) FROM o) / (nn.n * nn.t), 4) AS gini_coefficient,
  round(nn.t, 4) AS total, nn.n AS n,
  round(COALESCE((SELECT SUM(x) FROM d WHERE j <= floor(nn.n * 0.10)), 0) / nn.t, 4) AS top_10_pct_share,
  round(COALESCE((SELECT SUM(x) FROM d WHERE j <= floor(nn.n * 0.05)), 0) / nn.t, 4) AS top_5_pct_share,
  round(COALESCE((SELECT SUM(x) FROM d WHERE j <= floor(nn.n * 0.01)), 0) / nn.t, 4) AS top_1_pct_share
FROM nn""")
def r5_gini_top_shares(spark, sf_dir):
    return round_doubles(R.gini_and_top_shares(fx.customers(spark, sf_dir), "balance_avg"))


# ---------------------------------------------------------------------- R7
_R7_CTE = """
mk AS (SELECT date, VIX, FED_FUNDS_RATE, TREASURY_10Y, TREASURY_2Y,
         CASE WHEN COUNT(VIX) OVER (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) >= 63
              THEN AVG(VIX) OVER (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) END AS avg_vix_3m,
         FED_FUNDS_RATE - LAG(FED_FUNDS_RATE, 30) OVER (ORDER BY date) AS rate_change_30d FROM market),
lm AS (SELECT * FROM mk ORDER BY date DESC LIMIT 1)"""
_R7_COLS = """round(lm.VIX, 4) AS current_vix, round(lm.avg_vix_3m, 4) AS avg_vix_3m,
  round(lm.VIX / NULLIF(lm.avg_vix_3m, 0), 4) AS vix_stress_indicator,
  CASE WHEN lm.VIX > 30 THEN 'High' WHEN lm.VIX > 20 THEN 'Medium' ELSE 'Low' END AS stress_level,
  round(lm.FED_FUNDS_RATE, 4) AS current_rate, round(lm.rate_change_30d, 4) AS rate_change_30d,
  CASE WHEN lm.FED_FUNDS_RATE > 5 THEN 'High' WHEN lm.FED_FUNDS_RATE > 1 THEN 'Normal' ELSE 'Low' END AS rate_regime,
  round(lm.TREASURY_10Y - lm.TREASURY_2Y, 4) AS current_spread,
  CASE WHEN lm.TREASURY_10Y - lm.TREASURY_2Y < 0 THEN 'Inverted' WHEN lm.TREASURY_10Y - lm.TREASURY_2Y < 0.5
       THEN 'Flat' ELSE 'Normal' END AS curve_shape"""


@register("r7_market_liquidity_risk", fx.sql_with("market") + "," + _R7_CTE + f"""
SELECT lm.date AS as_of, {_R7_COLS} FROM lm""")
def r7_market_liquidity_risk(spark, sf_dir):
    return round_doubles(R.market_liquidity_risk(fx.market(spark, sf_dir)))


# ------------------------------------------------------------------- R6/R8
def _r6_sql() -> str:
    return fx.sql_with("market", "flows") + "," + _R7_CTE + f""",
base AS (SELECT deposit_flow AS x, balance_end AS b FROM flows),
lcr AS (SELECT 0.15 * COALESCE(SUM(b), 0) AS la,
               30 * COALESCE(AVG(CASE WHEN x < 0 THEN abs(x) END), 0) AS n30 FROM base),
s AS (SELECT COUNT(x) AS n, quantile_cont(x, 0.05) AS hv, AVG(x) AS m, STDDEV_SAMP(x) AS sd,
             COUNT(*) AS nall, MIN(x) AS mn FROM base),
t AS (SELECT AVG(CASE WHEN x <= hv THEN x END) AS es, COUNT(CASE WHEN x < hv THEN 1 END) AS viol,
             AVG((x - m) * (x - m)) AS m2, AVG((x - m) * (x - m) * (x - m)) AS m3,
             AVG((x - m) * (x - m) * (x - m) * (x - m)) AS m4,
             COUNT(CASE WHEN x > 0 THEN 1 END) AS pos, COUNT(CASE WHEN x < -2 * sd THEN 1 END) AS large,
             AVG(CASE WHEN x < -sd THEN x END) AS stress
      FROM base, s),
dist AS (SELECT SUM(b) AS tot, AVG(b) AS avgb, quantile_cont(b, 0.5) AS med, COUNT(b) AS nb FROM base),
o AS (SELECT b, row_number() OVER (ORDER BY b) AS i FROM base WHERE b IS NOT NULL),
dd AS (SELECT b, row_number() OVER (ORDER BY b DESC) AS j FROM base WHERE b IS NOT NULL),
g AS (SELECT SUM((2 * i - (SELECT nb FROM dist) - 1) * b) / ((SELECT nb FROM dist) * (SELECT tot FROM dist)) AS gini FROM o),
tops AS (SELECT COALESCE(SUM(CASE WHEN j <= floor(nb * 0.10) THEN b END), 0) / tot AS t10,
                COALESCE(SUM(CASE WHEN j <= floor(nb * 0.05) THEN b END), 0) / tot AS t5,
                COALESCE(SUM(CASE WHEN j <= floor(nb * 0.01) THEN b END), 0) / tot AS t1 FROM dd, dist GROUP BY nb, tot),
r AS (SELECT lcr.la / (lcr.n30 + 1e-8) AS lcr_ratio, lcr.la, lcr.n30, s.hv, s.m + {Z05} * s.sd AS pv,
             COALESCE(t.es, s.hv) AS es, CASE WHEN s.n >= 30 THEN t.viol / s.n END AS viol, s.sd,
             t.m3 / pow(t.m2, 1.5) AS skew, t.m4 / (t.m2 * t.m2) - 3 AS kurt, t.pos / s.nall AS posd,
             t.large / s.nall AS larged, s.mn, t.stress, dist.tot, dist.avgb, dist.med, g.gini, tops.t10, tops.t5, tops.t1
      FROM lcr, s, t, dist, g, tops),
w AS (SELECT *, list_filter([CASE WHEN COALESCE(lcr_ratio, 1.0) < 1.1 THEN 'LCR below buffer threshold' END,
                             CASE WHEN COALESCE(viol, 0.0) > 0.05 THEN 'High VaR violations' END,
                             CASE WHEN COALESCE(t10, 0.0) > 0.5 THEN 'High deposit concentration' END],
                            lambda x: x IS NOT NULL) AS early_warnings FROM r)
SELECT round(lcr_ratio, 4) AS lcr_ratio,
  CASE WHEN lcr_ratio >= 1.1 THEN 'Low' WHEN lcr_ratio >= 1.0 THEN 'Medium' ELSE 'High' END AS risk_level,
  round(la, 4) AS liquid_assets, round(n30, 4) AS net_30day_outflow, round(hv, 4) AS historical_var,
  round(pv, 4) AS parametric_var, round(es, 4) AS expected_shortfall, round(viol, 4) AS backtesting_violations,
  round(sd, 4) AS flow_volatility, round(skew, 4) AS flow_skewness, round(kurt, 4) AS flow_kurtosis,
  round(posd, 4) AS positive_flow_days, round(larged, 4) AS large_outflow_days,
  round(mn, 4) AS max_single_day_outflow, round(stress, 4) AS avg_outflow_on_stress_days,
  round(tot, 4) AS total_deposits, round(avgb, 4) AS avg_deposit, round(med, 4) AS median_deposit,
  round(gini, 4) AS gini_coefficient, round(t10, 4) AS top_10_pct_share, round(t5, 4) AS top_5_pct_share,
  round(t1, 4) AS top_1_pct_share, {_R7_COLS}, early_warnings,
  round(least(10.0,
    (CASE WHEN COALESCE(lcr_ratio, 1.0) < 1.0 THEN 4.0 WHEN COALESCE(lcr_ratio, 1.0) < 1.1 THEN 2.0 ELSE 0.0 END) * 0.3
    + (CASE WHEN COALESCE(t10, 0.3) > 0.3 THEN least(4.0, (COALESCE(t10, 0.3) - 0.3) / 0.2 * 4.0) ELSE 0.0 END) * 0.25
    + (CASE WHEN COALESCE(sd, 0.0) > 0 THEN least(4.0, COALESCE(sd, 0.0) / 1000000 * 2) ELSE 0.0 END) * 0.2
    + (CASE WHEN COALESCE(viol, 0.0) > 0.05 THEN least(4.0, COALESCE(viol, 0.0) / 0.1 * 4.0) ELSE 0.0 END) * 0.15
    + least(4.0, len(early_warnings) * 1.5) * 0.1), 4) AS overall_risk_score
FROM w, lm"""


@register("r6_liquidity_metrics", _r6_sql())
def r6_liquidity_metrics(spark, sf_dir):
    m = fx.market(spark, sf_dir)
    return round_doubles(R.liquidity_metrics(fx.flows(spark, sf_dir), m, balance_col="balance_end"))


# --------------------------------------------------------------------- P18
@register("p18_latest_classification", fx.sql_with("market") + """,
lm AS (SELECT * FROM market ORDER BY date DESC LIMIT 1)
SELECT date AS as_of,
  CASE WHEN FED_FUNDS_RATE > 5 THEN 'High' WHEN FED_FUNDS_RATE > 1 THEN 'Normal' ELSE 'Low' END AS rate_regime,
  CASE WHEN VIX < 15 THEN 'Low' WHEN VIX < 25 THEN 'Normal' WHEN VIX < 35 THEN 'High' ELSE 'Extreme' END AS volatility_regime,
  CASE WHEN TREASURY_10Y - TREASURY_2Y < 0 THEN 'Inverted' WHEN TREASURY_10Y - TREASURY_2Y < 0.5 THEN 'Flat'
       ELSE 'Normal' END AS curve_shape
FROM lm""")
def p18_latest_classification(spark, sf_dir):
    return RP.classify_latest(fx.market(spark, sf_dir))
