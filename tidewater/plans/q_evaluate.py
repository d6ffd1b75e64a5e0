"""Registered queries: model evaluation on the predictions fixture."""

from __future__ import annotations

from .. import fixtures as fx
from ..functions.core import round_doubles
from ..operators import evaluate as EV
from .registry import register

P = fx.sql_with("predictions")

_BASE = P + """,
p AS (SELECT model_name, row_id, date, actual AS y, predicted AS yh, actual - predicted AS r,
             LAG(actual) OVER w AS yp, LAG(predicted) OVER w AS yhp,
             row_number() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY model_name) AS n
      FROM predictions WINDOW w AS (PARTITION BY model_name ORDER BY row_id))"""


@register("ev1_ev2_prediction_metrics", _BASE + """
SELECT model_name, COUNT(*) AS sample_size, round(AVG(r * r), 4) AS mse, round(sqrt(AVG(r * r)), 4) AS rmse,
  round(AVG(abs(r)), 4) AS mae, round(1 - SUM(r * r) / (VAR_POP(y) * COUNT(*)), 4) AS r2,
  round(1 - VAR_POP(r) / VAR_POP(y), 4) AS explained_variance,
  round(AVG(CASE WHEN y <> 0 THEN abs(r / y) END) * 100, 4) AS mape,
  round(COALESCE(AVG(CASE WHEN yp IS NOT NULL THEN CAST(sign(y - yp) = sign(yh - yhp) AS DOUBLE) END) * 100, 0.0), 4)
    AS directional_accuracy,
  round(AVG(r), 4) AS mean_residual, round(STDDEV_POP(r), 4) AS std_residual, round(MAX(abs(r)), 4) AS max_error,
  round(quantile_cont(abs(r), 0.5), 4) AS median_abs_error,
  round(AVG(CAST(abs(r) <= 0.05 * abs(y) AS DOUBLE)) * 100, 4) AS hit_rate_5pct,
  round(AVG(CAST(abs(r) <= 0.1 * abs(y) AS DOUBLE)) * 100, 4) AS hit_rate_10pct,
  round(AVG(CAST(abs(r) <= 0.2 * abs(y) AS DOUBLE)) * 100, 4) AS hit_rate_20pct,
  round(AVG(yh - y), 4) AS bias,
  round(CASE WHEN AVG(y) <> 0 THEN AVG(yh - y) / AVG(y) * 100 ELSE 0.0 END, 4) AS bias_percentage,
  round(STDDEV_POP(y), 4) AS actual_volatility, round(STDDEV_POP(yh), 4) AS predicted_volatility,
  round(CASE WHEN STDDEV_POP(y) <> 0 THEN STDDEV_POP(yh) / STDDEV_POP(y) ELSE 0.0 END, 4) AS volatility_ratio,
  round(corr(y, yh), 4) AS correlation
FROM p GROUP BY model_name""")
def ev1_ev2_prediction_metrics(spark, sf_dir):
    return round_doubles(EV.prediction_metrics(fx.predictions(spark, sf_dir)))


@register("ev3_simple_metrics", P + """
SELECT model_name, round(AVG((actual - predicted) * (actual - predicted)), 4) AS mse,
  round(sqrt(AVG((actual - predicted) * (actual - predicted))), 4) AS rmse,
  round(AVG(abs(actual - predicted)), 4) AS mae,
  round(1 - SUM((actual - predicted) * (actual - predicted)) / (VAR_POP(actual) * COUNT(actual)), 4) AS r2,
  round(AVG(abs((actual - predicted) / (actual + 1e-8))) * 100, 4) AS mape
FROM predictions GROUP BY model_name""")
def ev3_simple_metrics(spark, sf_dir):
    return round_doubles(EV.simple_metrics(fx.predictions(spark, sf_dir)))


def _err_sql(unit: str) -> str:
    return P + f"""
SELECT model_name, CAST(date_trunc('{unit}', date) AS DATE) AS period,
  round(round_even(AVG(actual - predicted), 4), 4) AS error_mean,
  round(round_even(STDDEV_SAMP(actual - predicted), 4), 4) AS error_std,
  round(round_even(AVG(abs(actual - predicted)), 4), 4) AS abs_error_mean, COUNT(actual - predicted) AS actual_count
FROM predictions GROUP BY model_name, period"""


@register("a11_monthly_error_table", _err_sql("month"))
def a11_monthly_error_table(spark, sf_dir):
    return round_doubles(EV.error_table(fx.predictions(spark, sf_dir), "month"))


@register("a11_quarterly_error_table", _err_sql("quarter"))
def a11_quarterly_error_table(spark, sf_dir):
    return round_doubles(EV.error_table(fx.predictions(spark, sf_dir), "quarter"))


@register("w24_performance_trend", _BASE + """,
g AS (SELECT model_name, COUNT(*) AS n, AVG(CASE WHEN pos < floor(n / 2) THEN abs(r) END) AS f,
             AVG(CASE WHEN pos >= floor(n / 2) THEN abs(r) END) AS s FROM p GROUP BY model_name)
SELECT model_name, round(f, 4) AS first_half_mae, round(s, 4) AS second_half_mae,
  round((f - s) / f * 100, 4) AS improvement_percentage,
  CASE WHEN (f - s) / f * 100 > 5 THEN 'improving' WHEN (f - s) / f * 100 < -5 THEN 'deteriorating'
       ELSE 'stable' END AS trend
FROM g WHERE n >= 60""")
def w24_performance_trend(spark, sf_dir):
    return round_doubles(EV.performance_trend(fx.predictions(spark, sf_dir)))


@register("ev5_residual_analysis", _BASE + """,
s AS (SELECT model_name, COUNT(r) AS n, AVG(r) AS mean, STDDEV_POP(r) AS std, MIN(r) AS mn, MAX(r) AS mx,
             quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.5) AS med, quantile_cont(r, 0.75) AS q75,
             CASE WHEN COUNT(r) > 10 THEN corr(r, yp - yhp) END AS lag_1
      FROM p GROUP BY model_name),
mo AS (SELECT p.model_name, AVG(pow(r - s.mean, 2)) AS m2, AVG(pow(r - s.mean, 3)) AS m3, AVG(pow(r - s.mean, 4)) AS m4,
              COUNT(CASE WHEN abs((r - s.mean) / s.std) > 2.5 THEN 1 END) AS oc
       FROM p JOIN s ON p.model_name = s.model_name GROUP BY p.model_name),
gv AS (SELECT model_name, floor(pos / floor(n / 3)) AS g, VAR_POP(r) AS v, COUNT(*) AS c FROM p
       WHERE pos < floor(n / 3) * 3 GROUP BY model_name, g),
vr AS (SELECT model_name, CASE WHEN MIN(c) > 1 THEN MAX(v) / MIN(v) END AS vr FROM gv GROUP BY model_name),
k AS (SELECT s.*, m3 / pow(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku, oc, vr.vr
      FROM s JOIN mo ON s.model_name = mo.model_name LEFT JOIN vr ON s.model_name = vr.model_name)
SELECT model_name, n, round(mean, 4) AS mean, round(std, 4) AS std, round(mn, 4) AS min, round(mx, 4) AS max,
  round(q25, 4) AS q25, round(med, 4) AS median, round(q75, 4) AS q75, round(sk, 4) AS skewness,
  round(ku, 4) AS kurtosis, round(n / 6.0 * (sk * sk + ku * ku / 4), 4) AS jarque_bera,
  round(exp(-(n / 6.0 * (sk * sk + ku * ku / 4)) / 2), 4) AS jarque_bera_p,
  exp(-(n / 6.0 * (sk * sk + ku * ku / 4)) / 2) > 0.05 AS is_normal, round(lag_1, 4) AS lag_1,
  abs(lag_1) > 0.1 AS autocorrelation_significant, round(vr, 4) AS variance_ratio,
  vr > 2.0 AS likely_heteroscedastic, oc AS outlier_count, round(oc / n * 100, 4) AS outlier_percentage
FROM k""")
def ev5_residual_analysis(spark, sf_dir):
    return round_doubles(EV.residual_analysis(fx.predictions(spark, sf_dir)))


_SIMPLE = P + """,
m AS (SELECT model_name, sqrt(AVG((actual - predicted) * (actual - predicted))) AS rmse,
             AVG(abs(actual - predicted)) AS mae,
             1 - SUM((actual - predicted) * (actual - predicted)) / (VAR_POP(actual) * COUNT(actual)) AS r2,
             AVG(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100 AS mape
      FROM predictions GROUP BY model_name)"""


@register("ev8_compare_models", _SIMPLE + """
SELECT model_name, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2, round(mape, 4) AS mape,
       row_number() OVER (ORDER BY rmse ASC NULLS LAST, model_name) AS rank FROM m""")
def ev8_compare_models(spark, sf_dir):
    m = EV.simple_metrics(fx.predictions(spark, sf_dir), mape_mode="nonzero")
    return round_doubles(EV.compare_models(m))


@register("ev9_comparative_performance", _SIMPLE + """,
z AS (SELECT model_name,
        1 - CASE WHEN MAX(rmse) OVER () > MIN(rmse) OVER () THEN (rmse - MIN(rmse) OVER ()) / (MAX(rmse) OVER () - MIN(rmse) OVER ()) ELSE 1.0 END AS rmse_score,
        1 - CASE WHEN MAX(mae) OVER () > MIN(mae) OVER () THEN (mae - MIN(mae) OVER ()) / (MAX(mae) OVER () - MIN(mae) OVER ()) ELSE 1.0 END AS mae_score,
        CASE WHEN MAX(r2) OVER () > MIN(r2) OVER () THEN (r2 - MIN(r2) OVER ()) / (MAX(r2) OVER () - MIN(r2) OVER ()) ELSE 1.0 END AS r2_score,
        1 - CASE WHEN MAX(mape) OVER () > MIN(mape) OVER () THEN (mape - MIN(mape) OVER ()) / (MAX(mape) OVER () - MIN(mape) OVER ()) ELSE 1.0 END AS mape_score
      FROM m)
SELECT model_name, round(rmse_score, 4) AS rmse_score, round(mae_score, 4) AS mae_score, round(r2_score, 4) AS r2_score,
  round(mape_score, 4) AS mape_score, round((rmse_score + mae_score + r2_score + mape_score) / 4, 4) AS overall_score,
  row_number() OVER (ORDER BY (rmse_score + mae_score + r2_score + mape_score) / 4 DESC, model_name) AS rank
FROM z""")
def ev9_comparative_performance(spark, sf_dir):
    m = EV.simple_metrics(fx.predictions(spark, sf_dir), mape_mode="nonzero")
    return round_doubles(EV.comparative_performance(m))


@register("ev10_business_impact", P + """,
e AS (SELECT model_name, actual, predicted, abs(predicted - actual) AS e FROM predictions),
q AS (SELECT model_name, quantile_cont(e, 0.95) AS p95 FROM e GROUP BY model_name),
g AS (SELECT e.model_name, SUM(predicted) AS tp, SUM(actual) AS ta, SUM(e) AS te, AVG(e) AS ae, MAX(e) AS me,
             MAX(q.p95) AS p95, AVG(CASE WHEN e > q.p95 THEN e END) AS es
      FROM e JOIN q ON e.model_name = q.model_name GROUP BY e.model_name)
SELECT model_name, round(tp, 4) AS total_prediction_value, round(ta, 4) AS total_actual_value,
  round(tp - ta, 4) AS value_difference, round(te, 4) AS total_error_cost, round(ae, 4) AS average_error_cost,
  round(me, 4) AS max_error_cost, round(p95, 4) AS value_at_risk_95, round(es, 4) AS expected_shortfall,
  round(CASE WHEN te > 0 THEN (ta * 0.01 - te) / te * 100 ELSE 0.0 END, 4) AS roi_percentage
FROM g""")
def ev10_business_impact(spark, sf_dir):
    return round_doubles(EV.business_impact(fx.predictions(spark, sf_dir)))


@register("ev14_error_percentile_bounds", P + """
SELECT model_name, """ + ", ".join(
    f"round(quantile_cont(abs(actual - predicted), {q}), 4) AS p{int(q * 100)}" for q in (0.5, 0.68, 0.95, 0.99)) + """
FROM predictions GROUP BY model_name""")
def ev14_error_percentile_bounds(spark, sf_dir):
    return round_doubles(EV.error_percentile_bounds(fx.predictions(spark, sf_dir)))
