"""Registered queries: reports, remaining features, model-based operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import stats as ST
from ..functions.core import round_doubles
from ..operators import bootstrap as BS
from ..operators import clean as CL
from ..operators import ensemble as EN
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import flows as A
from ..operators import joins as J
from ..operators import ml as ML
from ..operators import reports as RP
from ..operators import risk as R
from ..operators import sampling as SA
from ..operators import tuning as TU
from ..operators import windows as W
from ..schemas import SEGMENTS
from ..session import read_table, reliable_checkpoint
from ..sources import payloads as S
from .q_joins import _unified_sql
from . import q_evaluate, q_risk  # noqa: F401 - their SQL is reused below
from .registry import ORACLE_SQL, register

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _deposits(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    f = fx.flows(spark, sf_dir, c).select("customer_id", "date", "segment", "deposit_flow",
                                          F.col("balance_end").alias("balance"))
    return c, f


# --------------------------------------------------------------------- R9/R10
@register("r9_risk_report", fx.sql_with("flows") + f""",
p AS (SELECT MIN(date) AS start_date, MAX(date) AS end_date, COUNT(*) AS n_observations FROM flows),
l AS (SELECT * FROM ({ORACLE_SQL['r6_liquidity_metrics']})),
c AS (SELECT * EXCLUDE (overall_risk), overall_risk AS concentration_risk FROM ({ORACLE_SQL['r3_concentration_risk']})),
x AS (SELECT p.*, l.*, c.*, list_filter([
    CASE WHEN COALESCE(lcr_ratio, 1.0) < 1.1 THEN 'Increase liquid asset buffer to improve LCR ratio' END,
    CASE WHEN len(early_warnings) > 2 THEN 'Implement enhanced monitoring due to multiple risk flags' END,
    CASE WHEN concentration_risk = 'High' THEN 'Diversify deposit base to reduce concentration risk' END,
    CASE WHEN overall_risk_score > 6 THEN 'Consider stress testing and contingency funding plan review' END],
    lambda r: r IS NOT NULL) AS recs FROM p, l, c)
SELECT * EXCLUDE (recs), CASE WHEN overall_risk_score > 7 THEN 'High' WHEN overall_risk_score > 4 THEN 'Medium' ELSE 'Low' END
    AS summary_risk_level, len(early_warnings) AS n_risk_flags,
  CASE WHEN len(recs) = 0 THEN ['Current risk profile is acceptable, maintain monitoring'] ELSE recs END AS recommendations
FROM x""")
def r9_risk_report(spark, sf_dir):
    """Composition of R6 and R3 plus summary rules."""
    c, f = _deposits(spark, sf_dir)
    return round_doubles(R.risk_report(f, c, fx.market(spark, sf_dir)))


@register("r10_dashboard_alerts", fx.sql_with("market", "flows") + """,
a AS (SELECT 0.15 * COALESCE(SUM(balance_end), 0) / (30 * COALESCE(AVG(CASE WHEN deposit_flow < 0
             THEN abs(deposit_flow) END), 0) + 1e-8) AS lcr_ratio,
             STDDEV_SAMP(deposit_flow) AS flow_std, AVG(deposit_flow) AS flow_mean FROM flows),
v AS (SELECT arg_max(VIX, date) AS vix FROM market)
SELECT round(lcr_ratio, 4) AS lcr_ratio, round(vix, 4) AS vix, round(flow_std, 4) AS flow_std,
  round(flow_mean, 4) AS flow_mean,
  list_filter([CASE WHEN lcr_ratio < 1.0 THEN 'CRITICAL: LCR below regulatory minimum'
                    WHEN lcr_ratio < 1.1 THEN 'WARNING: LCR below buffer threshold' END,
               CASE WHEN vix > 30 THEN 'HIGH STRESS: Elevated market volatility' END,
               CASE WHEN flow_std > 0.5 * flow_mean THEN 'ATTENTION: High deposit flow volatility' END],
              lambda x: x IS NOT NULL) AS alerts
FROM a, v""")
def r10_dashboard_alerts(spark, sf_dir):
    _, f = _deposits(spark, sf_dir)
    return round_doubles(R.alerts(f, fx.market(spark, sf_dir)))


# ------------------------------------------------------------------------ P13
def _p13_sql() -> str:
    rates = ["FED_FUNDS_RATE", "TREASURY_10Y"]
    flows = [f"deposit_flow_sum_{s}" for s in SEGMENTS]
    cols = ["round(FED_FUNDS_RATE * VIX, 4) AS RATE_VIX_interaction",
            "round(FED_FUNDS_RATE / (VIX + 1), 4) AS RATE_VIX_ratio"]
    cols += [f"round({fc} * {rc}, 4) AS {fc}_X_{rc}" for fc in flows for rc in rates]
    cols += [f"round({fc} * VIX, 4) AS {fc}_X_VIX" for fc in flows[:3]]
    return f"WITH u AS ({_unified_sql(rounded=False)}) SELECT date, " + ", ".join(cols) + " FROM u"


@register("p13_market_segment_interactions", _p13_sql())
def p13_market_segment_interactions(spark, sf_dir):
    u = J.unified_timeseries(fx.market(spark, sf_dir), fx.flows(spark, sf_dir))
    d = FE.market_segment_interactions(u, SEGMENTS)
    keep = ["date"] + [c for c in d.columns if c not in u.columns]
    return round_doubles(d.select(*keep))


@register("p13_segment_day_interactions", fx.sql_with("market", "flows") + """,
s AS (SELECT date, segment, round_even(SUM(deposit_flow), 4) AS total FROM flows GROUP BY date, segment),
d AS (SELECT s.*, FED_FUNDS_RATE AS r, VIX AS v, TREASURY_10Y - TREASURY_2Y AS steep FROM s LEFT JOIN market m ON s.date = m.date)
SELECT date, segment, round(r * v, 4) AS RATE_VIX_interaction, round(r / (v + 1), 4) AS RATE_VIX_ratio,
  round(steep * v, 4) AS STEEPNESS_VIX_interaction, round(total * r, 4) AS segment_sum_deposit_flow_X_FED_FUNDS_RATE,
  round(total * v, 4) AS segment_sum_deposit_flow_X_VIX FROM d""")
def p13_segment_day_interactions(spark, sf_dir):
    seg = A.segment_behavioral_features(fx.flows(spark, sf_dir)).select("date", "segment", "segment_sum_deposit_flow")
    m = fx.market(spark, sf_dir)
    d = seg.join(F.broadcast(FE.yield_curve_features(m).select("date", "FED_FUNDS_RATE", "VIX", "YIELD_CURVE_STEEPNESS")), "date", "left")
    out = FE.segment_day_interactions(d)
    return round_doubles(out.select("date", "segment", *out.columns[len(d.columns):]))


# ------------------------------------------------------------------------ P23
@register("p23_behavioral_impacts", fx.sql_with("market", "flows") + """,
m AS (SELECT date, VIX, FED_FUNDS_RATE - LAG(FED_FUNDS_RATE) OVER (ORDER BY date) AS rc FROM market),
e AS (SELECT * FROM m ORDER BY date LIMIT 1),
j AS (SELECT f.customer_id, f.date, f.balance_end AS b, m.date AS md, m.VIX, m.rc FROM flows f
      ASOF LEFT JOIN m ON f.date >= m.date),
k AS (SELECT j.customer_id, j.date, j.b, CASE WHEN j.md IS NULL THEN e.rc ELSE j.rc END AS dr,
             CASE WHEN j.md IS NULL THEN e.VIX ELSE j.VIX END AS vx, c.segment, c.rate_sensitivity AS rs,
             c.loyalty_score AS loy, c.volatility_factor AS vf
      FROM j, e, customers c WHERE j.customer_id = c.customer_id)
SELECT customer_id, date,
  round(CASE WHEN abs(dr) > 0.5 THEN dr * rs * b * 0.1 * 1.5 ELSE dr * rs * b * 0.1 END, 4) AS rate_impact,
  round(b * [0.1, 0.05, -0.1, -0.05, 0.0, 0.1, -0.05, -0.05, 0.05, 0.0, -0.1, 0.15][month(date)]
        * CASE WHEN starts_with(segment, 'RETAIL') THEN 1.5 WHEN segment = 'SME' THEN 1.2 ELSE 1.0 END * 0.01, 4)
    AS seasonal_impact,
  round((CASE WHEN vx > 25 THEN b * 0.002 * (vx - 25) / 10 WHEN vx < 15 THEN -b * 0.001 * (15 - vx) / 5 ELSE 0.0 END)
        * (1 - vf), 4) AS volatility_impact,
  round(CASE WHEN dr < -0.25 THEN b * 0.001 * loy WHEN dr > 0.25 THEN b * 0.0005 * loy ELSE 0.0 END, 4)
    AS loyalty_impact
FROM k""")
def p23_behavioral_impacts(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    m = fx.market(spark, sf_dir)
    m = m.select("date", "VIX", (F.col("FED_FUNDS_RATE") - F.lag("FED_FUNDS_RATE").over(W.spec(["date"])))
                 .alias("FED_FUNDS_RATE_CHANGE"))
    f = fx.flows(spark, sf_dir, c).select("customer_id", "date", F.col("balance_end").alias("balance"))
    d = J.asof_join_market(f, m).join(c.select("customer_id", "segment", "rate_sensitivity", "loyalty_score",
                                               "volatility_factor"), "customer_id")
    out = FE.behavioral_impacts(d)
    return round_doubles(out.select("customer_id", "date", "rate_impact", "seasonal_impact", "volatility_impact",
                                    "loyalty_impact"))


# ------------------------------------------------------------------------ P27
@register("p27_segment_flow_deltas", fx.sql_with("flows") + """,
d AS (SELECT segment, date, SUM(deposit_flow) AS x FROM flows GROUP BY segment, date),
l AS (SELECT segment, date, x, LAG(x) OVER (PARTITION BY segment ORDER BY date) AS px,
             row_number() OVER (PARTITION BY segment ORDER BY date DESC) AS rn FROM d)
SELECT segment, date, round(x, 4) AS current, round(px, 4) AS previous,
  CASE WHEN x - px > 0 THEN 'up' WHEN x - px < 0 THEN 'down' ELSE 'stable' END AS direction,
  round(x - px, 4) AS change, round((x - px) / (px + 1e-8) * 100, 4) AS change_pct
FROM l WHERE rn = 1""")
def p27_segment_flow_deltas(spark, sf_dir):
    d = fx.flows(spark, sf_dir).groupBy("segment", "date").agg(F.sum("deposit_flow").alias("x"))
    w = W.spec(["date"], ["segment"])
    from pyspark.sql import Window
    d = d.select("*", F.lag("x").over(w).alias("px"),
                 F.row_number().over(Window.partitionBy("segment").orderBy(F.col("date").desc())).alias("rn"))
    d = d.where(F.col("rn") == 1)
    direction, chg, pct = RP.metric_delta(F.col("x"), F.col("px"))
    return round_doubles(d.select("segment", "date", F.col("x").alias("current"), F.col("px").alias("previous"),
                                  direction.alias("direction"), chg.alias("change"), pct.alias("change_pct")))


# ------------------------------------------------------------------------- M2
@register("m2_yield_curve_pca")
def m2_yield_curve_pca(spark, sf_dir):
    """Spark ML PCA on centred tenors (sign-fixed): rows-only."""
    m = fx.market(spark, sf_dir)
    return FE.pca_components(m, ["TREASURY_3M", "TREASURY_2Y", "TREASURY_5Y", "TREASURY_10Y"], 3,
                             ["YIELD_LEVEL", "YIELD_SLOPE", "YIELD_CURVATURE"])


# ------------------------------------------------------------------- W16/W17
@register("w16_segment_trend_indicator", fx.sql_with("flows") + """,
d AS (SELECT segment, date, SUM(deposit_flow) AS x FROM flows GROUP BY segment, date),
l AS (SELECT segment, x, x - LAG(x) OVER (PARTITION BY segment ORDER BY date) AS dx,
             row_number() OVER (PARTITION BY segment ORDER BY date DESC) AS rn FROM d),
g AS (SELECT segment, AVG(CASE WHEN rn < 5 THEN dx END) AS t, STDDEV_SAMP(x) AS s, COUNT(*) AS n FROM l GROUP BY segment)
SELECT segment, round(t, 4) AS recent_trend, round(s, 4) AS overall_std,
  CASE WHEN n < 5 THEN 'stable' WHEN t > s * 0.1 THEN 'increasing' WHEN t < -s * 0.1 THEN 'decreasing'
       ELSE 'stable' END AS trend FROM g""")
def w16_segment_trend_indicator(spark, sf_dir):
    d = fx.flows(spark, sf_dir).groupBy("segment", "date").agg(F.sum("deposit_flow").alias("x"))
    return round_doubles(RP.trend_indicator(d, "x", "date", ["segment"]))


_SIMPLE = fx.sql_with("predictions") + """,
m AS (SELECT model_name, sqrt(AVG((actual - predicted) * (actual - predicted))) AS rmse,
             AVG(abs(actual - predicted)) AS mae,
             1 - SUM((actual - predicted) * (actual - predicted)) / (VAR_POP(actual) * COUNT(actual)) AS r2,
             AVG(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100 AS mape
      FROM predictions GROUP BY model_name)"""


@register("w17_rank_models", _SIMPLE + """
SELECT model_name, round(rmse, 4) AS rmse, round(r2, 4) AS r2,
  rank() OVER (ORDER BY rmse) + (COUNT(*) OVER (PARTITION BY rmse) - 1) / 2.0 AS rmse_rank,
  rank() OVER (ORDER BY r2 DESC) + (COUNT(*) OVER (PARTITION BY r2) - 1) / 2.0 AS r2_rank,
  (rank() OVER (ORDER BY rmse) + (COUNT(*) OVER (PARTITION BY rmse) - 1) / 2.0
   + rank() OVER (ORDER BY r2 DESC) + (COUNT(*) OVER (PARTITION BY r2) - 1) / 2.0) / 2 AS mean_rank
FROM m""")
def w17_rank_models(spark, sf_dir):
    m = EV.simple_metrics(fx.predictions(spark, sf_dir), mape_mode="nonzero")
    return round_doubles(RP.rank_models(m))


@register("ev15_radar_scores", _SIMPLE + """
SELECT model_name, """ + ", ".join(
    f"round(CASE WHEN MAX({c}) OVER () > MIN({c}) OVER () THEN "
    + (f"({c} - MIN({c}) OVER ()) / (MAX({c}) OVER () - MIN({c}) OVER ())" if c == "r2" else
       f"1 - ({c} - MIN({c}) OVER ()) / (MAX({c}) OVER () - MIN({c}) OVER ())")
    + f" ELSE 1.0 END, 4) AS {c}_radar" for c in ("rmse", "mae", "mape", "r2")) + " FROM m")
def ev15_radar_scores(spark, sf_dir):
    m = EV.simple_metrics(fx.predictions(spark, sf_dir), mape_mode="nonzero")
    return round_doubles(EV.radar_scores(m))


@register("ev6_residual_halves", fx.sql_with("predictions") + """,
p AS (SELECT model_name, actual - predicted AS r, row_number() OVER (PARTITION BY model_name ORDER BY row_id) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY model_name) AS n FROM predictions)
SELECT model_name, round(AVG(r), 4) AS residual_mean, round(STDDEV_POP(r), 4) AS residual_std,
  round(VAR_POP(CASE WHEN pos >= floor(n / 2) THEN r END) / VAR_POP(CASE WHEN pos < floor(n / 2) THEN r END), 4)
    AS half_variance_ratio
FROM p GROUP BY model_name""")
def ev6_residual_halves(spark, sf_dir):
    return round_doubles(EV.residual_halves(fx.predictions(spark, sf_dir)))


@register("ev13_evaluation_report", f"""
WITH m AS (SELECT * FROM ({ORACLE_SQL['ev1_ev2_prediction_metrics']})), r AS (SELECT * FROM ({ORACLE_SQL['ev5_residual_analysis']})),
s AS (SELECT model_name, r2, mape, directional_accuracy, CASE WHEN r2 >= 0 THEN least(40.0, r2 * 40) ELSE 0 END
    + CASE WHEN mape < 5 THEN 30 WHEN mape < 10 THEN 25 WHEN mape < 20 THEN 15 WHEN mape < 30 THEN 5 ELSE 0 END
    + least(30.0, directional_accuracy * 30 / 100) AS score FROM m)
SELECT s.model_name, r2, mape, directional_accuracy, CAST(round_even(score, 1) AS DOUBLE) AS overall_score,
  CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 60 THEN 'Fair' ELSE 'Poor' END AS rating,
  list_filter([CASE WHEN NOT COALESCE(is_normal, true) THEN 'Residuals not normally distributed' END,
    CASE WHEN autocorrelation_significant THEN 'Significant autocorrelation in residuals' END,
    CASE WHEN likely_heteroscedastic THEN 'Likely heteroscedasticity present' END,
    CASE WHEN outlier_percentage > 5 THEN format('High percentage of outliers ({{:.1f}}%)', outlier_percentage) END],
    lambda x: x IS NOT NULL) AS issues,
  list_filter([CASE WHEN r2 < 0.5 THEN 'Consider feature engineering or different algorithms' END,
    CASE WHEN mape > 20 THEN 'High prediction errors - review model assumptions' END,
    CASE WHEN score < 60 THEN 'Model performance below acceptable threshold' END], lambda x: x IS NOT NULL) AS recommendations
FROM s LEFT JOIN r ON s.model_name = r.model_name""")
def ev13_evaluation_report(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    return round_doubles(EV.evaluation_report(EV.prediction_metrics(p), EV.residual_analysis(p)))


def _ratio_sql(top, bottom, x: str, factor: str) -> str:
    def poly(coefficients):
        text = f"{coefficients[0]:.17e}"
        for c in coefficients[1:]:
            text = f"({text} * {x} + {c:.17e})"
        return text
    return f"{poly(top)} * {factor} / ({poly(bottom)} * {x} + 1)"


_QQ = "[" + ", ".join(f"{0.01 + i * (0.98 / 98):.17e}" for i in range(99)) + "]"


@register("ev14_qq_pairs", fx.sql_with("predictions") + f""",
st AS (SELECT model_name, AVG(actual - predicted) AS m, STDDEV_POP(actual - predicted) AS s FROM predictions GROUP BY model_name),
z AS (SELECT p.model_name, (actual - predicted - m) / s AS z FROM predictions p JOIN st ON p.model_name = st.model_name),
q AS (SELECT model_name, unnest({_QQ}) AS p, unnest(quantile_cont(z, {_QQ})) AS sample_quantile FROM z GROUP BY model_name),
t AS (SELECT *, sqrt(-2 * ln(p)) AS lo, sqrt(-2 * ln(1 - p)) AS hi, (p - 0.5) * (p - 0.5) AS mid FROM q)
SELECT model_name, round(p, 4) AS p, round(sample_quantile, 4) AS sample_quantile,
  round(CASE WHEN p < 0.02425 THEN {_ratio_sql(ST._C, ST._D, "lo", "1")} WHEN p <= 1 - 0.02425 THEN {_ratio_sql(ST._A, ST._B, "mid", "(p - 0.5)")}
             ELSE -({_ratio_sql(ST._C, ST._D, "hi", "1")}) END, 4) AS theoretical_quantile FROM t""")
def ev14_qq_pairs(spark, sf_dir):
    return round_doubles(EV.qq_pairs(fx.predictions(spark, sf_dir)))


@register("ev11_run_stability", fx.sql_with("predictions") + """,
per AS (SELECT row_id, AVG(predicted) AS m, STDDEV_POP(predicted) AS s, MAX(predicted) - MIN(predicted) AS r
        FROM predictions GROUP BY row_id),
a AS (SELECT AVG(s) AS average_std, MAX(s) AS max_std, AVG(r) AS average_range,
             CASE WHEN AVG(m) <> 0 THEN AVG(s) / AVG(m) ELSE 0.0 END AS cv FROM per),
w AS (SELECT row_id, MAX(CASE WHEN model_name = 'a' THEN predicted END) AS a,
             MAX(CASE WHEN model_name = 'b' THEN predicted END) AS b FROM predictions GROUP BY row_id),
c AS (SELECT corr(a, b) AS c FROM w)
SELECT round(average_std, 4) AS average_std, round(max_std, 4) AS max_std, round(average_range, 4) AS average_range,
  round(cv, 4) AS coefficient_of_variation,
  CASE WHEN cv < 0.05 THEN 'Very Stable' WHEN cv < 0.1 THEN 'Stable' WHEN cv < 0.2 THEN 'Moderately Stable'
       ELSE 'Unstable' END AS stability_rating,
  round(c, 4) AS inter_run_corr_min, round(c, 4) AS inter_run_corr_max, round(c, 4) AS inter_run_corr_mean,
  round(0.0, 4) AS inter_run_corr_std
FROM a, c""")
def ev11_run_stability(spark, sf_dir):
    p = fx.predictions(spark, sf_dir).select(F.col("model_name").alias("run"), "row_id", "predicted")
    return round_doubles(RP.run_stability(p, "run", ["a", "b"]))


@register("ev13_performance_report", f"""
WITH m AS (SELECT * FROM ({ORACLE_SQL['ev3_simple_metrics']})), b AS (SELECT * FROM ({ORACLE_SQL['ev10_business_impact']})),
st AS (SELECT stability_rating FROM ({ORACLE_SQL['ev11_run_stability']})),
s AS (SELECT m.*, stability_rating AS rating, CASE WHEN r2 >= 0.8 THEN 50 WHEN r2 >= 0.6 THEN 37.5 WHEN r2 >= 0.4 THEN 25 ELSE 12.5 END
    + CASE stability_rating WHEN 'Very Stable' THEN 20 WHEN 'Stable' THEN 15 WHEN 'Moderately Stable' THEN 10 ELSE 5 END
    + CASE WHEN roi_percentage > 20 THEN 10 WHEN roi_percentage > 0 THEN 7.5 WHEN roi_percentage > -10 THEN 5 ELSE 2.5 END AS score
  FROM m JOIN b ON m.model_name = b.model_name, st),
a AS (SELECT *, list_filter([CASE WHEN r2 < 0.6 THEN '{EV.PERFORMANCE_TEXTS["accuracy"]}' END,
    CASE WHEN mape > 15 THEN '{EV.PERFORMANCE_TEXTS["error"]}' END,
    CASE WHEN rating IN ('Unstable', 'Moderately Stable') THEN '{EV.PERFORMANCE_TEXTS["stability"]}' END], lambda x: x IS NOT NULL) AS advice
  FROM s)
SELECT model_name, rmse, r2, mape,
  CASE WHEN r2 >= 0.8 THEN 'Excellent' WHEN r2 >= 0.6 THEN 'Good' WHEN r2 >= 0.4 THEN 'Fair' ELSE 'Poor' END AS accuracy_rating,
  CAST(score AS DOUBLE) AS overall_score,
  CASE WHEN score >= 85 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 55 THEN 'Fair' ELSE 'Poor' END AS overall_rating,
  CASE WHEN len(advice) > 0 THEN advice ELSE ['{EV.PERFORMANCE_TEXTS["none"]}'] END AS recommendations
FROM a""")
def ev13_performance_report(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    rating = RP.run_stability(p.select(F.col("model_name").alias("run"), "row_id", "predicted"), "run", ["a", "b"])
    models = spark.createDataFrame([(m,) for m, _ in fx.MODEL_VARIANTS], "model_name string")
    stability = models.withColumn("stability_rating", rating.select("stability_rating").scalar())
    return round_doubles(EV.performance_report(EV.simple_metrics(p), business=EV.business_impact(p), stability=stability))


# ---------------------------------------------------------------- ensembles
@register("e4_diversity", fx.sql_with("predictions") + """,
w AS (SELECT row_id, MAX(CASE WHEN model_name = 'a' THEN predicted END) AS a,
             MAX(CASE WHEN model_name = 'b' THEN predicted END) AS b FROM predictions GROUP BY row_id)
SELECT round(corr(a, b), 4) AS corr_a_b,
  round(AVG(abs(a - b)) / (STDDEV_POP(a) + STDDEV_POP(b) + 1e-8), 4) AS q_a_b,
  round(AVG(sqrt((pow(a - (a + b) / 2, 2) + pow(b - (a + b) / 2, 2)) / 2)), 4) AS mean_row_std
FROM w""")
def e4_diversity(spark, sf_dir):
    return round_doubles(ML.diversity(fx.predictions(spark, sf_dir), ["a", "b"]))


@register("e5_dynamic_weights", fx.sql_with("predictions") + """,
p AS (SELECT model_name, actual, predicted, row_number() OVER (PARTITION BY model_name ORDER BY row_id) - 1 AS pos,
             COUNT(*) OVER (PARTITION BY model_name) AS n FROM predictions),
d AS (SELECT model_name, floor((pos - greatest(floor(n / 2), 100)) / 20) AS batch, actual, predicted FROM p
      WHERE pos >= greatest(floor(n / 2), 100)),
g AS (SELECT batch, model_name, COUNT(*) AS rows, sqrt(AVG(pow(actual - predicted, 2))) AS rmse FROM d
      GROUP BY batch, model_name HAVING COUNT(*) >= 10),
i AS (SELECT batch, model_name, 1 / (rmse + 1e-8) AS inv FROM g)
SELECT batch, model_name, round(inv / SUM(inv) OVER (PARTITION BY batch), 4) AS weight FROM i""")
def e5_dynamic_weights(spark, sf_dir):
    return round_doubles(ML.dynamic_weights(fx.predictions(spark, sf_dir)))


@register("e2_optimized_weights", fx.sql_with("predictions") + """,
e AS (SELECT a.actual - a.predicted AS ea, b.actual - b.predicted AS eb FROM predictions a JOIN predictions b USING (row_id)
      WHERE a.model_name = 'a' AND b.model_name = 'b'),
g AS (SELECT AVG(ea * ea) AS aa, AVG(eb * eb) AS bb, AVG(ea * eb) AS ab FROM e),
w AS (SELECT greatest(0.0, least(1.0, (bb - ab) / (aa + bb - 2 * ab))) AS wa FROM g)
SELECT 'a' AS model_name, round(wa, 4) AS weight FROM w UNION ALL SELECT 'b', round(1 - wa, 4) FROM w""")
def e2_optimized_weights(spark, sf_dir):
    """Simplex QP on the k x k error Gram matrix (driver math on k = 2, where
    the minimum has a closed form)."""
    p = fx.predictions(spark, sf_dir)
    w = ML.optimize_weights(ML.error_gram(p, ["a", "b"]))
    return round_doubles(p.select("model_name").distinct().select(
        "model_name", F.when(F.col("model_name") == "a", w[0]).otherwise(w[1]).alias("weight")))


# ------------------------------------------------------------------- models
def _flow_features(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    f = fx.flows(spark, sf_dir, c).select("customer_id", "date", "segment", "deposit_flow")
    m = fx.market(spark, sf_dir).select("date", "FED_FUNDS_RATE", "VIX")
    d = W.lag_features(f.join(F.broadcast(m), "date", "left"), ["deposit_flow"], [1, 2], ["date"], ["customer_id"])
    # written once: fits read their rows several times
    d = reliable_checkpoint(d.select("*", F.concat_ws("|", "customer_id", "date").alias("row_id")))
    return d, ["deposit_flow_lag_1", "deposit_flow_lag_2", "FED_FUNDS_RATE", "VIX"]


@register("t2_gbt_flows")
def t2_gbt_flows(spark, sf_dir):
    """Spark ML gradient-boosted trees: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    return ML.predict_long(ML.fit_regressor(d, feats, "deposit_flow", "gbt"), d, feats, "deposit_flow", "gbt")


@register("t3_per_segment_models")
def t3_per_segment_models(spark, sf_dir):
    """One fit per segment with a mean fallback: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    cutoff = F.lit(ML.date_cutoff(d)).cast("date")
    train, test = d.where(F.col("date") < cutoff), d.where(F.col("date") >= cutoff)
    return ML.per_segment_models(train, test, feats, "deposit_flow", SEGMENTS, kind="random_forest")


@register("t4_risk_classifier")
def t4_risk_classifier(spark, sf_dir):
    """5-class random forest classifier: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    model, _ = ML.fit_risk_classifier(d, feats, "deposit_flow")
    return model.transform(d.fillna(0.0, subset=feats)).select("row_id", "prediction")


@register("t6_tree_intervals")
def t6_tree_intervals(spark, sf_dir):
    """Per-tree spread of a random forest: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    model = ML.fit_regressor(d, feats, "deposit_flow", "random_forest")
    return ML.tree_intervals(model, d.select("row_id", *feats), feats).select("row_id", "prediction", "lower",
                                                                              "upper")


@register("t7_bootstrap_intervals")
def t7_bootstrap_intervals(spark, sf_dir):
    """Row intervals from 100 weighted refits of a linear model: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    return BS.bootstrap_intervals(BS.replicate_models(d, feats, "deposit_flow"), d, feats)


@register("ev4_cross_validation")
def ev4_cross_validation(spark, sf_dir):
    """Scores over five expanding folds of two kinds of models: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    return TU.cross_validate(d, feats, "deposit_flow", ["date", "customer_id"],
                             {"linear": ("linear", {}), "decision_tree": ("decision_tree", {"maxDepth": 5})})


@register("t1_grid_search")
def t1_grid_search(spark, sf_dir):
    """Random forests of four settings over five folds: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    return TU.grid_search(d, feats, "deposit_flow", ["date", "customer_id"], "random_forest",
                          {"numTrees": [5, 10], "maxDepth": [3, 5]})


@register("e7_ensemble_pipeline")
def e7_ensemble_pipeline(spark, sf_dir):
    """Scores of two components and three ensemble types on validation and test rows: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    return EN.ensemble_pipeline(d, feats, "deposit_flow", ["date", "customer_id"], {
        "random_forest": ("random_forest", {"numTrees": 20, "maxDepth": 5}), "gbt": ("gbt", {"maxIter": 10, "maxDepth": 3})}, n_splits=3).scores


@register("ev7_bootstrap_stability")
def ev7_bootstrap_stability(spark, sf_dir):
    """Spread of scores and importances over 30 refits of a tree, a share of
    0.8 of the rows drawn in each: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    models = BS.replicate_models(d, feats, "deposit_flow", n=30, rate=0.8, kind="decision_tree")
    return BS.stability(BS.replicate_scores(models, d, feats, "deposit_flow"),
                        BS.replicate_importances(spark, models, feats, "decision_tree"))


@register("t9_combined_importances")
def t9_combined_importances(spark, sf_dir):
    """Average, weighted and greatest importance over three tree models: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    sizes = {"decision_tree": {}, "random_forest": {"numTrees": 20}, "gbt": {"maxIter": 10}}
    imp = None
    for kind, params in sizes.items():
        models = BS.replicate_models(d, feats, "deposit_flow", n=1, kind=kind, **params)
        one = BS.replicate_importances(spark, models, feats, kind)
        imp = one if imp is None else imp.unionByName(one)
    return BS.combined_importance(imp, {"random_forest": 0.4, "gbt": 0.6})


@register("t8_expanding_window_stability")
def t8_expanding_window_stability(spark, sf_dir):
    """Fits per expanding fold: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    return ML.expanding_window_stability(d, feats, "deposit_flow", ["date", "customer_id"], 5)


@register("l8_feature_importance_metrics")
def l8_feature_importance_metrics(spark, sf_dir):
    """T9 importances of a fitted forest, L8 summary and P25 categories: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    model = ML.fit_regressor(d, feats, "deposit_flow", "random_forest")
    imp = ML.feature_importance(model, feats, "random_forest", spark)
    summ, ranked = RP.feature_importance_metrics(imp.select("feature", "importance"))
    return ranked.select("*", RP.feature_category(F.col("feature")).alias("category"))


@register("l8_feature_importance_summary")
def l8_feature_importance_summary(spark, sf_dir):
    """The summary row of L8 over a fitted forest: rows-only."""
    d, feats = _flow_features(spark, sf_dir)
    imp = ML.feature_importance(ML.fit_regressor(d, feats, "deposit_flow", "random_forest"), feats, "random_forest", spark)
    return RP.feature_importance_metrics(imp.select("feature", "importance"))[0]


# ----------------------------------------------------------------- sources
@register("s11_series_to_wide", fx.sql_with("market") + """,
l AS (SELECT date, 'FED_FUNDS_RATE' AS series, FED_FUNDS_RATE AS value FROM market
      UNION ALL SELECT date, 'VIX', VIX FROM market),
d AS (SELECT date, MAX(CASE WHEN series = 'FED_FUNDS_RATE' THEN value END) AS FED_FUNDS_RATE,
             MAX(CASE WHEN series = 'VIX' THEN value END) AS VIX FROM l GROUP BY date)
SELECT date,
  round(last_value(FED_FUNDS_RATE IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS FED_FUNDS_RATE,
  round(last_value(VIX IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS VIX
FROM d""")
def s11_series_to_wide(spark, sf_dir):
    m = fx.market(spark, sf_dir)
    long = (m.select("date", F.lit("FED_FUNDS_RATE").alias("series"), F.col("FED_FUNDS_RATE").alias("value"))
             .unionByName(m.select("date", F.lit("VIX").alias("series"), F.col("VIX").alias("value"))))
    return round_doubles(S.wide_from_series(long, ["FED_FUNDS_RATE", "VIX"]))


@register("a22_table_sizes", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES))
def a22_table_sizes(spark, sf_dir):
    parts = [read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table_name"), "row_count") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("c8_number_formatting", fx.sql_with("customers") + """,
x AS (SELECT customer_id, balance_avg * 1000 AS x FROM customers),
s AS (SELECT customer_id, x, CASE WHEN abs(x) >= 1e12 THEN 1e12 WHEN abs(x) >= 1e9 THEN 1e9 WHEN abs(x) >= 1e6 THEN 1e6
        WHEN abs(x) >= 1e3 THEN 1e3 ELSE 1 END AS unit FROM x)
SELECT customer_id, CASE unit WHEN 1e12 THEN format('{:.1f}T', CAST(x / 1e12 AS DOUBLE))
  WHEN 1e9 THEN format('{:.1f}B', CAST(x / 1e9 AS DOUBLE)) WHEN 1e6 THEN format('{:.1f}M', CAST(x / 1e6 AS DOUBLE))
  WHEN 1e3 THEN format('{:.1f}K', CAST(x / 1e3 AS DOUBLE)) ELSE format('{:.0f}', CAST(x AS DOUBLE)) END AS balance_text
FROM s""")
def c8_number_formatting(spark, sf_dir):
    c = fx.customers(spark, sf_dir)
    return c.select("customer_id", ST.human_number(F.col("balance_avg") * 1000).alias("balance_text"))


# ------------------------------------------------- frames, unions and orders
def _fill_sql(c: str) -> str:
    """Linear interpolation by row, then forward and backward fill."""
    past = "ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ahead = "ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    at = f"CASE WHEN {c} IS NOT NULL THEN rn END"
    a, b = f"last_value({c} IGNORE NULLS) OVER ({past})", f"first_value({c} IGNORE NULLS) OVER ({ahead})"
    i, j = f"last_value({at} IGNORE NULLS) OVER ({past})", f"first_value({at} IGNORE NULLS) OVER ({ahead})"
    return f"COALESCE({c}, {a} + ({b} - {a}) * (rn - {i}) / NULLIF({j} - {i}, 0), {a}, {b})"


@register("p4_interpolate_frame", fx.sql_with("market_gappy") + """,
n AS (SELECT *, CAST(row_number() OVER (ORDER BY date) AS DOUBLE) AS rn FROM market_gappy)
SELECT date, """ + ", ".join(f"round({_fill_sql(c)}, 4) AS {c}" for c in ("FED_FUNDS_RATE", "TREASURY_10Y", "VIX")) + """
FROM n""")
def p4_interpolate_frame(spark, sf_dir):
    m = fx.market_gappy(spark, sf_dir).select("date", "FED_FUNDS_RATE", "TREASURY_10Y", "VIX")
    return round_doubles(CL.handle_missing_frame(m, "interpolate"))


@register("p4_zero_fill_frame", fx.sql_with("market_gappy") + """
SELECT date, round(COALESCE(FED_FUNDS_RATE, 0), 4) AS FED_FUNDS_RATE, round(COALESCE(VIX, 0), 4) AS VIX FROM market_gappy""")
def p4_zero_fill_frame(spark, sf_dir):
    m = fx.market_gappy(spark, sf_dir).select("date", "FED_FUNDS_RATE", "VIX")
    return round_doubles(CL.handle_missing_frame(m, "zero_fill"))


@register("m1_minmax_scaling", fx.sql_with("customers") + """,
p AS (SELECT MIN(loyalty_score) AS m, MAX(loyalty_score) - MIN(loyalty_score) AS s FROM customers)
SELECT customer_id, round((loyalty_score - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END, 4) AS loyalty_score
FROM customers, p""")
def m1_minmax_scaling(spark, sf_dir):
    c = fx.customers(spark, sf_dir).select("customer_id", "loyalty_score")
    return round_doubles(FE.apply_scaler(c, FE.fit_scaler(c, ["loyalty_score"], "minmax"), ["loyalty_score"]))


@register("u1_union_all", """
SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance, NULL AS price FROM customer
UNION ALL SELECT 'order', o_orderkey, NULL, o_totalprice FROM orders""")
def u1_union_all(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    o = read_table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return SA.union_all([c, o])


@register("l5_two_way_split", fx.sql_with("flows") + """
SELECT customer_id, date, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM (SELECT customer_id, date, row_number() OVER (ORDER BY date, customer_id) - 1 AS pos, COUNT(*) OVER () AS n FROM flows)""")
def l5_two_way_split(spark, sf_dir):
    f = fx.flows(spark, sf_dir).select("customer_id", "date")
    return SA.chronological_split(f, ["date", "customer_id"], (0.8,))


@register("l7_tornado_order", fx.sql_with("customers") + """,
s AS (SELECT segment, AVG(loyalty_score) AS v FROM customers GROUP BY segment)
SELECT segment, round(v, 4) AS v, round(v - 0.5, 4) AS delta FROM s""")
def l7_tornado_order(spark, sf_dir):
    s = fx.customers(spark, sf_dir).groupBy("segment").agg(F.avg("loyalty_score").alias("v"))
    return round_doubles(RP.tornado_order(s, "segment", "v", 0.5))
