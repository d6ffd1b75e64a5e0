"""Model evaluation on the long predictions table (EV1-EV15, A11, W24).

Input: ``(model_name, row_id, [date], actual, predicted)``.  Metrics are
one grouped aggregation per model.  Quantities that depend on row order
(directional accuracy, halves, contiguous groups, lag-1 autocorrelation)
use distributed global positions (H1) instead of a one-task window: a
model's rows span the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import np_round, safe_div
from ..functions.stats import fixed1
from ..plans.global_order import (exact_quantiles, global_lag, join_groups, long_quantiles, value_count_ladder,
                                  with_global_position)

KEY = "model_name"


def positioned(preds: DataFrame, by: str = KEY, order_by: str = "row_id") -> DataFrame:
    """Adds ``pos`` (0-based within the model, in ``order_by`` order) and
    ``n`` (rows of the model), with the previous row's actual/predicted."""
    p = with_global_position(preds, [by, order_by], "gpos")
    start = p.groupBy(by).agg(F.min("gpos").alias("__s"), F.count(F.lit(1)).alias("n"))
    p = join_groups(p, start, [by])
    p = global_lag(p, ["actual", "predicted"], "gpos", same=[by])
    return p.select(*preds.columns, (F.col("gpos") - F.col("__s")).alias("pos"), "n",
                    "actual_prev", "predicted_prev")


# ------------------------------------------------------------------------ EV1/2
def prediction_metrics(preds: DataFrame, by: str = KEY, order_by: str = "row_id") -> DataFrame:
    """Regression and accuracy metrics per model: mse, rmse, mae, r2,
    explained variance, mape (actual <> 0, NULL if none), directional
    accuracy (% of consecutive pairs whose changes have equal sign),
    residual mean/std(pop)/max|.|/median|.|, hit rates within 5/10/20 %,
    bias and bias %, volatility (pop std) of both and their ratio, corr."""
    p = positioned(preds, by, order_by)
    y, yh = F.col("actual"), F.col("predicted")
    res = y - yh
    dy, dp = F.signum(y - F.col("actual_prev")), F.signum(yh - F.col("predicted_prev"))
    agg = p.groupBy(by).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.avg(res * res).alias("mse"), F.avg(F.abs(res)).alias("mae"),
        F.sum(res * res).alias("__ssr"), F.var_pop(y).alias("__vy"), F.var_pop(res).alias("__vr"),
        (F.avg(F.when(y != 0, F.abs(res / y))) * 100).alias("mape"),
        (F.avg(F.when(F.col("actual_prev").isNotNull(), (dy == dp).cast("double"))) * 100)
        .alias("directional_accuracy"),
        F.avg(res).alias("mean_residual"), F.stddev_pop(res).alias("std_residual"),
        F.max(F.abs(res)).alias("max_error"),
        *[(F.avg((F.abs(res) <= t * F.abs(y)).cast("double")) * 100).alias(f"hit_rate_{int(t * 100)}pct")
          for t in (0.05, 0.10, 0.20)],
        F.avg(yh - y).alias("bias"), F.avg(y).alias("__my"),
        F.stddev_pop(y).alias("actual_volatility"), F.stddev_pop(yh).alias("predicted_volatility"),
        F.corr(y, yh).alias("correlation"))
    med = exact_quantiles(p.select(by, F.abs(res).alias("__ae")), "__ae", [0.5], ["median_abs_error"], by=[by])
    n = F.col("sample_size")
    return agg.join(med, by).select(
        by, "sample_size", "mse", F.sqrt("mse").alias("rmse"), "mae",
        (1 - F.col("__ssr") / (F.col("__vy") * n)).alias("r2"),
        (1 - F.col("__vr") / F.col("__vy")).alias("explained_variance"), "mape",
        F.coalesce(F.col("directional_accuracy"), F.lit(0.0)).alias("directional_accuracy"),
        "mean_residual", "std_residual", "max_error", "median_abs_error",
        "hit_rate_5pct", "hit_rate_10pct", "hit_rate_20pct", "bias",
        F.when(F.col("__my") != 0, F.col("bias") / F.col("__my") * 100).otherwise(0.0).alias("bias_percentage"),
        "actual_volatility", "predicted_volatility",
        F.when(F.col("actual_volatility") != 0, F.col("predicted_volatility") / F.col("actual_volatility"))
        .otherwise(0.0).alias("volatility_ratio"), "correlation")


def simple_metrics(preds: DataFrame, by: str | Sequence[str] = KEY, mape_mode: str = "epsilon") -> DataFrame:
    """EV3: mse/rmse/mae/r2 and mape over (y + 1e-8) (``epsilon``) or y <> 0;
    r2 is NULL where all actual values are equal."""
    y, yh = F.col("actual"), F.col("predicted")
    res = y - yh
    mape = (F.avg(F.abs(res / (y + 1e-8))) if mape_mode == "epsilon" else F.avg(F.when(y != 0, F.abs(res / y)))) * 100
    return preds.groupBy(by).agg(F.avg(res * res).alias("mse"), F.sqrt(F.avg(res * res)).alias("rmse"),
                                 F.avg(F.abs(res)).alias("mae"),
                                 (1 - safe_div(F.sum(res * res), F.var_pop(y) * F.count(y))).alias("r2"),
                                 mape.alias("mape"))


# -------------------------------------------------------------------------- A11
def error_table(preds: DataFrame, period: str = "month", by: str = KEY) -> DataFrame:
    """Per model and calendar period: error (actual - predicted) mean and
    sample std, mean abs error, count; rounded half-even to 4."""
    e = F.col("actual") - F.col("predicted")
    unit = {"month": "month", "quarter": "quarter"}[period]
    return (preds.select(by, F.date_trunc(unit, F.col("date")).cast("date").alias("period"), e.alias("__e"))
                 .groupBy(by, "period")
                 .agg(np_round(F.avg("__e"), 4).alias("error_mean"), np_round(F.stddev_samp("__e"), 4).alias("error_std"),
                      np_round(F.avg(F.abs("__e")), 4).alias("abs_error_mean"), F.count("__e").alias("actual_count")))


# -------------------------------------------------------------------------- W24
def performance_trend(preds: DataFrame, by: str = KEY, order_by: str = "row_id", min_rows: int = 60) -> DataFrame:
    """First-half vs second-half MAE by position; > 5 % improving, < -5 %
    deteriorating; models with fewer than ``min_rows`` rows are omitted."""
    p = positioned(preds, by, order_by)
    ae = F.abs(F.col("actual") - F.col("predicted"))
    first = F.col("pos") < F.floor(F.col("n") / 2)
    g = p.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), F.avg(F.when(first, ae)).alias("first_half_mae"),
                          F.avg(F.when(~first, ae)).alias("second_half_mae")).where(F.col("__n") >= min_rows)
    imp = (F.col("first_half_mae") - F.col("second_half_mae")) / F.col("first_half_mae") * 100
    return g.select(by, "first_half_mae", "second_half_mae", imp.alias("improvement_percentage"),
                    F.when(imp > 5, "improving").when(imp < -5, "deteriorating").otherwise("stable").alias("trend"))


# -------------------------------------------------------------------------- EV5
def residual_analysis(preds: DataFrame, by: str = KEY, order_by: str = "row_id") -> DataFrame:
    """Residual statistics, Jarque-Bera (p = exp(-JB/2), 2 d.o.f.),
    population skew / excess kurtosis, lag-1 autocorrelation (n > 10),
    variance ratio of three contiguous equal groups (remainder dropped),
    count and share of |r / std| > 2.5."""
    p = positioned(preds, by, order_by)
    r = F.col("actual") - F.col("predicted")
    rp = F.col("actual_prev") - F.col("predicted_prev")
    size = F.floor(F.col("n") / 3)
    grp = F.when(F.col("pos") < size * 3, F.floor(F.col("pos") / size))
    d = p.select(by, r.alias("r"), rp.alias("rp"), grp.alias("g"), "n")
    stats = d.groupBy(by).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"),
                              F.min("r").alias("min"), F.max("r").alias("max"),
                              F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis"),
                              F.when(F.count("r") > 10, F.corr("r", "rp")).alias("lag_1"))
    gv = d.where(F.col("g").isNotNull()).groupBy(by, "g").agg(F.var_pop("r").alias("v"), F.count("r").alias("c"))
    ratio = gv.groupBy(by).agg(F.when(F.min("c") > 1, F.max("v") / F.min("v")).alias("variance_ratio"))
    q = exact_quantiles(d, "r", [0.25, 0.5, 0.75], ["q25", "median", "q75"], by=[by])
    s = stats.join(ratio, by, "left").join(q, by, "left")
    jb = F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4)
    out = join_groups(d, s.select(by, "mean", "std"), [by]).groupBy(by).agg(
        F.count(F.when(F.abs((F.col("r") - F.col("mean")) / F.col("std")) > 2.5, 1)).alias("outlier_count"))
    return s.join(out, by).select(
        by, "n", "mean", "std", "min", "max", "q25", "median", "q75", "skewness", "kurtosis",
        jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jarque_bera_p"), (F.exp(-jb / 2) > 0.05).alias("is_normal"),
        "lag_1", (F.abs(F.col("lag_1")) > 0.1).alias("autocorrelation_significant"),
        "variance_ratio", (F.col("variance_ratio") > 2.0).alias("likely_heteroscedastic"),
        "outlier_count", (F.col("outlier_count") / F.col("n") * 100).alias("outlier_percentage"))


# -------------------------------------------------------------------------- EV8
def compare_models(metrics: DataFrame, by: str = KEY) -> DataFrame:
    """Metric table ranked by rmse ascending (ties by name)."""
    from pyspark.sql import Window
    # one row per model: the ranking window is bounded by the number of models
    w = Window.orderBy(F.col("rmse").asc_nulls_last(), F.col(by))
    return metrics.select(by, "rmse", "mae", "r2", "mape", F.row_number().over(w).alias("rank"))


# -------------------------------------------------------------------------- EV9
def comparative_performance(metrics: DataFrame, cols: Sequence[str] = ("rmse", "mae", "r2", "mape"),
                            higher_better: Sequence[str] = ("r2",), by: str = KEY) -> DataFrame:
    """Per model: min-max normalised score per metric (errors inverted) and
    their mean, with rank; per metric best/worst/spread/cv is
    ``metric_summary``."""
    from pyspark.sql import Window
    # one row per model: unpartitioned windows are bounded by the model count
    w = Window.partitionBy()
    parts = []
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        z = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(1.0))
        parts.append((z if c in higher_better else 1 - z).alias(f"{c}_score"))
    s = metrics.select(by, *parts)
    mean = sum((F.col(f"{c}_score") for c in cols), F.lit(0.0)) / len(cols)
    s = s.select("*", mean.alias("overall_score"))
    return s.select("*", F.row_number().over(Window.orderBy(F.col("overall_score").desc(), F.col(by)))
                    .alias("rank"))


def metric_summary(metrics: DataFrame, cols: Sequence[str] = ("rmse", "mae", "r2", "mape"),
                   higher_better: Sequence[str] = ("r2",), by: str = KEY) -> DataFrame:
    """Per metric: best and worst model, spread, coefficient of variation."""
    parts = []
    for c in cols:
        best = F.max_by(by, c) if c in higher_better else F.min_by(by, c)
        worst = F.min_by(by, c) if c in higher_better else F.max_by(by, c)
        parts.append(metrics.agg(F.lit(c).alias("metric"), best.alias("best_model"), worst.alias("worst_model"),
                                 (F.max(c) - F.min(c)).alias("spread"),
                                 (F.stddev_pop(c) / F.avg(c)).alias("cv")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------------- EV10
def business_impact(preds: DataFrame, by: str = KEY, value_per_unit: float = 1.0,
                    cost_per_error: float = 1.0) -> DataFrame:
    """Totals, error cost, p95 error (exact), mean error above p95, ROI with
    1 % savings potential."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    d = preds.select(by, "actual", "predicted", e.alias("__e"))
    p95 = exact_quantiles(d, "__e", [0.95], ["__p95"], by=[by])
    g = join_groups(d, p95, [by]).groupBy(by).agg(
        (F.sum("predicted") * value_per_unit).alias("total_prediction_value"),
        (F.sum("actual") * value_per_unit).alias("total_actual_value"),
        ((F.sum("predicted") - F.sum("actual")) * value_per_unit).alias("value_difference"),
        (F.sum("__e") * cost_per_error).alias("total_error_cost"),
        (F.avg("__e") * cost_per_error).alias("average_error_cost"),
        (F.max("__e") * cost_per_error).alias("max_error_cost"),
        (F.first("__p95") * cost_per_error).alias("value_at_risk_95"),
        (F.avg(F.when(F.col("__e") > F.col("__p95"), F.col("__e"))) * cost_per_error).alias("expected_shortfall"))
    sav = F.col("total_actual_value") * 0.01
    cost = F.col("total_error_cost")
    return g.select("*", F.when(cost > 0, (sav - cost) / cost * 100).otherwise(0.0).alias("roi_percentage"))


# ------------------------------------------------------------------------- EV14
def error_percentile_bounds(preds: DataFrame, by: str = KEY) -> DataFrame:
    """Absolute-error percentiles 50/68/95/99 per model (exact)."""
    d = preds.select(by, F.abs(F.col("actual") - F.col("predicted")).alias("__e"))
    return exact_quantiles(d, "__e", [0.5, 0.68, 0.95, 0.99], ["p50", "p68", "p95", "p99"], by=[by])


# ------------------------------------------------------------------------- EV4
def cv_scores(fold_preds: DataFrame, by: str = KEY) -> DataFrame:
    """Per model: mse/mae/r2/rmse per fold (long fold predictions with a
    ``fold`` column), then mean/std(pop)/min/max of each score."""
    y, yh = F.col("actual"), F.col("predicted")
    r = y - yh
    per = fold_preds.groupBy(by, "fold").agg(F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae"),
                                             (1 - F.sum(r * r) / (F.var_pop(y) * F.count(y))).alias("r2"))
    per = per.select("*", F.sqrt("mse").alias("rmse"))
    aggs = []
    for m in ("mse", "mae", "r2", "rmse"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"),
                 F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return per.groupBy(by).agg(*aggs)


# ------------------------------------------------------------------------- EV6
def residual_halves(preds: DataFrame, by: str = KEY, order_by: str = "row_id") -> DataFrame:
    """Residual mean/std (pop) and the variance ratio of the second to the
    first half (by position)."""
    p = positioned(preds, by, order_by)
    r = F.col("actual") - F.col("predicted")
    first = F.col("pos") < F.floor(F.col("n") / 2)
    return p.groupBy(by).agg(F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"),
                             (F.var_pop(F.when(~first, r)) / F.var_pop(F.when(first, r))).alias("half_variance_ratio"))


# ------------------------------------------------------------------------ EV13
def evaluation_report(metrics: DataFrame, residuals: DataFrame | None = None, by: str = KEY) -> DataFrame:
    """Quality score 0-100: r2 (40, min(40, 40 r2), 0 if negative), mape
    (< 5: 30, < 10: 25, < 20: 15, < 30: 5), directional accuracy (30 *
    acc/100 capped); rating (>= 80 Excellent, 70 Good, 60 Fair, else Poor);
    residual issues and recommendations."""
    r2, mape, da = F.col("r2"), F.col("mape"), F.col("directional_accuracy")
    score = (F.when(r2 >= 0, F.least(F.lit(40.0), r2 * 40)).otherwise(0.0)
             + F.when(mape < 5, 30.0).when(mape < 10, 25.0).when(mape < 20, 15.0).when(mape < 30, 5.0).otherwise(0.0)
             + F.least(F.lit(30.0), da * 30 / 100))
    # rated and judged unrounded; only the reported score is rounded
    m = metrics.select(by, "r2", "mape", "directional_accuracy", F.bround(score, 1).alias("overall_score"),
                       F.when(score >= 80, "Excellent").when(score >= 70, "Good").when(score >= 60, "Fair")
                       .otherwise("Poor").alias("rating"), score.alias("__score"))
    if residuals is not None:
        m = m.join(residuals.select(by, "is_normal", "autocorrelation_significant", "likely_heteroscedastic",
                                    "outlier_percentage"), by, "left")
        issues = F.array_compact(F.array(
            F.when(~F.coalesce(F.col("is_normal"), F.lit(True)), F.lit("Residuals not normally distributed")),
            F.when(F.coalesce(F.col("autocorrelation_significant"), F.lit(False)),
                   F.lit("Significant autocorrelation in residuals")),
            F.when(F.coalesce(F.col("likely_heteroscedastic"), F.lit(False)),
                   F.lit("Likely heteroscedasticity present")),
            F.when(F.col("outlier_percentage") > 5,
                   F.concat(F.lit("High percentage of outliers ("), fixed1("outlier_percentage"), F.lit("%)")))))
        m = m.select(by, "r2", "mape", "directional_accuracy", "overall_score", "rating", "__score", issues.alias("issues"))
    recs = F.array_compact(F.array(
        F.when(r2 < 0.5, F.lit("Consider feature engineering or different algorithms")),
        F.when(mape > 20, F.lit("High prediction errors - review model assumptions")),
        F.when(F.col("__score") < 60, F.lit("Model performance below acceptable threshold"))))
    return m.select("*", recs.alias("recommendations")).drop("__score")


# fixed values: recommendation texts of the performance report
PERFORMANCE_TEXTS = {
    "accuracy": "Consider feature engineering or alternative algorithms to improve accuracy",
    "error": "High error rate - review model assumptions and data quality",
    "time": "Consider model simplification to reduce training time",
    "stability": "Model stability issues - consider ensemble methods or regularization",
    "none": "Model performance is satisfactory - monitor for any degradation",
}
# fixed values: points of the efficiency and stability ratings (others: 5)
EFFICIENCY_POINTS = {"Excellent": 20.0, "Good": 15.0, "Fair": 10.0}
STABILITY_POINTS = {"Very Stable": 20.0, "Stable": 15.0, "Moderately Stable": 10.0}


def performance_report(metrics: DataFrame, efficiency: DataFrame | None = None, business: DataFrame | None = None,
                       stability: DataFrame | None = None, by: str = KEY) -> DataFrame:
    """EV13, the performance report: a score of up to 100 from accuracy (r2:
    50 / 37.5 / 25 / 12.5 points from .8, .6, .4), efficiency and stability
    (rating: 20 / 15 / 10 / 5) and business impact (ROI %: 10 above 20, 7.5
    above 0, 5 above -10, else 2.5); overall Excellent from 85, Good 70, Fair
    55; recommendations.

    ``metrics`` has rmse, r2 and mape per ``by``; the other tables are
    optional, with a row per ``by``: efficiency_rating and
    training_time_seconds; roi_percentage; stability_rating.  A model that a
    table does not hold gets no points and no advice from it; a NULL rating
    or ROI in a row counts as Fair, Moderately Stable or 0, a NULL r2 as 0
    and a NULL mape as no error known.
    """
    def given(d: DataFrame, table: DataFrame | None, name: str, columns: dict) -> DataFrame:
        if table is None:
            return d.select("*", F.lit(False).alias(name), *[F.lit(v).alias(c) for c, v in columns.items()])
        t = table.select(by, F.lit(True).alias("__there"), *[F.coalesce(F.col(c) if c in table.columns else F.lit(None), F.lit(v)).alias(c)
                                                             for c, v in columns.items()])
        return d.join(t, by, "left").withColumn(name, F.coalesce("__there", F.lit(False))).drop("__there")

    m = metrics.select(by, "rmse", "r2", "mape")
    m = given(m, efficiency, "__eff", {"efficiency_rating": "Fair", "training_time_seconds": 0.0})
    m = given(m, business, "__bus", {"roi_percentage": 0.0})
    m = given(m, stability, "__stab", {"stability_rating": "Moderately Stable"})

    def points(rating: str, table: dict) -> Column:
        out = F.lit(5.0)
        for text, value in table.items():
            out = F.when(F.col(rating) == text, value).otherwise(out)
        return out

    r2, roi = F.coalesce("r2", F.lit(0.0)), F.col("roi_percentage")
    accuracy = F.when(r2 >= 0.8, 50.0).when(r2 >= 0.6, 37.5).when(r2 >= 0.4, 25.0).otherwise(12.5)
    score = (accuracy + F.when(F.col("__eff"), points("efficiency_rating", EFFICIENCY_POINTS)).otherwise(0.0)
             + F.when(F.col("__stab"), points("stability_rating", STABILITY_POINTS)).otherwise(0.0)
             + F.when(F.col("__bus"), F.when(roi > 20, 10.0).when(roi > 0, 7.5).when(roi > -10, 5.0).otherwise(2.5)).otherwise(0.0))
    advice = F.array_compact(F.array(
        F.when(r2 < 0.6, PERFORMANCE_TEXTS["accuracy"]),
        F.when(F.col("mape") > 15, PERFORMANCE_TEXTS["error"]),
        F.when(F.col("__eff") & (F.col("training_time_seconds") > 300), PERFORMANCE_TEXTS["time"]),
        F.when(F.col("__stab") & F.col("stability_rating").isin("Unstable", "Moderately Stable"), PERFORMANCE_TEXTS["stability"])))
    out = m.select(by, "rmse", "r2", "mape",
                   F.when(r2 >= 0.8, "Excellent").when(r2 >= 0.6, "Good").when(r2 >= 0.4, "Fair").otherwise("Poor").alias("accuracy_rating"),
                   F.bround(score, 1).alias("overall_score"),
                   F.when(score >= 85, "Excellent").when(score >= 70, "Good").when(score >= 55, "Fair").otherwise("Poor").alias("overall_rating"),
                   advice.alias("__advice"))
    return out.select("*", F.when(F.size("__advice") > 0, F.col("__advice"))
                      .otherwise(F.array(F.lit(PERFORMANCE_TEXTS["none"]))).alias("recommendations")).drop("__advice")


# ------------------------------------------------------------------------ EV14
def qq_pairs(preds: DataFrame, by: str = KEY, order_by: str = "row_id", points: int = 99) -> DataFrame:
    """Q-Q pairs of standardised residuals: theoretical normal quantiles at
    linspace(.01, .99, points) against the exact sample quantiles.  A model
    whose residuals are all equal has no rows."""
    from ..functions.stats import norm_ppf
    r = preds.select(by, (F.col("actual") - F.col("predicted")).alias("__r"))
    st = r.groupBy(by).agg(F.avg("__r").alias("__m"), F.stddev_pop("__r").alias("__s"))
    z = join_groups(r, st, [by]).select(by, safe_div(F.col("__r") - F.col("__m"), F.col("__s")).alias("__z"))
    qs = [0.01 + i * (0.98 / (points - 1)) for i in range(points)]
    q = long_quantiles(value_count_ladder(z, "__z", [by]), "__z", qs, [by])
    return q.select(by, F.col("q").alias("p"), norm_ppf(F.col("q")).alias("theoretical_quantile"), F.col("value").alias("sample_quantile"))


# ------------------------------------------------------------------------ EV15
def radar_scores(metrics: DataFrame, cols: Sequence[str] = ("rmse", "mae", "mape", "r2"),
                 higher_better: Sequence[str] = ("r2",), by: str = KEY) -> DataFrame:
    """Min-max normalised metric per model for a radar view (error metrics
    inverted); a constant metric scores 1 (one row per model: bounded)."""
    from pyspark.sql import Window
    w = Window.partitionBy()
    out = []
    for c in cols:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        z = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(1.0))
        out.append((z if c in higher_better else F.when(hi > lo, 1 - z).otherwise(F.lit(1.0))).alias(f"{c}_radar"))
    return metrics.select(by, *out)
