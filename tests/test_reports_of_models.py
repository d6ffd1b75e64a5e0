"""The performance report of models: thresholds, absent tables, NULLs."""

import datetime

from tidewater.operators import evaluate as EV
from tidewater.operators import reports as RP

T = EV.PERFORMANCE_TEXTS


def _report(spark, r2, mape, **tables):
    m = spark.createDataFrame([("m", 1.0, r2, mape)], "model_name string, rmse double, r2 double, mape double")
    frames = {k: spark.createDataFrame([("m", *v)], f"model_name string, {s}") for k, (v, s) in tables.items()}
    r = EV.performance_report(m, **frames).first()
    return r["accuracy_rating"], r["overall_score"], r["overall_rating"], r["recommendations"]


def test_scores_and_advice(spark):
    eff, bus, stab = "efficiency_rating string, training_time_seconds double", "roi_percentage double", "stability_rating string"
    assert _report(spark, 0.8, 15.0) == ("Excellent", 50.0, "Poor", [T["none"]])
    assert _report(spark, 0.8, 5.0, efficiency=(("Excellent", 300.0), eff), business=((20.1,), bus),
                   stability=(("Very Stable",), stab)) == ("Excellent", 100.0, "Excellent", [T["none"]])
    assert _report(spark, 0.59, 15.1, efficiency=(("Slow", 301.0), eff), business=((-10.0,), bus), stability=(("Unstable",), stab)) == \
        ("Fair", 37.5, "Poor", [T["accuracy"], T["error"], T["time"], T["stability"]])
    # NULL ratings count as Fair, Moderately Stable and a ROI of 0
    assert _report(spark, 0.6, None, efficiency=((None, None), eff), business=((None,), bus), stability=((None,), stab)) == \
        ("Good", 62.5, "Fair", [T["stability"]])
    assert _report(spark, None, None) == ("Poor", 12.5, "Poor", [T["accuracy"]])


def test_a_model_that_a_table_lacks_gets_nothing_from_it(spark):
    m = spark.createDataFrame([("a", 1.0, 0.9, 1.0), ("b", 1.0, 0.9, 1.0)], "model_name string, rmse double, r2 double, mape double")
    stab = spark.createDataFrame([("a", "Stable")], "model_name string, stability_rating string")
    got = {r["model_name"]: (r["overall_score"], r["recommendations"]) for r in EV.performance_report(m, stability=stab).collect()}
    assert got == {"a": (65.0, [T["none"]]), "b": (50.0, [T["none"]])}


def test_stability_of_runs_and_latest_values(spark):
    """The reports that read one-row statistics as scalar fields (EV11, A15, A17)."""
    runs = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 3.0), ("a", 2, 2.0), ("b", 2, 4.0), ("a", 3, 4.0), ("b", 3, 6.0)],
                                 "run string, row_id long, predicted double")
    r = RP.run_stability(runs, "run", ["a", "b"]).first()
    assert (r["average_std"], r["average_range"], r["stability_rating"]) == (1.0, 2.0, "Unstable")
    assert abs(r["inter_run_corr_mean"] - 1.0) < 1e-12 and abs(r["inter_run_corr_std"]) < 1e-12

    day = [datetime.date(2024, 1, d) for d in (1, 2, 3, 4)]
    market = spark.createDataFrame([(d, 5.0, v, 4.0, 3.0) for d, v in zip(day, (10.0, 20.0, 40.0, 30.0))],
                                   "date date, FED_FUNDS_RATE double, VIX double, TREASURY_10Y double, TREASURY_2Y double")
    s = RP.latest_snapshot(market, std_window=2).first()
    assert (s["as_of"], s["current"], s["mean"], s["delta_vs_mean"], s["current_percentile"]) == (day[3], 30.0, 25.0, 5.0, 75.0)
    assert abs(s["std_2"] - 50 ** 0.5) < 1e-12

    customers = spark.createDataFrame([("x", "A", 100.0, 0.5, 0.5, 0.5), ("y", "B", 300.0, 1.0, 1.0, 0.0)],
                                      "customer_id string, segment string, balance_avg double, rate_sensitivity double, "
                                      "loyalty_score double, volatility_factor double")
    flows = spark.createDataFrame([(day[2], -2.0, 50.0), (day[3], 4.0, 60.0), (day[3], None, None)],
                                  "date date, deposit_flow double, balance_end double")
    k = RP.current_metrics(market, customers, flows).first()
    assert (k["as_of"], k["yield_spread"], k["total_customers"], k["total_deposits"]) == (day[3], 1.0, 2, 400.0)
    assert abs(k["behavioral_risk"] - (0.5 * 100 + 0.4 * 300) / 400) < 1e-12
    assert (k["latest_daily_flow"], k["avg_flow"], k["concentration_index"]) == (4.0, 1.0, 1.0)
    assert abs(k["lcr_estimate"] - 0.15 * 60 / (30 * 2.0)) < 1e-12


def test_runs_without_a_correlation_have_no_error(spark):
    """No rows, one row, a constant run, an absent run: EV11 divided by the number of correlations, zero."""
    for rows, average in (([], None), ([("a", 1, 1.0), ("b", 1, 3.0)], 1.0), ([("a", 1, 1.0), ("b", 1, 3.0), ("a", 2, 1.0), ("b", 2, 5.0)], 1.5),
                          ([("a", 1, 1.0), ("a", 2, 2.0)], 0.0)):
        r = RP.run_stability(spark.createDataFrame(rows, "run string, row_id long, predicted double"), "run", ["a", "b"]).first()
        assert r["average_std"] == average
        assert [r[f"inter_run_corr_{k}"] for k in ("min", "max", "mean", "std")] == [None, None, None, 0.0]


def test_balances_that_sum_to_zero_have_no_error(spark):
    """A17 divided by the sum of the balances: the risk is then NULL and the concentration at its cap."""
    day = datetime.date(2024, 1, 2)
    market = spark.createDataFrame([(day, 5.0, 20.0, 4.0, 3.0)], "date date, FED_FUNDS_RATE double, VIX double, TREASURY_10Y double, TREASURY_2Y double")
    flows = spark.createDataFrame([(day, -2.0, 60.0)], "date date, deposit_flow double, balance_end double")
    for balances in ((0.0, 0.0), (100.0, -100.0)):
        customers = spark.createDataFrame([("x", "A", balances[0], 0.5, 0.5, 0.5), ("y", "B", balances[1], 1.0, 1.0, 0.0)],
                                          "customer_id string, segment string, balance_avg double, rate_sensitivity double, "
                                          "loyalty_score double, volatility_factor double")
        k = RP.current_metrics(market, customers, flows).first()
        assert (k["total_customers"], k["total_deposits"], k["behavioral_risk"], k["concentration_index"]) == (2, 0.0, None, 1.0)
        assert (k["latest_daily_flow"], k["avg_flow"]) == (-2.0, -2.0)
