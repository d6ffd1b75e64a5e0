"""Economic indicators of mixed frequency."""

import datetime as dt

import numpy as np
import pandas as pd

from tidewater.operators import economics as EC


def frame(spark, name, dates, values):
    return spark.createDataFrame([(d, v) for d, v in zip(dates, values)], f"date date, {name} double")


def months(n, year=2020):
    return [dt.date(year + k // 12, k % 12 + 1, 28) for k in range(n)]


def test_a_quarter_does_not_leak_into_its_months(spark):
    ends = [dt.date(2020, 3, 31), dt.date(2020, 6, 30), dt.date(2020, 9, 30)]
    groups = {"growth": frame(spark, "GDP_REAL", ends, [100.0, 110.0, 99.0]), "labor": frame(spark, "JOB_OPENINGS", months(12), [float(k) for k in range(12)])}
    rows = {r["date"]: r for r in EC.economic_composite(groups, backfill=False).collect()}
    assert rows[dt.date(2020, 2, 28)]["GDP_REAL"] is None and rows[dt.date(2020, 3, 28)]["GDP_REAL"] is None
    assert [rows[dt.date(2020, m, 28)]["GDP_REAL"] for m in (4, 5, 6, 7, 9, 10)] == [100.0, 100.0, 100.0, 110.0, 110.0, 99.0]
    # growth is against the quarter before, not against the row before
    assert rows[dt.date(2020, 6, 28)]["GDP_GROWTH_QOQ"] is None
    assert np.isclose(rows[dt.date(2020, 8, 28)]["GDP_GROWTH_QOQ"], 10.0) and np.isclose(rows[dt.date(2020, 12, 28)]["GDP_GROWTH_QOQ"], -10.0)
    filled = {r["date"]: r for r in EC.economic_composite(groups).collect()}
    assert filled[dt.date(2020, 1, 28)]["GDP_REAL"] == 100.0 and np.isclose(filled[dt.date(2020, 1, 28)]["GDP_GROWTH_QOQ"], 10.0)


def test_indicators_equal_pandas(spark):
    rng = np.random.default_rng(2)
    dates = months(40)
    cpi, lead, un, job = 100 + rng.normal(size=40).cumsum(), rng.normal(size=40).cumsum() / 3, rng.uniform(3, 9, 40), rng.uniform(50, 90, 40)
    vix = rng.uniform(10, 40, 40)
    groups = {"a": frame(spark, "CPI_ALL", dates, map(float, cpi)), "b": frame(spark, "LEADING_INDEX", dates, map(float, lead)),
              "c": frame(spark, "UNEMPLOYMENT_RATE", dates, map(float, un)), "d": frame(spark, "JOB_OPENINGS", dates, map(float, job)), "e": frame(spark, "VIX", dates[5:], map(float, vix[5:]))}
    got = {(r["series"], r["date"]): r["value"] for r in EC.economic_indicators(EC.long_series(groups)).collect()}
    s = pd.Series(cpi)
    z = lambda x: (x - np.mean(x)) / np.std(x, ddof=1)
    slope = pd.Series(lead).rolling(6).apply(lambda x: np.polyfit(range(6), x, 1)[0])
    want = {"CPI_ALL_YOY": s.pct_change(12) * 100, "INFLATION_MOMENTUM": s.pct_change(3) * 100, "INFLATION_ACCELERATION": (s.pct_change(3) * 100).diff(),
            "BUSINESS_CYCLE_PHASE": pd.Series(np.where(slope > 0.1, 1, np.where(slope < -0.1, -1, 0))), "BEVERIDGE_CURVE": pd.Series(job / un),
            "ECONOMIC_STRESS_INDEX": pd.Series([np.nan] * 5 + list((z(vix[5:]) + z(un)[5:]) / 2))}
    assert {k[0] for k in got} == set(want)
    for name, values in want.items():
        for d, v in zip(dates, values):
            assert np.isclose(got.get((name, d), np.nan), v, equal_nan=True), (name, d)


def test_missing_values_repeated_series_and_nothing(spark):
    d = months(3)
    a = spark.createDataFrame([(d[0], 1.0), (d[1], None), (d[2], float("nan"))], "date date, VIX double")
    b = spark.createDataFrame([(d[0], 9.0), (d[1], 5.0)], "date date, VIX double")
    rows = [tuple(r)[:2] for r in EC.economic_composite({"a": a, "b": b}).orderBy("date").collect()]
    assert rows == [(d[0], 1.0), (d[1], 5.0), (d[2], 5.0)]
    assert EC.economic_composite({"a": a.limit(0)}).collect() == []


def test_behavioral_features(spark):
    from tidewater.operators.reports import behavioral_features
    rows = [("Loyalty_score", 0.25), ("segment_SME", 0.3), ("segment_A", 0.3), ("VIX", 0.9), ("behavioral_index", 0.1), (None, 0.5), ("volatility_factor", None)]
    rows += [(f"rate_sensitivity_{k}", 0.01 * k) for k in range(8)]
    got = [tuple(r) for r in behavioral_features(spark.createDataFrame(rows, "feature string, importance double")).orderBy("rank").collect()]
    assert [r[1] for r in got] == ["segment_A", "segment_SME", "Loyalty_score", "behavioral_index", *(f"rate_sensitivity_{k}" for k in (7, 6, 5, 4, 3, 2))]
    assert got[2][3:] == ("Customer loyalty significantly impacts deposit stability", "25.0%") and got[3][3] == "This behavioral factor influences deposit flows"
    assert got[4][3].startswith("Rate sensitivity") and got[5][3:] == (None, None)
    assert behavioral_features(spark.createDataFrame([], "feature string, importance double")).collect() == []
