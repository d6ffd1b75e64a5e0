"""Quantiles, profiles and summaries of many columns from one ladder, against pandas."""

import math

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import clean as C
from tidewater.operators import features as FE
from tidewater.operators import reports as RP
from tidewater.plans import column_ladder as CL

BIG = 2 ** 53


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(500):
        x = float(r.normal()) if i % 7 else None
        rows.append((BIG + i % 3, math.nan if i % 11 == 0 else x, None, "ab"[i % 2] * (1 + i % 3) if i % 5 else None, "g" if i % 3 else "h"))
    return spark.createDataFrame(rows, "whole long, part double, none double, word string, grp string").repartition(6)


def _profile(df):
    return {(r["column"], r["metric"]): r["value"] if r["text"] is None else r["text"] for r in RP.data_profile(df).collect()}


def test_profile_is_pandas(table):
    p, pdf = _profile(table), table.toPandas()
    x = pdf["part"].dropna()
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    far = ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
    want = {"non_null_count": len(x), "null_count": 500 - len(x), "unique_count": x.nunique(), "median": x.median(), "mean": x.mean(),
            "std": x.std(), "skewness": x.skew(), "kurtosis": x.kurt(), "min": x.min(), "max": x.max(), "outliers_count": far,
            "negative_count": (x < 0).sum(), "zeros_count": 0, "null_percentage": (500 - len(x)) / 5}
    for k, v in want.items():
        assert p["part", k] == pytest.approx(v, abs=1e-9), k
    assert p["whole", "unique_count"] == 3 and p["whole", "dtype"] == "bigint"  # one double stands for two of them
    w = pdf["word"].dropna()
    top = w.value_counts()
    assert p["word", "most_frequent"] == sorted(top[top == top.max()].index)[0] and p["word", "most_frequent_count"] == top.max()
    assert p["word", "avg_length"] == pytest.approx(w.str.len().mean())
    assert p["none", "unique_count"] == 0 and p["none", "outliers_count"] == 0 and p["none", "median"] is None
    complete = 100 * (1 - pdf.isna().sum().sum() / pdf.size)
    assert p["(table)", "quality_score"] == pytest.approx(round(0.3 * complete + 67.5, 2)) and p["(table)", "rows"] == 500


def test_empty_tables(spark, table):
    none = table.limit(0)
    p = _profile(none)
    assert p["(table)", "rows"] == 0 and p["(table)", "quality_score"] is None and p["part", "null_percentage"] is None
    assert p["word", "most_frequent"] is None and p["word", "most_frequent_count"] == 0
    assert {r["value"] for r in RP.summary_statistics(none, ["part"]).collect()} == {0.0, None}
    assert RP.grouped_statistics(none, "grp").count() == 0 and RP.top_values(none, ["word"]).count() == 0
    assert {r["missing_percentage"] for r in RP.missing_summary(none).collect()} == {None}
    assert RP.box_stats(none, "part", ["grp"]).count() == 0


def test_groups_and_missing(table):
    pdf = table.toPandas()
    got = {(r["group"], r["column"], r["statistic"]): r["value"] for r in RP.grouped_statistics(table, "grp").collect()}
    for g, part in pdf.groupby("grp"):
        assert got[g, "part", "mean"] == pytest.approx(part["part"].mean()) and got[g, "part", "std"] == pytest.approx(part["part"].std())
        assert got[g, "part", "count"] == part["part"].count() and got[g, "none", "count"] == 0 and got[g, "none", "mean"] is None
    miss = {r["column"]: (r["missing"], r["missing_percentage"]) for r in RP.missing_summary(table).collect()}
    for c in pdf:
        assert miss[c][0] == pdf[c].isna().sum()
    assert miss["(table)"][1] == pytest.approx(100 * pdf.isna().sum().sum() / pdf.size)
    lad = CL.column_ladder(table, ["part", "whole"], ["grp"])
    q = {(r["column"], r["grp"]): r["q"] for r in CL.column_quantiles(lad, {"q": 0.3}, ["grp"]).collect()}
    for g, part in pdf.groupby("grp"):
        assert q["part", g] == pytest.approx(part["part"].quantile(0.3))


def test_top_values_of_many_columns(table):
    got = [tuple(r) for r in RP.top_values(table, ["word", "grp"], 2).collect()]
    pdf = table.toPandas()
    want = [(c, v, n) for c in ("word", "grp")
            for v, n in sorted(pdf[c].value_counts().items(), key=lambda vn: (-vn[1], vn[0]))[:2]]
    assert sorted(got) == sorted(want)
    plan = RP.top_values(table, ["word", "grp"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1  # a task keeps its own best before the shuffle


def test_robust_scaling_and_flow_clip(spark, table):
    pdf = table.where("not isnan(part)").toPandas()
    rows = {r["column"]: (r["center"], r["scale"]) for r in FE.fit_scaler(table, ["part", "none"], "robust").collect()}
    assert rows["part"] == (pytest.approx(pdf["part"].median()), pytest.approx(pdf["part"].quantile(0.75) - pdf["part"].quantile(0.25)))
    assert rows["none"] == (None, None)
    import datetime as dt
    flows = spark.createDataFrame([(f"c{i}", dt.date(2024, 1, 1 + i % 20), float(i if i else 10_000), None) for i in range(60)],
                                  "customer_id string, date date, deposit_flow double, empty_flow double")
    x = pd.Series([float(i if i else 10_000) for i in range(60)])
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    got = C.clean_flow_data(flows, "2024-12-31").toPandas()
    assert got["deposit_flow"].max() == pytest.approx(q3 + 3 * (q3 - q1)) and got["empty_flow"].isna().all()


def test_jobs_do_not_grow_with_the_columns(spark, table):
    sc, jobs = spark.sparkContext, []
    wide = table.select("*", *[(table["part"] * i).alias(f"part{i}") for i in range(6)])
    for name, df in (("narrow", table), ("wide", wide)):
        sc.setJobGroup(name, "")
        try:
            RP.data_profile(df).collect()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(name)))
    assert jobs[1] <= jobs[0] + 1 and jobs[0] < 25


@pytest.mark.parametrize("values", [[5.0], [2.0, 1.0], [1.0] * 9 + [4.0], list(range(100)), [1.0, 1.0, 2.0, 2.0, 2.0, 7.5]])
def test_many_quantiles_are_numpys(spark, values):
    from tidewater.plans.global_order import long_quantiles, value_count_ladder
    qs = [0.0, 0.01, 0.25, 0.5, 0.505, 0.9, 1.0]
    df = spark.createDataFrame([(g, float(v) * (1 + g)) for g in (0, 1) for v in values] + [(0, None)], "g int, x double")
    got = {(r["g"], r["i"]): r["value"] for r in long_quantiles(value_count_ladder(df, "x", ["g"]), "x", qs, ["g"]).collect()}
    assert got == {(g, i): pytest.approx(np.quantile(np.array(values, float) * (1 + g), q)) for g in (0, 1) for i, q in enumerate(qs)}


def test_qq_pairs_of_equal_residuals(spark):
    from tidewater.operators import evaluate as EV
    df = spark.createDataFrame([("a", i, 2.0, 1.0) for i in range(5)], "model_name string, row_id long, actual double, predicted double")
    assert EV.qq_pairs(df).count() == 0
