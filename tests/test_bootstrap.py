"""Weighted refits against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tidewater.operators import bootstrap as BS

SF = "/root/testdata/sf0.001"
FEATS = ["a", "b"]


def _rows(n=400):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 2))
    y = 3 * x[:, 0] - x[:, 1] + 5 + r.normal(size=n)
    rows = [(int(i), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    rows[7] = (7, None, 0.5, 2.0)   # no feature: 0
    rows[8] = (8, 1.0, 0.5, None)   # no label: not learned from
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), "row_id long, a double, b double, y double")


def _weights(spark, n, rate=1.0):
    ids = spark.range(400).select("id", *[BS.replicate_weight(F.col("id"), k, rate).alias(f"w{k}") for k in range(n)])
    return ids.orderBy("id").toPandas().drop(columns="id").to_numpy()


def test_weights_are_poisson_and_stay(spark):
    d = spark.range(200_000)
    for rate in (0.8, 1.0):
        w = BS.replicate_weight(F.col("id"), 5, rate).alias("w")
        got = {r["w"]: r["count"] / 200_000 for r in d.select(w).groupBy("w").count().collect()}
        for k in range(4):
            assert abs(got[k] - np.exp(-rate) * rate ** k / [1, 1, 2, 6][k]) < 0.005
        one, seven = ([tuple(r) for r in d.limit(500).repartition(p).select("id", w).orderBy("id").collect()] for p in (1, 7))
        assert one == seven


def test_intervals_and_scores_are_numpys(spark, table):
    n = 12
    models = BS.replicate_models(table, FEATS, "y", n=n)
    rows = _rows()
    x = np.array([[1.0, r[1] or 0.0, r[2]] for r in rows])
    known = np.array([r[3] is not None for r in rows])
    y = np.array([r[3] or 0.0 for r in rows])
    w = _weights(spark, n)
    preds = []
    for k in range(n):
        s = np.sqrt(w[known, k])
        preds.append(x @ np.linalg.lstsq(x[known] * s[:, None], y[known] * s, rcond=None)[0])
    preds = np.array(preds)
    got = BS.bootstrap_intervals(models, table, FEATS).orderBy("row_id").toPandas()
    assert np.allclose(got["prediction"], preds.mean(0), atol=1e-6)
    assert np.allclose(got["lower"], np.quantile(preds, 0.025, axis=0), atol=1e-6)
    assert np.allclose(got["upper"], np.quantile(preds, 0.975, axis=0), atol=1e-6)

    scores = BS.replicate_scores(models, table, FEATS, "y")
    res = y[known] - preds[:, known]
    want = {"rmse": np.sqrt((res ** 2).mean(1)), "mae": np.abs(res).mean(1), "r2": 1 - (res ** 2).mean(1) / y[known].var()}
    stats = {r["name"]: r for r in BS.stability(scores).collect()}
    for m, v in want.items():
        r = stats[m]
        assert np.allclose([r["mean"], r["std"], r["cv"], r["min"], r["max"], r["q25"], r["q75"]],
                           [v.mean(), v.std(), v.std() / v.mean(), v.min(), v.max(), *np.quantile(v, [0.25, 0.75])], atol=1e-6)


def test_moments_of_all_replicates_in_one_pass(spark, table):
    """One pass gives the fits that each replicate's weighted rows give."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegression
    d = BS.assembled(table, FEATS, [F.col("row_id").alias("__id"), F.col("y").alias("__label")]).where("__label is not null")
    for params in ({}, {"regParam": 0.3, "elasticNetParam": 0.5}):
        models = BS.replicate_models(table, FEATS, "y", n=3, rate=0.8, **params)
        for k, m in enumerate(models):
            w = d.withColumn("__weight", BS.replicate_weight(F.col("__id"), k, 0.8)).where("__weight > 0")
            own = LinearRegression(featuresCol="__features", labelCol="__label", weightCol="__weight", **params).fit(w)
            assert np.allclose([*m.coefficients, m.intercept], [*own.coefficients, own.intercept], atol=1e-6)
    sums = BS.replicate_moments(d.repartition(3), [0.0, 0.0, 0.0], 2).orderBy("at").toPandas()["value"].to_numpy()
    rows = [r for r in _rows() if r[3] is not None]
    v = np.array([[1.0, r[1] or 0.0, r[2], r[3]] for r in rows])
    w = _weights(spark, 2)[[r[0] for r in rows]]
    i, j = np.triu_indices(4)
    assert np.allclose(sums.reshape(2, 10), w.T @ (v[:, i] * v[:, j]))
    # a feature that does not vary, one that repeats another
    odd = spark.createDataFrame([(k, 7.0, float(k % 5), float(k % 5), 2.0 * (k % 5) + 1) for k in range(60)],
                                "row_id long, c double, a double, b double, y double")
    for m in BS.replicate_models(odd, ["c", "a", "b"], "y", n=2):
        assert abs(m.predict(Vectors.dense([7.0, 3.0, 3.0])) - 7.0) < 1e-6


def test_intervals_cover_the_fitted_line(spark, table):
    got = BS.bootstrap_intervals(BS.replicate_models(table, FEATS, "y", n=60), table, FEATS).join(table.fillna(0.0, FEATS), "row_id")
    r = got.agg(F.avg((F.expr("3 * a - b + 5").between(F.col("lower"), F.col("upper"))).cast("int")),
                F.min((F.col("lower") <= F.col("prediction")) & (F.col("prediction") <= F.col("upper")))).first()
    assert r[0] > 0.8 and r[1]


def test_importances(spark):
    rows = [(k, m, f, v + k / 10) for k in (0, 1) for m, f, v in
            [("rf", "RATE_x", 0.5), ("rf", "vix", 0.3), ("gbt", "RATE_x", 0.2), ("gbt", "vix", 0.7)]]
    imp = spark.createDataFrame(rows, "replicate int, model string, feature string, importance double")
    first = imp.where("replicate = 0")
    got = {r["feature"]: r for r in BS.combined_importance(first, {"rf": 0.4}).collect()}
    assert np.allclose([got["RATE_x"][c] for c in ("average", "weighted", "greatest")], [0.35, 0.4, 0.5])
    assert np.allclose([got["vix"][c] for c in ("average", "weighted", "greatest")], [0.5, 0.82, 0.7])
    cats = {r["category"]: r["importance"] for r in BS.category_importance(BS.combined_importance(first)).collect()}
    assert np.allclose([cats["Interest Rate"], cats["Market Volatility"]], [0.35, 0.5])
    s = {r["name"]: r for r in BS.stability(spark.createDataFrame([], "replicate int, metric string, value double"),
                                           imp.where("model = 'rf'")).collect()}
    assert np.isclose(s["vix"]["cv"], 0.05 / (0.35 + 1e-8)) and s["vix"]["stable"] and s["vix"]["q25"] == pytest.approx(0.325)


def test_queries(spark):
    q = E.queries()
    t7 = q["t7_bootstrap_intervals"](spark, SF).toPandas()
    assert len(t7) and (t7["lower"] <= t7["upper"]).all() and t7["row_id"].is_unique
    ev7 = q["ev7_bootstrap_stability"](spark, SF).toPandas()
    assert set(ev7["kind"]) == {"metric", "importance"} and len(ev7) == 7
    t9 = q["t9_combined_importances"](spark, SF).toPandas()
    assert abs(t9["average"].sum() - 1) < 1e-9 and (t9["n_models"] == 3).all()
