"""The ensemble pipeline against numpy."""

import numpy as np
import pytest

import __spark_entry__ as E
from tidewater.operators import ensemble as EN
from tidewater.operators import tuning as TU

SF = "/root/testdata/sf0.001"
# the second one's coefficients are nought, so that it predicts the mean
TWO = {"ols": ("linear", {}), "mean": ("linear", {"regParam": 1e12})}


def _rows(n=400):
    r = np.random.default_rng(11)
    x = r.normal(size=(n, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + r.normal(size=n) * 2
    return x, y, [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]


def _ols(x, y, at):
    one = np.c_[np.ones(len(x)), x]
    return np.c_[np.ones(len(at)), at] @ np.linalg.lstsq(one, y, rcond=None)[0]


def test_stages_are_numpys_and_no_model_is_fitted_twice(spark, monkeypatch):
    x, y, rows = _rows()
    df = spark.createDataFrame(rows + [(900, 1.0, 1.0, None)], "row_id long, a double, b double, y double").repartition(7)
    fits = []
    real = TU.ESTIMATORS["linear"]

    class Counted(real):
        def fit(self, rows):
            fits.append((self.getRegParam(), rows.count(), rows.agg({"__pos": "sum"}).first()[0]))
            return super().fit(rows)

    monkeypatch.setitem(TU.ESTIMATORS, "linear", Counted)
    got = EN.ensemble_pipeline(df, ["a", "b"], "y", ["row_id"], TWO, n_splits=4)
    assert len(fits) == len(set(fits)) == 2 * (4 + 1)  # each component on each fold's rows and on all of them

    t, v = 280, 340
    p = np.zeros((t, 2))
    for at in np.array_split(np.arange(t), 4):
        rest = np.setdiff1d(np.arange(t), at)
        p[at, 0], p[at, 1] = _ols(x[rest], y[rest], x[at]), y[rest].mean()
    e = y[:t, None] - p
    g = e.T @ e / t
    w = np.clip((g[1, 1] - g[0, 1]) / (g[0, 0] + g[1, 1] - 2 * g[0, 1]), 0, 1)
    assert np.allclose(list(got.combined["weighted"][1].values()), [w, 1 - w], atol=1e-4)
    meta = np.linalg.lstsq(np.c_[np.ones(t), p], y[:t], rcond=None)[0]
    assert np.allclose([got.combined["stacking"][0], *got.combined["stacking"][1].values()], meta, rtol=1e-3)
    start = max(t // 2, 100)
    last = [b for b in range(start, t, 20) if min(b + 20, t) - b >= 10][-1]
    inv = 1 / (np.sqrt((e[last:last + 20] ** 2).mean(axis=0)) + 1e-8)
    assert np.allclose(list(got.combined["dynamic"][1].values()), inv / inv.sum(), atol=1e-4)

    base = np.c_[_ols(x[:t], y[:t], x[t:]), np.full(len(y) - t, y[:t].mean())]
    values = {"ols": base[:, 0], "mean": base[:, 1], "weighted": base @ [w, 1 - w], "dynamic": base @ (inv / inv.sum()),
              "stacking": meta[0] + base @ meta[1:]}
    rmse = {(m, s): np.sqrt(((y[t:] - q)[cut] ** 2).mean()) for m, q in values.items()
            for s, cut in (("validation", slice(0, v - t)), ("test", slice(v - t, None)))}
    scores = got.scores.collect()
    assert {(r["model_name"], r["split"]) for r in scores} == rmse.keys()
    assert all(abs(r["rmse"] - rmse[r["model_name"], r["split"]]) < 1e-3 for r in scores)
    assert got.chosen == min(EN.TYPES, key=lambda k: rmse[k, "validation"])
    assert {r["model_name"] for r in scores if r["chosen"]} == {got.chosen}
    assert got.predictions.count() == 5 * (len(y) - t)
    spread = got.diversity.first()
    assert abs(spread["mean_row_std"] - base[v - t:].std(axis=1).mean()) < 1e-3


def test_few_rows(spark):
    x, y, rows = _rows(60)
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y double")
    got = EN.ensemble_pipeline(df, ["a", "b"], "y", ["row_id"], TWO, n_splits=3)
    assert set(got.combined) == {"weighted", "stacking"}  # no batch for dynamic weights
    with pytest.raises(ValueError):
        EN.ensemble_pipeline(df, ["a", "b"], "y", ["row_id"], TWO, types=["dynamic"], n_splits=3)
    with pytest.raises(ValueError):
        EN.ensemble_pipeline(df.limit(2), ["a", "b"], "y", ["row_id"], TWO)
    with pytest.raises(ValueError):
        EN.ensemble_pipeline(df, ["a", "b"], "y", ["row_id"], {"ols": TWO["ols"]})
    with pytest.raises(ValueError):
        EN.ensemble_pipeline(df, ["a", "b"], "y", ["row_id"], TWO, types=["voting"], n_splits=3)


def test_equal_labels(spark):
    df = spark.createDataFrame([(i, float(i % 7), 5.0) for i in range(60)], "row_id long, a double, y double")
    got = EN.ensemble_pipeline(df, ["a"], "y", ["row_id"], {"a": ("decision_tree", {}), "b": ("decision_tree", {"maxDepth": 2})},
                               types=["weighted"], n_splits=3)
    assert all(r["rmse"] == 0 and r["r2"] is None for r in got.scores.collect())


def test_query(spark):
    rows = E.queries()["e7_ensemble_pipeline"](spark, SF).collect()
    assert len(rows) == 2 * (2 + 3) and len({r["model_name"] for r in rows if r["chosen"]}) == 1
