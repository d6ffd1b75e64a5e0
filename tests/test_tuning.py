"""Cross validation, grid search and ensemble weights against numpy."""

import numpy as np
import pytest

import __spark_entry__ as E
from tidewater.operators import tuning as TU
from tidewater.operators.ml import optimize_weights

SF = "/root/testdata/sf0.001"


def _data(n=203):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, 2))
    y = 2 * x[:, 0] + x[:, 1] + r.normal(size=n)
    return x, y


def _folds(n, k, method):
    at = np.arange(n)
    if method == "timeseries":
        size = n // (k + 1)
        return [(at[:s], at[s:s + size]) for s in range(n - k * size, n, size)]
    return [(np.setdiff1d(at, part), part) for part in np.array_split(at, k)]


@pytest.mark.parametrize("method", ["timeseries", "kfold"])
def test_fold_scores_are_numpys(spark, method):
    x, y = _data()
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))] + [(500, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y double").repartition(5)
    mse, mae, r2 = [], [], []
    one = np.c_[np.ones(len(y)), x]
    for train, test in _folds(len(y), 4, method):
        e = y[test] - one[test] @ np.linalg.lstsq(one[train], y[train], rcond=None)[0]
        mse.append((e ** 2).mean())
        mae.append(np.abs(e).mean())
        r2.append(1 - (e ** 2).mean() / y[test].var())
    got = TU.cross_validate(df, ["a", "b"], "y", ["row_id"], {"ols": ("linear", {})}, n_splits=4, method=method).collect()
    assert len(got) == 1
    for name, v in (("mse", mse), ("mae", mae), ("r2", r2), ("rmse", np.sqrt(mse))):
        v = np.array(v)
        assert np.allclose([got[0][f"{name}_{s}"] for s in ("mean", "std", "min", "max")], [v.mean(), v.std(), v.min(), v.max()], atol=1e-6)


def test_ridge_grid_picks_the_least_error(spark):
    x, y = _data(60)
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y double")
    grid = {"regParam": [10.0, 0.0, 0.0], "fitIntercept": [True]}
    got = TU.grid_search(df, ["a", "b"], "y", ["row_id"], "linear", grid, n_splits=3)
    by = {r["choice"]: r for r in got.collect()}
    assert by[0]["rank"] == 3 and by[1]["rank"] == 1 and by[2]["rank"] == 2  # a tie goes to the earlier
    assert by[0]["parameters"] == {"regParam": "10.0", "fitIntercept": "True"}
    assert TU.best_parameters(got, grid) == {"regParam": 0.0, "fitIntercept": True}


def test_bounds():
    assert TU.fold_bounds(10, 3, "kfold") == [(0, 4), (4, 7), (7, 10)]
    assert TU.fold_bounds(11, 3) == [(5, 7), (7, 9), (9, 11)]
    for n, k, method in ((3, 3, "timeseries"), (2, 3, "kfold"), (9, 3, "other")):
        with pytest.raises(ValueError):
            TU.fold_bounds(n, k, method)


def test_queries(spark):
    q = E.queries()
    cv = {r["model_name"]: r for r in q["ev4_cross_validation"](spark, SF).collect()}
    assert cv.keys() == {"linear", "decision_tree"} and all(r["rmse_min"] <= r["rmse_mean"] <= r["rmse_max"] for r in cv.values())
    grid = q["t1_grid_search"](spark, SF).orderBy("rank").collect()
    assert [r["rank"] for r in grid] == [1, 2, 3, 4] and grid[0]["mse_mean"] == min(r["mse_mean"] for r in grid)


def test_ensemble_weights_settle_or_say_so():
    assert np.allclose(optimize_weights([[1.0, 0.0], [0.0, 3.0]]), [0.75, 0.25])
    with pytest.raises(ValueError):
        optimize_weights([[1.0, None], [None, 3.0]])
    with pytest.raises(ArithmeticError):
        optimize_weights([[1.0, 0.0], [0.0, 3.0]], max_steps=1)
