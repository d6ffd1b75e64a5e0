"""Kendall's tau-b against all pairs."""

import numpy as np
import pytest

from tidewater.operators import rankcorr as RC
from tidewater.operators.reports import correlation_matrix


def brute(x, y):
    x, y = np.asarray(x), np.asarray(y)
    a, b = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    below = np.sqrt((a != 0).sum() * (b != 0).sum(dtype=float))
    return (a * b).sum() / below if below else None


def test_inversions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        part, rank = rng.integers(0, 4, n), rng.permutation(n)
        got = RC.inversions(part, rank)
        for p in range(len(got)):
            r = rank[part == p]
            assert got[p] == sum(r[i] > r[j] for i in range(len(r)) for j in range(i + 1, len(r)))


@pytest.mark.parametrize("block,parts", [(1 << 19, 2048), (7, 2048), (1, 13)])
def test_tau_b_with_ties(spark, monkeypatch, block, parts):
    monkeypatch.setattr(RC, "BLOCK", block)
    monkeypatch.setattr(RC, "PARTS", parts)
    rng = np.random.default_rng(1)
    groups = {0: (rng.integers(0, 5, 60), rng.integers(0, 9, 60)), 1: (rng.normal(size=90), rng.normal(size=90)), 2: (np.arange(40), -np.arange(40)), 3: (np.ones(20), np.arange(20)), 4: ([1, 2], [3, 4])}
    x, y = groups[1]
    groups[5] = (x, x * 0.5 + y)
    rows = [(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)]
    got = {r["g"]: (r["n"], r["tau"]) for r in RC.kendall_tau_b(spark.createDataFrame(rows, "g int, x double, y double").repartition(4)).collect()}
    for g, (x, y) in groups.items():
        want = brute(x, y) if len(x) >= 10 else None
        assert got[g][0] == len(x) and (got[g][1] is None if want is None else np.isclose(got[g][1], want)), g


def test_matrix_takes_complete_rows_and_has_no_pair_join(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a) if k % 7 else None, float(b) if k % 5 else None) for k, (a, b) in enumerate(rng.integers(0, 30, (120, 2)))]
    df = spark.createDataFrame(rows, "a double, b double")
    found = correlation_matrix(df, ["a", "b"], "kendall")
    got = {(r["var1"], r["var2"]): r["corr"] for r in found.collect()}
    full = [r for r in rows if None not in r]
    assert np.isclose(got["a", "b"], brute(*zip(*full))) and got["a", "b"] == got["b", "a"] and np.isclose(got["a", "a"], 1.0)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert all(r["corr"] is None for r in correlation_matrix(df.limit(0), ["a", "b"], "kendall").collect())
