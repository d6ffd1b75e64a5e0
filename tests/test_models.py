"""Forests and folds: rows written once, node ids kept, folds dealt evenly."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidewater.operators import ml as ML
from tidewater.operators import sampling as SA
from tidewater.operators import tuning as TU
from tidewater.plans import q_extra as Q

FEATS = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 2))
    rows = [(i, f"S{i % 2}", float(x[i, 0]), None if i == 5 else float(x[i, 1]), float(x[i, 0] * 2 + x[i, 1] + r.normal())) for i in range(600)]
    return spark.createDataFrame(rows, "row_id long, segment string, a double, b double, y double").coalesce(2)


def test_kept_node_ids_give_the_same_trees(spark, table):
    """The forest itself does not change."""
    forest = ML.fit_regressor(table, FEATS, "y").stages[-1]
    assert forest.getCacheNodeIds() and forest.getNumTrees == 100 and forest.getMaxDepth() == 10
    d = VectorAssembler(inputCols=FEATS, outputCol="features", handleInvalid="keep").transform(table.fillna(0.0, subset=FEATS))
    own = RandomForestRegressor(labelCol="y", numTrees=100, maxDepth=10, seed=42).fit(d)
    assert forest.toDebugString.split("\n")[1:] == own.toDebugString.split("\n")[1:]
    clf, _ = ML.fit_risk_classifier(table, FEATS, "y")
    assert clf.stages[-1].getCacheNodeIds()


def test_model_features_are_written_once(spark):
    d, feats = Q._flow_features(spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "Exchange" not in plan and "Window" not in plan


def test_segments_read_rows_written_once(spark, table, monkeypatch):
    plans, fit = [], ML.fit_regressor

    def seen(train, *rest):
        plans.append(train._jdf.queryExecution().executedPlan().toString())
        return fit(train, *rest)

    monkeypatch.setattr(ML, "fit_regressor", seen)
    d = table.repartition(3, "row_id")
    out = ML.per_segment_models(d.where("row_id < 400"), d.where("row_id >= 400"), FEATS, "y", ["S0"], kind="random_forest").toPandas()
    assert len(plans) == 1 and "Exchange" not in plans[0]
    known, other = out[out["segment"] == "S0"], out[out["segment"] == "S1"]
    assert len(known) == len(other) == 100
    assert np.allclose(other["predicted"], known["predicted"].mean())


def test_folds_lie_in_all_partitions(spark, table, monkeypatch):
    """Every fold has the rows of L6, dealt over all partitions."""
    seen, fit = [], ML.fit_regressor

    def noted(train, *rest):
        per = train.groupBy(F.spark_partition_id()).count().collect()
        seen.append((sum(r["count"] for r in per), len(per)))
        return fit(train, FEATS, "y") if len(seen) == 1 else noted.first

    monkeypatch.setattr(ML, "fit_regressor", lambda *a: setattr(noted, "first", noted(*a)) or noted.first)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ML.expanding_window_stability(table.limit(599), FEATS, "y", ["row_id"], 5).first()
        folds = SA.expanding_folds(table.limit(599), ["row_id"], 5).groupBy("fold", "role").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {(r["fold"], r["role"]): r["count"] for r in folds}
    assert [n for n, _ in seen] == [want[i, "train"] for i in range(5)] == [SA.fold_start(599, 5, i) for i in range(5)]
    assert all(want[i, "test"] == SA.fold_start(599, 5, i + 1) - SA.fold_start(599, 5, i) for i in range(5))
    assert all(parts == 8 for _, parts in seen)
    assert got["rmse_mean"] > 0 and got["r2_mean"] > 0


def test_near_rows_are_the_same_rows(spark, table):
    d = table.fillna(0.0, subset=FEATS).withColumn("c", F.lit(1.0))
    near = TU.near_rows_together(d, [*FEATS, "c"], ["row_id"])
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, d.collect()))
