"""Refits on bootstrap replicates (T7, EV7) and combined importances.

A replicate is a Poisson weight per row, drawn from a hash of the row's id,
the replicate and a seed: no resampled copy of the table is made, and a row
has the same weight however the table is partitioned or re-read.  The
training rows are written once to the shared checkpoint folder; every fit
reads them there, and all replicate models are applied in one pass.

A linear least-squares fit depends on its rows only by their weighted moments,
so those of all replicates come from one pass over the rows (T7).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .reports import feature_category

ESTIMATORS = {"linear": LinearRegression, "decision_tree": DecisionTreeRegressor,
              "random_forest": RandomForestRegressor, "gbt": GBTRegressor}
SEEDED = ("decision_tree", "random_forest", "gbt")


def poisson_steps(rate: float) -> list[float]:
    """The steps of Poisson(``rate``)'s distribution function, as far as 53 bits tell them from 1."""
    steps, term, below = [], math.exp(-rate), 0.0
    for k in range(1, 64):
        below += term
        term *= rate / k
        if below >= 1.0 - 2.0 ** -53:
            break
        steps.append(below)
    return steps


def replicate_weight(row_id: Column, replicate: int, rate: float = 1.0, seed: int = 42) -> Column:
    """Poisson(``rate``) draw of a row in a replicate: the number of steps of
    the distribution function at or below a uniform hash of 53 bits."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(replicate), row_id), 11) / float(2 ** 53)
    return F.size(F.filter(F.array(*[F.lit(s) for s in poisson_steps(rate)]), lambda s: s <= u)).cast("double")


def assembled(df: DataFrame, features: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """``keep`` and the feature vector (NULL features are 0)."""
    asm = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="keep")
    return asm.transform(df.fillna(0.0, subset=list(features))).select(*keep, "__features")


def replicate_moments(d: DataFrame, center: Sequence[float], n: int, rate: float = 1.0, seed: int = 42) -> DataFrame:
    """Weighted sums of all products of two of (1, features, label), the last
    two less their ``center``, in each of ``n`` replicates: rows (at, value),
    ``at`` = replicate * number of products + product (upper triangle by rows).
    One pass over ``d`` (__id, __label, __features); a partition gives one row
    to the sum."""
    import numpy as np
    steps, middle = np.array(poisson_steps(rate)), np.array(center, dtype=float)
    left, right = np.triu_indices(len(middle) + 1)
    draws = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.xxhash64(F.lit(seed), r, F.col("__id")))

    def sums(batches):
        import pyarrow as pa
        total = np.zeros((n, len(left)))
        for b in batches:
            rows = b.num_rows
            u = (b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)) / float(2 ** 53)
            w = np.searchsorted(steps, u, side="right").reshape(rows, n).astype(float)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows, len(middle)) - middle
            v = np.hstack([np.ones((rows, 1)), v])
            some = max(2_000_000 // len(left), 1)   # rows whose products are in memory at a time
            for i in range(0, rows, some):
                part = v[i:i + some]
                total += w[i:i + some].T @ (part[:, left] * part[:, right])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

    values = F.concat(vector_to_array("__features"), F.array("__label"))
    parts = d.select(draws.alias("draws"), values.alias("row")).mapInArrow(sums, "sums array<double>")
    return parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))


def points_of_moments(total: float, mean, cov):
    """Rows (values, weight) whose weight, mean and population covariance are
    the given ones: two per dimension, at the mean +/- the scaled axes of the
    correlation matrix.  A value that does not vary is the same in all rows."""
    import numpy as np
    size = len(mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    varies = np.flatnonzero(scale > 1e-12 * np.abs(mean))
    axes = np.zeros((size, size))
    if len(varies):
        by = scale[varies]
        value, vector = np.linalg.eigh(cov[np.ix_(varies, varies)] / np.outer(by, by))
        value[value < 1e-12 * value.max()] = 0.0
        axes[np.ix_(varies, varies)] = by[:, None] * vector * np.sqrt(value)
    step = math.sqrt(size)
    return [(mean + sign * step * axes[:, j], total / (2 * size)) for j in range(size) for sign in (1.0, -1.0)]


def _replicate_points(d: DataFrame, n: int, rate: float, seed: int) -> list[list] | None:
    """Each replicate's ``points_of_moments``; None if there are no rows or a sum is not finite."""
    import numpy as np
    at = vector_to_array("__features")
    size = d.select(F.size(at).alias("n")).first()
    if size is None:
        return None
    center = d.agg(*[F.avg(at[i]) for i in range(size["n"])], F.avg("__label")).first()
    flat = np.array([r["value"] for r in replicate_moments(d, center, n, rate, seed).orderBy("at").collect()])
    if not np.isfinite(flat).all():
        return None
    k = len(center) + 1
    out = []
    for row in flat.reshape(n, -1):
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = row
        if m[0, 0] <= 0:
            return None
        mean = m[0, 1:] / m[0, 0]
        second = (m + np.triu(m, 1).T)[1:, 1:] / m[0, 0]
        points = points_of_moments(m[0, 0], mean + np.array(center), second - np.outer(mean, mean))
        out.append([(Vectors.dense(v[:-1]), float(v[-1]), float(w)) for v, w in points])
    return out


def replicate_models(train: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id",
                     n: int = 100, rate: float = 1.0, kind: str = "linear", seed: int = 42,
                     parallelism: int = 4, **params) -> list:
    """``n`` models of one ``kind``, each fitted on the rows weighted by their
    Poisson(``rate``) draws.  Rows without a label are left out; ``params`` go
    to the estimator.  ``parallelism`` fits are under way at a time.

    Linear models by normal equations (the estimator's own choice up to 4,096
    features) are fitted on a few rows with the moments of the replicate's
    rows, which come from one pass: the same coefficients, but the fit's
    summary is about those few rows."""
    d = assembled(train, features, [F.col(row_id).alias("__id"), F.col(label).cast("double").alias("__label")])
    d = reliable_checkpoint(d.where(F.col("__label").isNotNull()))

    normal = (kind == "linear" and len(features) <= 4096 and params.get("solver", "auto") in ("auto", "normal")
              and params.get("loss", "squaredError") == "squaredError")
    points = _replicate_points(d, n, rate, seed) if normal else None

    def fit(replicate: int):
        est = ESTIMATORS[kind](featuresCol="__features", labelCol="__label", weightCol="__weight",
                               **({"seed": seed + replicate} if kind in SEEDED else {}), **params)
        if points is not None:
            rows = train.sparkSession.createDataFrame(points[replicate], ["__features", "__label", "__weight"])
            return est.fit(rows.coalesce(1))
        weighted = d.withColumn("__weight", replicate_weight(F.col("__id"), replicate, rate, seed))
        return est.fit(weighted.where(F.col("__weight") > 0))

    pool = ThreadPool(parallelism)
    try:
        return pool.map(inheritable_thread_target(train.sparkSession)(fit), range(n))
    finally:
        pool.close()


def replicate_predictions(models: Sequence, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``predictions``, an array with one value per model, from
    one pass over the rows."""
    d = assembled(df, features, [F.col(c) for c in keep])
    for i, m in enumerate(models):
        d = m.copy().setPredictionCol(f"__p{i}").transform(d)
    return d.select(*keep, F.array(*[F.col(f"__p{i}") for i in range(len(models))]).alias("predictions"))


def _array_quantile(ascending: Column, n: int, q: float) -> Column:
    """Linear quantile of a sorted array of ``n`` values."""
    at = q * (n - 1)
    low = math.floor(at)
    first, second = ascending[low], ascending[min(low + 1, n - 1)]
    return first + (second - first) * (at - low)


# -------------------------------------------------------------------------- T7
def bootstrap_intervals(models: Sequence, df: DataFrame, features: Sequence[str], row_id: str = "row_id",
                        confidence: float = 0.95) -> DataFrame:
    """Per row the mean of the replicate models' predictions and their
    (1 - confidence) / 2 and (1 + confidence) / 2 quantiles."""
    n, tail = len(models), (1 - confidence) / 2
    p = replicate_predictions(models, df, features, [row_id]).select(row_id, F.sort_array("predictions").alias("a"))
    mean = F.aggregate("a", F.lit(0.0), lambda s, x: s + x) / n
    low, high = _array_quantile(F.col("a"), n, tail), _array_quantile(F.col("a"), n, 1 - tail)
    return p.select(row_id, mean.alias("prediction"), low.alias("lower"), high.alias("upper"))


# ------------------------------------------------------------------------- EV7
def replicate_scores(models: Sequence, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """rmse, mae and r2 of every replicate model on ``df``: long
    (replicate, metric, value), from one aggregation.  Rows without a label do
    not count; r2 of a constant label is NULL."""
    d = df.where(F.col(label).isNotNull()).withColumn("__y", F.col(label).cast("double"))
    p = replicate_predictions(models, d, features, ["__y"])
    sums = [F.var_pop("__y").alias("v")]
    for i in range(len(models)):
        r = F.col("__y") - F.col("predictions")[i]
        sums += [F.avg(r * r).alias(f"s{i}"), F.avg(F.abs(r)).alias(f"a{i}")]
    one = p.agg(*sums)
    rows = [F.struct(F.lit(i).alias("replicate"), F.lit(m).alias("metric"), v.alias("value"))
            for i in range(len(models))
            for m, v in (("rmse", F.sqrt(f"s{i}")), ("mae", F.col(f"a{i}")),
                         ("r2", 1 - F.try_divide(F.col(f"s{i}"), F.col("v"))))]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def replicate_importances(spark: SparkSession, models: Sequence, features: Sequence[str], model: str) -> DataFrame:
    """Long (replicate, model, feature, importance) table of tree models: one
    row per replicate and feature, so it is as small as the models."""
    rows = [(i, model, f, float(v)) for i, m in enumerate(models) for f, v in zip(features, m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "replicate int, model string, feature string, importance double")


def stability(scores: DataFrame, importances: DataFrame | None = None) -> DataFrame:
    """EV7: per metric the mean, population std, cv, least and greatest value
    and quartiles over the replicates; per feature the same of its importance,
    with cv = std / (mean + 1e-8) and ``stable`` where that is below 0.5."""
    def spread(d: DataFrame, kind: str, name: str, value: str, cv: Column, stable: Column) -> DataFrame:
        # a group holds one value per replicate
        g = d.groupBy(F.col(name).alias("name")).agg(
            F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
            F.max(value).alias("max"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.75).alias("q75"))
        return g.withColumn("cv", cv).select(F.lit(kind).alias("kind"), "name", "mean", "std", "cv", "min", "max",
                                             "q25", "q75", stable.alias("stable"))
    out = spread(scores, "metric", "metric", "value", F.try_divide(F.col("std"), F.col("mean")), F.lit(None).cast("boolean"))
    if importances is None:
        return out
    return out.unionByName(spread(importances, "importance", "feature", "importance",
                                  F.col("std") / (F.col("mean") + 1e-8), F.col("cv") < 0.5))


# -------------------------------------------------------------------------- T9
def combined_importance(importances: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Per feature the average, the weighted sum (models without a weight
    count 1) and the greatest of the models' importances, with the feature's
    category."""
    w = F.lit(1.0)
    for model, value in (weights or {}).items():
        w = F.when(F.col("model") == model, float(value)).otherwise(w)
    g = importances.groupBy("feature").agg(
        F.avg("importance").alias("average"), F.sum(F.col("importance") * w).alias("weighted"),
        F.max("importance").alias("greatest"), F.count(F.lit(1)).alias("n_models"))
    return g.withColumn("category", feature_category(F.col("feature")))


def category_importance(combined: DataFrame, value: str = "average") -> DataFrame:
    """Importance summed per category of features."""
    return combined.groupBy("category").agg(F.sum(value).alias("importance"), F.count(F.lit(1)).alias("n_features"))
