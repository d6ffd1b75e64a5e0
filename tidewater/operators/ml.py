"""Spark ML training and ensembles.

Models are Spark ML estimators fitted on distributed DataFrames; the only
driver-side numerics are tiny (k x k Gram matrix for the weight QP).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

#: Forests keep each row's node of each tree between levels, not the trees to
#: walk again (the same trees); the last of the few levels needs no checkpoint.
FOREST = {"numTrees": 100, "maxDepth": 10, "cacheNodeIds": True, "checkpointInterval": 20}


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, kind: str = "random_forest",
                  seed: int = 42):
    """Random forest (100 trees, depth 10) or GBT (100 iterations,
    depth 6, step .1) behind a vector assembler (NULL features -> 0)."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    if kind == "random_forest":
        est = RandomForestRegressor(labelCol=label, seed=seed, **FOREST)
    else:
        est = GBTRegressor(labelCol=label, maxIter=100, maxDepth=6, stepSize=0.1, seed=seed)
    return Pipeline(stages=[asm, est]).fit(train.fillna(0.0, subset=list(features)))


def predict_long(model, df: DataFrame, features: Sequence[str], label: str, model_name: str,
                 row_id: str = "row_id") -> DataFrame:
    """Predictions in the long evaluation format."""
    p = model.transform(df.fillna(0.0, subset=list(features)))
    return p.select(F.lit(model_name).alias("model_name"), F.col(row_id).alias("row_id"),
                    F.col(label).cast("double").alias("actual"), F.col("prediction").alias("predicted"))


def feature_importance(model, features: Sequence[str], model_name: str, spark) -> DataFrame:
    """(model, feature, importance) from the fitted tree ensemble."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(model_name, f, float(v)) for f, v in zip(features, imp)],
                                 "model string, feature string, importance double")


def weighted_ensemble(preds: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """sum(w * p) / sum(w) over the models present for each row."""
    wmap = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    w = wmap[F.col("model_name")]
    return (preds.where(w.isNotNull())
                 .groupBy("row_id").agg(F.first("actual").alias("actual"),
                                        (F.sum(w * F.col("predicted")) / F.sum(w)).alias("predicted"),
                                        F.count(F.lit(1)).alias("n_models")))


def prediction_spread(preds: DataFrame) -> DataFrame:
    """Mean and population std of the models' predictions per row."""
    return preds.groupBy("row_id").agg(F.avg("predicted").alias("mean_prediction"),
                                       F.stddev_pop("predicted").alias("std_prediction"))


def error_gram(preds: DataFrame, models: Sequence[str]) -> list[list[float]]:
    """E2 input: k x k matrix of mean error products, one aggregation."""
    wide = preds.groupBy("row_id").pivot("model_name", list(models)).agg(
        F.first(F.col("actual") - F.col("predicted")))
    aggs = [F.avg(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models)]
    row = wide.agg(*aggs).first()
    k = len(models)
    return [[row[f"{i}_{j}"] for j in range(k)] for i in range(k)]


def optimize_weights(gram: list[list[float]], tolerance: float = 1e-13, max_steps: int = 1_000_000) -> list[float]:
    """Minimise w' G w on the simplex (w >= 0, sum 1) by projected
    gradient until no weight moves by more than ``tolerance``; k is the number
    of models (<= 10), so this is driver math on a k x k matrix.  Entries that
    are missing or not finite, and weights that don't settle, are errors."""
    import numpy as np
    g = np.asarray(gram, dtype=float)
    if not np.isfinite(g).all():
        raise ValueError("two models without a common row, or with an error that is not finite")
    k = g.shape[0]
    w = np.full(k, 1.0 / k)
    step = 1.0 / (2 * max(np.linalg.eigvalsh(g).max(), 1e-12))
    for _ in range(max_steps):
        before = w
        w = w - step * 2 * g @ w
        # Euclidean projection onto the simplex
        u = np.sort(w)[::-1]
        css = np.cumsum(u)
        rho = np.nonzero(u * np.arange(1, k + 1) > (css - 1))[0][-1]
        w = np.maximum(w - (css[rho] - 1) / (rho + 1.0), 0)
        if np.abs(w - before).max() <= tolerance:
            return w.tolist()
    raise ArithmeticError(f"the weights still move after {max_steps} steps")


def diversity(preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean pairwise correlation of predictions, mean per-row
    population std across models, and Yule-like q for each pair."""
    wide = preds.groupBy("row_id").pivot("model_name", list(models)).agg(F.first("predicted"))
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    cols = [F.corr(a, b).alias(f"corr_{a}_{b}") for a, b in pairs]
    cols += [(F.avg(F.abs(F.col(a) - F.col(b))) / (F.stddev_pop(a) + F.stddev_pop(b) + 1e-8)).alias(f"q_{a}_{b}")
             for a, b in pairs]
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    var = sum(((F.col(m) - mean) ** 2 for m in models), F.lit(0.0)) / len(models)
    return wide.agg(*cols, F.avg(F.sqrt(var)).alias("mean_row_std"))


def date_cutoff(df: DataFrame, share: float = 0.7, date_col: str = "date") -> str:
    """The day (as text) that parts the table's days at ``share`` of its span."""
    span = F.datediff(F.max(date_col), F.min(date_col))
    r = df.agg(F.date_add(F.min(date_col), F.ceil(span * share).cast("int")).cast("string").alias("d")).first()
    return r["d"]


# -------------------------------------------------------------------------- T3
def per_segment_models(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                       segments: Sequence[str], min_rows: int = 50, kind: str = "gbt", row_id: str = "row_id"):
    """One distributed fit per segment with more than ``min_rows`` rows;
    predictions routed by segment; unseen segments get the mean of the
    other predictions.  Returns the long prediction frame.  Every fit reads
    its segment from rows written once, and so does the mean its predictions."""
    parts = []
    train, test = reliable_checkpoint(train), reliable_checkpoint(test)
    counts = {r["segment"]: r["n"] for r in train.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    for s in segments:
        if counts.get(s, 0) > min_rows:
            m = fit_regressor(train.where(F.col("segment") == s), features, label, kind)
            parts.append(m.transform(test.where(F.col("segment") == s).fillna(0.0, subset=list(features)))
                          .select(row_id, "segment", F.col(label).cast("double").alias("actual"),
                                  F.col("prediction").alias("predicted")))
    base = test.select(row_id, "segment", F.col(label).cast("double").alias("actual"))
    if not parts:
        return base.select("*", F.lit(None).cast("double").alias("predicted"))
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    pred = reliable_checkpoint(pred)
    fallback = pred.agg(F.avg("predicted")).scalar()
    return (base.join(pred.select(row_id, "predicted"), row_id, "left")
                .select(row_id, "segment", "actual", F.coalesce(F.col("predicted"), fallback).alias("predicted")))


# -------------------------------------------------------------------------- T4
def risk_class_label(target: str, std: Column | float) -> Column:
    """5 classes from the target cut at +/-.5 and +/-2 std (right-closed):
    0 (<= -2s), 1 (-2s, -.5s], 2 (-.5s, .5s], 3 (.5s, 2s], 4 (> 2s)."""
    t = F.col(target)
    s = F.lit(std) if not isinstance(std, Column) else std
    return (F.when(t <= -2 * s, 0).when(t <= -0.5 * s, 1).when(t <= 0.5 * s, 2).when(t <= 2 * s, 3)
             .when(t.isNotNull(), 4)).cast("double")


def fit_risk_classifier(train: DataFrame, features: Sequence[str], target: str, seed: int = 42):
    """Random forest classifier (100 trees, depth 10) on the 5-class label."""
    from pyspark.ml.classification import RandomForestClassifier
    sd = train.agg(F.stddev_samp(target)).first()[0] or 1.0
    d = train.select("*", risk_class_label(target, sd).alias("risk_class")).where(F.col("risk_class").isNotNull())
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    clf = RandomForestClassifier(labelCol="risk_class", seed=seed, **FOREST)
    return Pipeline(stages=[asm, clf]).fit(d.fillna(0.0, subset=list(features))), sd


# -------------------------------------------------------------------------- T6
def tree_intervals(model, df: DataFrame, features: Sequence[str], z: float = 1.96) -> DataFrame:
    """Prediction interval from the spread of a random forest's trees:
    mean +/- z * population std of the per-tree predictions (each tree is
    applied as a Spark ML model; trees are part of the fitted model)."""
    asm_df = model.stages[0].transform(df.fillna(0.0, subset=list(features)))
    forest = model.stages[-1]
    cols = []
    d = asm_df
    for i, tree in enumerate(forest.trees):
        d = tree.setPredictionCol(f"__t{i}").transform(d)
        cols.append(F.col(f"__t{i}"))
    n = len(cols)
    mean = sum(cols, F.lit(0.0)) / n
    var = sum(((c - mean) ** 2 for c in cols), F.lit(0.0)) / n
    out = d.select(*df.columns, mean.alias("prediction"), F.sqrt(var).alias("__sd"))
    return out.select("*", (F.col("prediction") - z * F.col("__sd")).alias("lower"),
                      (F.col("prediction") + z * F.col("__sd")).alias("upper")).drop("__sd")


# -------------------------------------------------------------------------- T8
def expanding_window_stability(df: DataFrame, features: Sequence[str], label: str, order_by: Sequence[str],
                               n_splits: int = 5, kind: str = "random_forest") -> DataFrame:
    """Fit on each expanding fold (L6), score on its test block (folds by
    global position), then rmse mean/std/cv and r2 mean/std (population).

    The rows are written once, dealt by a hash of their position, so that a
    fold's rows, which are those of the first positions, lie in all partitions;
    in a partition rows of similar features are neighbours, which take the
    same ways through the trees."""
    from ..plans.global_order import with_global_position
    from .sampling import fold_start
    from .tuning import near_rows_together
    d = with_global_position(df, list(order_by), "__pos").fillna(0.0, subset=list(features))
    d = reliable_checkpoint(near_rows_together(d.select("__pos", label, *features), features, ["__pos"]))
    n = d.count()
    scores = []
    for i in range(n_splits):
        start, stop = fold_start(n, n_splits, i), fold_start(n, n_splits, i + 1)
        m = fit_regressor(d.where(F.col("__pos") < start), features, label, kind)
        p = m.transform(d.where((F.col("__pos") >= start) & (F.col("__pos") < stop)))
        r = F.col(label) - F.col("prediction")
        scores.append(p.agg(F.lit(i).alias("fold"), F.sqrt(F.avg(r * r)).alias("rmse"),
                            (1 - F.sum(r * r) / (F.var_pop(label) * F.count(label))).alias("r2")))
    s = scores[0]
    for x in scores[1:]:
        s = s.unionByName(x)
    return s.agg(F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
                 (F.stddev_pop("rmse") / F.avg("rmse")).alias("rmse_cv"),
                 F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"))


# -------------------------------------------------------------------------- E3
def stacking(df: DataFrame, features: Sequence[str], label: str, row_id: str = "row_id",
             kinds: Sequence[str] = ("random_forest", "gbt"), k: int = 5, seed: int = 42) -> DataFrame:
    """Out-of-fold base predictions (fold = pmod(xxhash64(row_id, seed), k)),
    then a linear meta-learner on them; returns the meta predictions."""
    from pyspark.ml.regression import LinearRegression
    d = df.select("*", F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(k)).alias("__fold"))
    oof = None
    for kind in kinds:
        parts = []
        for f in range(k):
            m = fit_regressor(d.where(F.col("__fold") != f), features, label, kind)
            parts.append(m.transform(d.where(F.col("__fold") == f).fillna(0.0, subset=list(features)))
                          .select(row_id, F.col("prediction").alias(f"p_{kind}")))
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        oof = u if oof is None else oof.join(u, row_id)
    meta_in = oof.join(d.select(row_id, F.col(label).cast("double").alias("label")), row_id)
    asm = VectorAssembler(inputCols=[f"p_{k_}" for k_ in kinds], outputCol="mf")
    lr = Pipeline(stages=[asm, LinearRegression(featuresCol="mf", labelCol="label")]).fit(meta_in)
    return lr.transform(meta_in).select(row_id, F.col("label").alias("actual"), F.col("prediction").alias("predicted"))


# -------------------------------------------------------------------------- E5
def dynamic_weights(preds: DataFrame, batch: int = 20, min_batch: int = 10, by: str = "model_name",
                    order_by: str = "row_id") -> DataFrame:
    """Batches of ``batch`` rows from position max(n/2, 100); batches with
    fewer than ``min_batch`` rows are skipped; per batch weights are
    1/(rmse + 1e-8) normalised over models.  Long (batch, model, weight);
    the final weights are those of the last valid batch."""
    from .evaluate import positioned
    p = positioned(preds, by, order_by)
    start = F.greatest(F.floor(F.col("n") / 2), F.lit(100))
    d = p.where(F.col("pos") >= start).select(by, F.floor((F.col("pos") - start) / batch).alias("batch"),
                                              "actual", "predicted")
    g = d.groupBy("batch", by).agg(F.count(F.lit(1)).alias("rows"),
                                   F.sqrt(F.avg((F.col("actual") - F.col("predicted")) ** 2)).alias("rmse"))
    g = g.where(F.col("rows") >= min_batch)
    inv = g.select("batch", by, (1 / (F.col("rmse") + 1e-8)).alias("__i"))
    tot = inv.groupBy("batch").agg(F.sum("__i").alias("__t"))
    return inv.join(tot, "batch").select("batch", by, (F.col("__i") / F.col("__t")).alias("weight"))


def final_dynamic_weights(weights: DataFrame, by: str = "model_name") -> DataFrame:
    last = weights.agg(F.max("batch")).scalar()
    return weights.where(F.col("batch") == last).select(by, "weight")


# ------------------------------------------------------------------------- EV7
def bootstrap_stability(df: DataFrame, features: Sequence[str], label: str, test: DataFrame,
                        n_boot: int = 100, fraction: float = 0.8, kind: str = "random_forest") -> DataFrame:
    """Refit on ``n_boot`` bootstrap samples (with replacement, seeded),
    score each on the same test set; per metric mean/std/cv/min/max."""
    scores = []
    for i in range(n_boot):
        m = fit_regressor(df.sample(True, fraction, seed=i), features, label, kind, seed=i)
        p = m.transform(test.fillna(0.0, subset=list(features)))
        r = F.col(label) - F.col("prediction")
        scores.append(p.agg(F.lit(i).alias("run"), F.sqrt(F.avg(r * r)).alias("rmse"),
                            F.avg(F.abs(r)).alias("mae"),
                            (1 - F.sum(r * r) / (F.var_pop(label) * F.count(label))).alias("r2")))
    s = scores[0]
    for x in scores[1:]:
        s = s.unionByName(x)
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rmse", "mae", "r2")])
    long = s.select(F.explode(arr).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      (F.stddev_pop("value") / F.avg("value")).alias("cv"),
                                      F.min("value").alias("min"), F.max("value").alias("max"))
