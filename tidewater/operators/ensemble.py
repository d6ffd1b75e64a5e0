"""The ensemble pipeline (E7): train, predict out of fold, combine, choose, score.

The labelled rows are placed in order and written once; by position the first
part trains, the next chooses between the ensemble types, and the last one
only scores.  Weights and meta-learner come from out-of-fold predictions of
the training part, so no row both shapes an ensemble and judges it.  Every
model is fitted once, and all of them are applied to the held-back rows in one
pass, written once as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .evaluate import simple_metrics
from .ml import diversity, dynamic_weights, error_gram, final_dynamic_weights, optimize_weights
from .tuning import fit_all, placed, placed_fold_predictions, predicted_by

TYPES = ("weighted", "stacking", "dynamic")


@dataclass
class Ensemble:
    """``models``: the components, fitted on the training part.  ``combined``:
    ensemble type -> (intercept, weight of each component).  ``chosen``: the
    type with the least validation rmse.  ``predictions``: long, every
    component and type on validation and test rows.  ``scores``: a row per
    model and split.  ``diversity``: E4 of the components on the test rows."""

    models: dict
    combined: dict[str, tuple[float, dict[str, float]]]
    chosen: str
    predictions: DataFrame
    scores: DataFrame
    diversity: DataFrame


def combine_out_of_fold(oof: DataFrame, names: Sequence[str], types: Sequence[str] = TYPES) -> dict:
    """How each ensemble type combines the components, learned from long
    out-of-fold predictions (model_name, row_id, __pos, actual, predicted).

    ``weighted`` minimises the squared error on the simplex (E2); ``stacking``
    is a linear regression on the components (E3); ``dynamic`` takes the
    weights of the last whole enough batch in order of position (E5) and is
    left out where the rows are too few for any.
    """
    out: dict[str, tuple[float, dict[str, float]]] = {}
    for kind in types:
        if kind == "weighted":
            out[kind] = 0.0, dict(zip(names, optimize_weights(error_gram(oof, names))))
        elif kind == "stacking":
            wide = oof.groupBy("row_id").pivot("model_name", list(names)).agg(F.first("predicted"))
            # a row's actual value is the same whichever component predicts it
            wide = wide.join(oof.where(F.col("model_name") == names[0]).select("row_id", "actual"), "row_id")
            vectors = VectorAssembler(inputCols=list(names), outputCol="__meta").transform(wide)
            meta = LinearRegression(featuresCol="__meta", labelCol="actual").fit(vectors.select("__meta", "actual"))
            out[kind] = float(meta.intercept), dict(zip(names, map(float, meta.coefficients)))
        elif kind == "dynamic":
            last = {r["model_name"]: r["weight"] for r in  # a row per component
                    final_dynamic_weights(dynamic_weights(oof, order_by="__pos")).collect()}
            if last:
                out[kind] = 0.0, {name: last.get(name, 0.0) for name in names}
        else:
            raise ValueError(f"unknown ensemble type {kind!r}")
    return out


def ensemble_pipeline(df: DataFrame, features: Sequence[str], label: str, order_by: Sequence[str],
                      candidates: Mapping[str, tuple[str, Mapping]], types: Sequence[str] = TYPES,
                      row_id: str = "row_id", n_splits: int = 5, ratios: Sequence[float] = (0.7, 0.15),
                      seed: int = 42, parallelism: int = 4) -> Ensemble:
    """E7.  ``candidates``: name -> (kind of estimator, its parameters), two or
    more.  ``order_by`` and ``row_id`` should be unique; rows without a label
    take no part.  Train and validation end at the floor of n times the
    cumulative ``ratios``; each of the three parts needs a row, and training
    ``n_splits`` of them.  Types tie in the order of ``types``.
    """
    names = list(candidates)
    if len(names) < 2:
        raise ValueError("an ensemble needs at least two components")
    if clash := set(names) & set(types):
        raise ValueError(f"components named as ensemble types: {sorted(clash)}")
    d = placed(df, features, label, order_by, row_id)
    n = d.count()
    trained, validated = int(n * ratios[0]), int(n * (ratios[0] + ratios[1]))
    if not 0 < trained < validated < n:
        raise ValueError(f"{n} rows are too few for the three parts")
    train = d.where(F.col("__pos") < trained)

    oof = reliable_checkpoint(placed_fold_predictions(train, trained, candidates, n_splits, "kfold", seed, parallelism))
    combined = combine_out_of_fold(oof, names, types)
    if not combined:
        raise ValueError(f"{trained} training rows are too few for {list(types)}")
    models = fit_all({name: (name, train) for name in names}, candidates, seed, parallelism)

    held = predicted_by([models[name] for name in names], d.where(F.col("__pos") >= trained))

    def mixed(intercept: float, weights: Mapping[str, float]) -> Column:
        return sum((F.lit(weights[name]) * F.col(f"__p{i}") for i, name in enumerate(names)), F.lit(intercept))

    values = {name: F.col(f"__p{i}") for i, name in enumerate(names)} | {kind: mixed(*c) for kind, c in combined.items()}
    each = F.array(*[F.struct(F.lit(k).alias("model_name"), F.lit("ensemble" if k in combined else "component").alias("role"),
                              v.alias("predicted")) for k, v in values.items()])
    split = F.when(F.col("__pos") < validated, "validation").otherwise("test")
    preds = reliable_checkpoint(held.select("row_id", "actual", split.alias("split"), F.explode(each).alias("x"))
                                    .select("x.model_name", "x.role", "split", "row_id", "actual", "x.predicted"))

    scores = simple_metrics(preds, ["model_name", "role", "split"], "nonzero")
    # a row per ensemble type
    rmse = {r["model_name"]: r["rmse"] for r in
            scores.where((F.col("split") == "validation") & (F.col("role") == "ensemble")).collect()}
    chosen = min(combined, key=rmse.__getitem__)
    tested = preds.where((F.col("split") == "test") & (F.col("role") == "component"))
    return Ensemble(models, combined, chosen, preds, scores.withColumn("chosen", F.col("model_name") == chosen),
                    diversity(tested, names))
