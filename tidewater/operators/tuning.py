"""Cross validation and grid search on folds of global positions (EV4, T1, T2).

The rows, their positions and feature vectors are written once to the shared
checkpoint folder; every fit reads its part of them there by position, and a
fold's rows are predicted once, by all models of that fold in one pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.global_order import with_global_position
from ..session import reliable_checkpoint
from .bootstrap import ESTIMATORS, SEEDED, assembled
from .evaluate import cv_scores


def parameter_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every choice of one value per parameter, the last parameter fastest."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def fold_bounds(n: int, n_splits: int, method: str = "timeseries") -> list[tuple[int, int]]:
    """The positions [start, stop) that each fold tests.  ``timeseries``: the
    last ``n_splits`` blocks of n // (n_splits + 1) rows, trained on all rows
    before; ``kfold``: ``n_splits`` blocks, the first n % n_splits of them a
    row longer, trained on all other rows."""
    if method == "timeseries":
        size = n // (n_splits + 1)
        if size == 0:
            raise ValueError(f"{n} rows are too few for {n_splits} folds")
        return [(n - (n_splits - i) * size, n - (n_splits - i - 1) * size) for i in range(n_splits)]
    if method != "kfold":
        raise ValueError(f"unknown method {method!r}")
    if n < n_splits:
        raise ValueError(f"{n} rows are too few for {n_splits} folds")
    edges = [i * (n // n_splits) + min(i, n % n_splits) for i in range(n_splits + 1)]
    return list(zip(edges, edges[1:]))


def fold_predictions(df: DataFrame, features: Sequence[str], label: str, order_by: Sequence[str],
                     candidates: Mapping[str, tuple[str, Mapping]], n_splits: int = 5,
                     method: str = "timeseries", row_id: str = "row_id", seed: int = 42,
                     parallelism: int = 4) -> DataFrame:
    """Out-of-fold predictions, long: (model_name, fold, row_id, actual,
    predicted), one row per candidate and tested row.

    ``candidates``: name -> (kind of estimator, its parameters).  Rows without
    a label take no part; positions follow ``order_by``, which should be
    unique.  ``parallelism`` fits are under way at a time.
    """
    d = placed(df, features, label, order_by, row_id)
    return placed_fold_predictions(d, d.count(), candidates, n_splits, method, seed, parallelism).drop("__pos")


def placed(df: DataFrame, features: Sequence[str], label: str, order_by: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """The labelled rows as (__pos, row_id, actual, __features), written once;
    ``__pos`` is the 0-based position in ``order_by``."""
    known = df.where(F.col(label).isNotNull())
    d = with_global_position(known, list(order_by), "__pos")
    return reliable_checkpoint(assembled(d, features, [
        F.col("__pos"), F.col(row_id).alias("row_id"), F.col(label).cast("double").alias("actual")]))


def near_rows_together(df: DataFrame, features: Sequence[str], deal_by: Sequence[str], cells: int = 32) -> DataFrame:
    """The rows dealt evenly by ``deal_by`` and ordered within a partition by
    the cell of each feature (``cells`` steps over its mean +/- 2 standard
    deviations), then by ``deal_by``.  Only the order of the rows depends on it."""
    one = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    order = [F.floor((F.col(c) - one[f"m{i}"]) / one[f"s{i}"] * (cells / 4)) for i, c in enumerate(features) if one[f"s{i}"]]
    return df.repartition(*deal_by).sortWithinPartitions(*order, *deal_by)


def fit_all(jobs: Mapping, candidates: Mapping[str, tuple[str, Mapping]], seed: int = 42, parallelism: int = 4) -> dict:
    """Fits each job once: key -> (candidate's name, rows of ``placed``);
    ``parallelism`` fits are under way at a time.  Returns key -> model."""
    def fit(job: tuple[str, DataFrame]):
        name, rows = job
        kind, params = candidates[name]
        est = ESTIMATORS[kind](featuresCol="__features", labelCol="actual", **({"seed": seed} if kind in SEEDED else {}), **params)
        return est.fit(rows)

    if not jobs:
        return {}
    spark = next(iter(jobs.values()))[1].sparkSession
    pool = ThreadPool(parallelism)
    try:
        return dict(zip(jobs, pool.map(inheritable_thread_target(spark)(fit), jobs.values())))
    finally:
        pool.close()


def predicted_by(models: Sequence, rows: DataFrame) -> DataFrame:
    """``rows`` of ``placed`` with __p0, __p1, ..., one column per model, from one pass."""
    for i, m in enumerate(models):
        rows = m.copy().setPredictionCol(f"__p{i}").transform(rows)
    return rows


def placed_fold_predictions(d: DataFrame, n: int, candidates: Mapping[str, tuple[str, Mapping]], n_splits: int = 5,
                            method: str = "timeseries", seed: int = 42, parallelism: int = 4) -> DataFrame:
    """``fold_predictions`` of the rows of ``placed`` at positions 0 to ``n`` - 1, with ``__pos``."""
    bounds = fold_bounds(n, n_splits, method)

    def tested(fold: int) -> Column:
        start, stop = bounds[fold]
        return (F.col("__pos") >= start) & (F.col("__pos") < stop)

    jobs = {(fold, name): (name, d.where(F.col("__pos") < bounds[fold][0] if method == "timeseries" else ~tested(fold)))
            for fold in range(n_splits) for name in candidates}
    models = fit_all(jobs, candidates, seed, parallelism)

    out = None
    for fold in range(n_splits):
        part = predicted_by([models[fold, name] for name in candidates], d.where(tested(fold)))
        each = F.array(*[F.struct(F.lit(name).alias("model_name"), F.col(f"__p{i}").alias("predicted"))
                         for i, name in enumerate(candidates)])
        part = part.select("__pos", "row_id", "actual", F.explode(each).alias("x")).select(
            "x.model_name", F.lit(fold).alias("fold"), "row_id", "actual", "x.predicted", "__pos")
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------------- EV4
def cross_validate(df: DataFrame, features: Sequence[str], label: str, order_by: Sequence[str],
                   candidates: Mapping[str, tuple[str, Mapping]], **how) -> DataFrame:
    """EV4: mse, mae, r2 and rmse of each candidate over the folds (mean, std,
    least and greatest; see ``fold_predictions`` for the rest of ``how``)."""
    return cv_scores(fold_predictions(df, features, label, order_by, candidates, **how))


# ---------------------------------------------------------------------- T1, T2
def grid_search(df: DataFrame, features: Sequence[str], label: str, order_by: Sequence[str], kind: str,
                grid: Mapping[str, Sequence], n_splits: int = 5, method: str = "kfold", **how) -> DataFrame:
    """A row per choice of the grid: its place in the grid, its
    parameters as texts, the mean and std of its mse over the folds, and its
    rank (least mean mse first, ties to the earlier choice; 1 is the best).
    The number of choices is the caller's, so the rank's window is small."""
    from pyspark.sql import Window
    choices = parameter_grid(grid)
    scores = cross_validate(df, features, label, order_by, {str(i): (kind, c) for i, c in enumerate(choices)},
                            n_splits=n_splits, method=method, **how)
    texts = F.create_map(*[x for i, c in enumerate(choices) for x in (
        F.lit(str(i)), F.create_map(*[y for k, v in c.items() for y in (F.lit(k), F.lit(str(v)))]))])
    s = scores.select(F.col("model_name").cast("int").alias("choice"), texts[F.col("model_name")].alias("parameters"),
                      "mse_mean", "mse_std", "rmse_mean", "r2_mean")
    return s.withColumn("rank", F.row_number().over(Window.orderBy("mse_mean", "choice")))


def best_parameters(searched: DataFrame, grid: Mapping[str, Sequence]) -> dict:
    """The parameters (as given in the grid) of the row of rank 1."""
    return parameter_grid(grid)[searched.where("rank = 1").first()["choice"]]
