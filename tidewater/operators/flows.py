"""Flow aggregation operators.

Group-bys run as partial + final hash aggregation, so a hot customer or
segment is combined map-side before the shuffle; outputs are keyed by
(date, segment) or segment and are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import np_round, safe_div
from . import windows as W


def segment_daily_flows(flows: DataFrame, approx_customers: bool = False) -> DataFrame:
    """A1: per (date, segment) sums of flow/in/out, distinct active
    customers and net flow rate = flow / sum(balance_start) (NULL if 0)."""
    n_cust = (F.approx_count_distinct("customer_id") if approx_customers
              else F.countDistinct("customer_id"))
    return (flows.groupBy("date", "segment")
                 .agg(F.sum("deposit_flow").alias("deposit_flow"),
                      F.sum("inflow").alias("inflow"),
                      F.sum("outflow").alias("outflow"),
                      n_cust.alias("active_customers"),
                      F.sum("balance_start").alias("balance_start"))
                 .select("date", "segment", "deposit_flow", "inflow", "outflow", "active_customers",
                         safe_div(F.col("deposit_flow"), F.col("balance_start")).alias("net_flow_rate")))


def segment_behavioral_features(flows: DataFrame, windows: Sequence[int] = (7, 21, 63)) -> DataFrame:
    """A2: per (date, segment) flow statistics rounded to 4 (half-even),
    derived ratios, and rolling means/stds per segment over 7/21/63 rows."""
    g = (flows.groupBy("date", "segment")
              .agg(np_round(F.sum("deposit_flow"), 4).alias("segment_sum_deposit_flow"),
                   np_round(F.avg("deposit_flow"), 4).alias("segment_mean_deposit_flow"),
                   np_round(F.stddev_samp("deposit_flow"), 4).alias("segment_std_deposit_flow"),
                   F.count("deposit_flow").alias("segment_count_deposit_flow"),
                   np_round(F.sum("inflow"), 4).alias("segment_sum_inflow"),
                   np_round(F.sum("outflow"), 4).alias("segment_sum_outflow")))
    s, i, o = F.col("segment_sum_deposit_flow"), F.col("segment_sum_inflow"), F.col("segment_sum_outflow")
    g = g.select("*",
                 (s / (i + F.abs(o) + 1)).alias("segment_net_flow_rate"),
                 (i / (F.abs(o) + 1)).alias("segment_inflow_outflow_ratio"),
                 (F.col("segment_std_deposit_flow") / (F.abs(F.col("segment_mean_deposit_flow")) + 1))
                 .alias("segment_flow_volatility"))
    metrics = ["segment_sum_deposit_flow", "segment_net_flow_rate", "segment_flow_volatility"]
    return W.rolling_features(g, metrics, list(windows), ["date"], ["segment"],
                              stats=("ma", "std"), min_periods=1, name="{c}_{s}_{n}")


def grouped_summary(df: DataFrame, by: Sequence[str], value: str, digits: int | None = None) -> DataFrame:
    """A3: sum/mean/std/min/max/count of ``value`` per group."""
    aggs = [F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count")]
    out = df.groupBy(*by).agg(*aggs)
    if digits is not None:
        out = out.select(*by, *[np_round(c, digits).alias(c) for c in ("total", "mean", "std", "min", "max")],
                         "count")
    return out


def daily_totals(flows: DataFrame) -> DataFrame:
    """A4: flow by date: sum, count, inflow, outflow."""
    return (flows.groupBy("date")
                 .agg(F.sum("deposit_flow").alias("total_flow"), F.count("deposit_flow").alias("n_flows"),
                      F.sum("inflow").alias("total_inflow"), F.sum("outflow").alias("total_outflow")))


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """A5: count per value (nulls excluded as pandas), share if ``normalize``."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = df.agg(F.count(col)).scalar()
        counts = counts.select("*", (F.col("count") / total).alias("share"))
    return counts


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Non-null distinct count per column, long form (column, n_unique)."""
    f = F.approx_count_distinct if approx else F.countDistinct
    wide = df.agg(*[f(c).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("long")
                                                    .alias("n_unique")) for c in cols])).alias("s")) \
               .select("s.*")


def flow_stability_index(flows: DataFrame, by: Sequence[str] = (), value: str = "deposit_flow") -> DataFrame:
    """1 - std/mean(|flow|), clipped to [0, 1]."""
    r = 1 - safe_div(F.stddev_samp(value), F.avg(F.abs(F.col(value))))
    return flows.groupBy(*by).agg(F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)).alias("flow_stability"))


def group_stats_to_rows(df: DataFrame, key: str, value: str, prefix: str,
                        zscore: bool = True, bounded_keys: bool = False) -> DataFrame:
    """Per-key mean/std/min/max/count joined back to every row, plus
    z-score with (std + 1e-8).  The statistics come from a partial + final
    aggregation (a hot key is combined map-side); the join back is
    broadcast when the key domain is bounded (e.g. segments), else left to
    AQE, whose skew handling splits a hot key."""
    st = df.groupBy(key).agg(F.avg(value).alias(f"{prefix}_mean"), F.stddev_samp(value).alias(f"{prefix}_std"),
                             F.min(value).alias(f"{prefix}_min"), F.max(value).alias(f"{prefix}_max"),
                             F.count(value).alias(f"{prefix}_count"))
    out = df.join(F.broadcast(st) if bounded_keys else st, key, "left")
    if zscore:
        out = out.select("*", ((F.col(value) - F.col(f"{prefix}_mean")) / (F.col(f"{prefix}_std") + 1e-8))
                         .alias(f"{prefix}_zscore"))
    return out


def target_encoding_fit(df: DataFrame, cat: str, target: str, smoothing: float = 1.0) -> DataFrame:
    """A20 fit: (mean*count + global*smoothing)/(count + smoothing) per
    category, plus a NULL-category row holding the global mean."""
    g = df.agg(F.avg(target)).scalar()
    per = df.where(F.col(cat).isNotNull()).groupBy(cat).agg(F.avg(target).alias("__m"),
                                                             F.count(target).alias("__n"))
    name = f"{cat}_target_encoded"
    enc = per.select(cat, ((F.col("__m") * F.col("__n") + g * smoothing) / (F.col("__n") + smoothing))
                     .alias(name))
    glob = df.agg(F.avg(target).alias(name)).select(
        F.lit(None).cast(df.schema[cat].dataType).alias(cat), name)
    return enc.unionByName(glob)


def target_encoding_apply(df: DataFrame, encoding: DataFrame, cat: str) -> DataFrame:
    """A20 apply: unseen and NULL categories get the global mean."""
    name = f"{cat}_target_encoded"
    g = encoding.where(F.col(cat).isNull()).select(name).scalar()
    known = encoding.where(F.col(cat).isNotNull())
    return (df.join(known, cat, "left")
              .select(*df.columns, F.coalesce(F.col(name), g).alias(name)))
