"""Join operators.

Broadcast is used only for sides with a structural size bound (one row per
calendar day, per segment, per scenario); otherwise Spark/AQE chooses the
strategy at run time from measured sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SEGMENTS
from . import windows as W


# --------------------------------------------------------------------------- J1
def merge_datasets(datasets: Mapping[str, DataFrame], key: str, how: str = "inner") -> DataFrame:
    """Fold the frames left to right with an equi-join on ``key``; clashing
    non-key columns of the right side get the suffix ``_<name>``; frames
    without the key are skipped."""
    names = list(datasets)
    if not names:
        raise ValueError("no datasets")
    merged = datasets[names[0]]
    for name in names[1:]:
        df = datasets[name]
        if key not in df.columns or key not in merged.columns:
            continue
        clash = set(merged.columns) & set(df.columns) - {key}
        right = df.select(*[F.col(c).alias(f"{c}_{name}" if c in clash else c) for c in df.columns])
        merged = merged.join(right, key, how)
    return merged


# --------------------------------------------------------------------------- J2
def assemble_on_date(frames: Sequence[DataFrame], date_col: str = "date",
                     fill: str | None = "ffill") -> DataFrame:
    """Full outer assembly of several wide date-keyed frames as one union of
    long rows + pivot (one shuffle instead of a chain of outer joins).
    A series present in several frames takes the first non-null value in
    frame order (source priority); then forward (and optionally backward)
    fill over dates."""
    series: list[str] = []
    longs = []
    for prio, f in enumerate(frames):
        cols = [c for c in f.columns if c != date_col]
        for c in cols:
            if c not in series:
                series.append(c)
        stack = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value"))
                                    for c in cols]))
        longs.append(f.select(F.col(date_col), F.lit(prio).alias("prio"), stack.alias("s"))
                      .select(date_col, "prio", "s.series", "s.value"))
    long = reduce(lambda a, b: a.unionByName(b), longs)
    best = (long.where(F.col("value").isNotNull())
                .groupBy(date_col, "series").agg(F.min_by("value", "prio").alias("value")))
    dates = long.select(date_col).distinct()
    wide = best.groupBy(date_col).pivot("series", series).agg(F.first("value"))
    wide = dates.join(wide, date_col, "left")
    if fill == "ffill":
        wide = W.forward_fill(wide, series, [date_col])
    elif fill == "ffill_bfill":
        wide = W.forward_then_backward_fill(wide, series, [date_col])
    return wide.select(date_col, *series)


# --------------------------------------------------------------------------- J4
UNIFIED_METRICS = ("deposit_flow_mean", "deposit_flow_sum", "inflow_sum", "outflow_sum")


def unified_timeseries(market: DataFrame, flows: DataFrame, segments: Sequence[str] = SEGMENTS) -> DataFrame:
    """Flows per (date, segment) pivoted by segment (explicit value list,
    missing combinations 0), full outer join with market on date, then
    forward fill in date order (one row per day: calendar bounded)."""
    piv = (flows.groupBy("date").pivot("segment", list(segments))
                .agg(F.avg("deposit_flow").alias("deposit_flow_mean"),
                     F.sum("deposit_flow").alias("deposit_flow_sum"),
                     F.sum("inflow").alias("inflow_sum"),
                     F.sum("outflow").alias("outflow_sum")))
    cols = [F.coalesce(F.col(f"{s}_{m}"), F.lit(0.0)).alias(f"{m}_{s}") for m in UNIFIED_METRICS for s in segments]
    piv = piv.select("date", *cols)
    u = market.join(piv, "date", "full_outer")
    return W.forward_fill(u, [c for c in u.columns if c != "date"], ["date"])


# --------------------------------------------------------------------------- J5
def segment_features_with_market(segment_daily: DataFrame, market: DataFrame) -> DataFrame:
    """Left join of segment-day features to the daily market row (market
    is one row per calendar day, so broadcasting it is bounded)."""
    return segment_daily.join(F.broadcast(market), "date", "left")


# --------------------------------------------------------------------------- J6
# fixed values: defaults of the market conditions when a column is absent
MARKET_CONDITION_DEFAULTS = [
    ("fed_funds_rate", "FED_FUNDS_RATE", 2.0),
    ("treasury_10y", "TREASURY_10Y", 3.0),
    ("vix", "VIX", 20.0),
    ("yield_spread", "YIELD_SPREAD_10Y2Y", 1.0),
    ("rate_change", "FED_FUNDS_RATE_CHANGE", 0.0),
]


def asof_market_rows(dates: DataFrame, market: DataFrame, date_col: str = "date") -> DataFrame:
    """For each wanted date, the latest market row on or before it, else the
    earliest market row (H3).  Works on distinct dates only: the union of
    wanted and market dates is bounded by the calendar, and the market row
    travels as one struct so a null field is never filled from an older row."""
    mcols = [c for c in market.columns if c != date_col]
    m = market.select(date_col, F.struct(*mcols).alias("__m"))
    want = dates.select(date_col).distinct().select(date_col, F.lit(None).cast(m.schema["__m"].dataType)
                                                    .alias("__m"))
    u = m.unionByName(want).groupBy(date_col).agg(F.first("__m", ignorenulls=True).alias("__m"),
                                                   F.max(F.col("__m").isNull().cast("int")).alias("__w"))
    past = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = F.coalesce(F.last("__m", ignorenulls=True).over(past),
                         F.first("__m", ignorenulls=True).over(every))
    r = u.select(date_col, "__w", carried.alias("__m")).where(F.col("__w") == 1)
    return r.select(date_col, "__m.*")


def asof_join_market(facts: DataFrame, market: DataFrame, date_col: str = "date",
                     conditions: bool = True) -> DataFrame:
    """Backward as-of join of the market to fact rows on ``date_col``
    with fallback to the earliest market row; with ``conditions`` the
    output is the five market-condition columns (constants for absent
    market columns), else every market column."""
    rows = asof_market_rows(facts, market, date_col)
    if conditions:
        sel = [F.col(src).alias(name) if src in rows.columns else F.lit(dflt).alias(name)
               for name, src, dflt in MARKET_CONDITION_DEFAULTS]
        rows = rows.select(date_col, *sel)
    # one row per distinct fact date: calendar bounded, broadcast
    return facts.join(F.broadcast(rows), date_col, "left")


def asof_join_entity(left: DataFrame, right: DataFrame, entity: str, ts: str,
                     value_cols: Sequence[str], block: str = "day") -> DataFrame:
    """Per-entity backward as-of join (latest right row at or before each
    left row of the same entity; right rows sort first at equal times).

    A hot entity is not sent to one task: rows are windowed per
    (entity, time block); the value carried into a block comes from a
    per-(entity, block) summary (one row per block, bounded by the
    calendar) windowed over the entity's blocks."""
    blk = F.date_trunc(block, F.col(ts))
    r = right.select(entity, ts, blk.alias("__b"), F.lit(0).alias("__side"),
                     F.struct(*value_cols).alias("__v"))
    l_cols = [c for c in left.columns if c not in (entity, ts)]
    l_ = left.select(entity, ts, blk.alias("__b"), F.lit(1).alias("__side"), F.struct(*l_cols).alias("__l"))
    r = r.select("*", F.lit(None).cast(l_.schema["__l"].dataType).alias("__l"))
    l_ = l_.select(entity, ts, "__b", "__side", F.lit(None).cast(r.schema["__v"].dataType).alias("__v"), "__l")
    u = r.unionByName(l_)
    w = Window.partitionBy(entity, "__b").orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    local = u.select(entity, ts, "__b", "__side", "__l", F.last("__v", ignorenulls=True).over(w).alias("__v"))
    # one row per (entity, block): the block's last right row, carried over blocks
    blocks = (u.groupBy(entity, "__b")
               .agg(F.max_by("__v", F.when(F.col("__side") == 0, F.struct(ts))).alias("__last")))
    wb = Window.partitionBy(entity).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(entity, "__b", F.last("__last", ignorenulls=True).over(wb).alias("__in"))
    out = local.where(F.col("__side") == 1).join(carry, [entity, "__b"], "left")
    v = F.coalesce(F.col("__v"), F.col("__in"))
    return out.select(entity, ts, "__l.*", *[v[c].alias(c) for c in value_cols])


# ------------------------------------------------------------------------ J9/J10
def anti_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def relative_volatility(flows: DataFrame, customers: DataFrame, flow_col: str = "deposit_flow",
                        balance_col: str = "balance_avg") -> DataFrame:
    """std(flow)/balance per customer (inner: customers on both sides)."""
    s = flows.groupBy("customer_id").agg(F.stddev_samp(flow_col).alias("flow_std"))
    return s.join(customers.select("customer_id", balance_col), "customer_id", "inner") \
            .select("customer_id", "flow_std", balance_col,
                    F.try_divide(F.col("flow_std"), F.col(balance_col)).alias("relative_volatility"))
