"""Economic indicators from series of mixed frequency.

Series are long rows (date, series, value): daily, monthly and quarterly ones
side by side.  Everything that looks back (growth, momentum, cycle) counts a
series' own observations, so a quarter's growth is against the quarter before
and never against the days in between; only then are the dates aligned and
filled.  Windows are over one series, which the calendar bounds; how many
series there are does not matter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import safe_div
from . import windows as W

# fixed values: names and periods of the derived series
GROWTH = {"GDP_REAL": {"GDP_GROWTH_QOQ": 1, "GDP_GROWTH_YOY": 4},
          "CPI_ALL": {"CPI_ALL_YOY": 12, "INFLATION_MOMENTUM": 3}, "CPI_CORE": {"CPI_CORE_YOY": 12},
          "PCE_ALL": {"PCE_ALL_YOY": 12}, "PCE_CORE": {"PCE_CORE_YOY": 12}}
ACCELERATION = {"CPI_ALL": ("INFLATION_ACCELERATION", 3)}
RATIOS = {"BEVERIDGE_CURVE": ("JOB_OPENINGS", "UNEMPLOYMENT_RATE")}
SPREADS = {"CREDIT_RISK_SPREAD": ("CREDIT_SPREAD_BAA", "CREDIT_SPREAD_AAA")}
STRESS = ("ECONOMIC_STRESS_INDEX", ("VIX", "CREDIT_SPREAD_BAA", "UNEMPLOYMENT_RATE"))
CYCLE = {"LEADING_INDEX": "BUSINESS_CYCLE_PHASE"}
CYCLE_ROWS, CYCLE_LIMIT = 6, 0.1


def long_series(groups: Mapping[str, DataFrame] | Sequence[DataFrame], date_col: str = "date") -> DataFrame:
    """Wide frames by date as long rows, one per date and series without the
    missing values; a series in several frames takes the first one's value."""
    frames = list(groups.values()) if isinstance(groups, Mapping) else list(groups)
    longs = []
    for k, f in enumerate(frames):
        cols = [c for c in f.columns if c != date_col]
        stack = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in cols]))
        longs.append(f.select(F.col(date_col).alias("date"), F.lit(k).alias("k"), stack.alias("s")).select("date", "k", "s.*"))
    rows = reduce(DataFrame.unionByName, longs).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy("date", "series").agg(F.min_by("value", "k").alias("value"))


def own_row_indicators(series: DataFrame) -> DataFrame:
    """Derived series that look back over a series' own observations: growth in
    percent, its change, and the cycle phase by the slope over ``CYCLE_ROWS``
    (1 above the limit, -1 below its negative, else 0, as before there are enough)."""
    names = sorted({*GROWTH, *ACCELERATION, *CYCLE})
    w = Window.partitionBy("series").orderBy("date")
    back = lambda n: F.lag("value", n).over(w)
    periods = sorted({n for g in GROWTH.values() for n in g.values()} | {n for _, n in ACCELERATION.values()})
    middle = (CYCLE_ROWS - 1) / 2
    spread = sum((k - middle) ** 2 for k in range(CYCLE_ROWS))
    values = [F.col("value"), *(back(n) for n in range(1, CYCLE_ROWS))]
    slope = reduce(Column.__add__, (v * ((CYCLE_ROWS - 1 - n - middle) / spread) for n, v in enumerate(values)))
    rows = (series.where(F.col("series").isin(*names))
            .select("date", "series", "value", *[(safe_div(F.col("value"), back(n)) - 1).alias(f"g{n}") for n in periods], slope.alias("slope")))
    rows = rows.select("*", *[(F.col(f"g{n}") - F.lag(f"g{n}").over(w)).alias(f"d{n}") for n in {n for _, n in ACCELERATION.values()}])
    phase = F.when(F.col("slope") > CYCLE_LIMIT, 1.0).when(F.col("slope") < -CYCLE_LIMIT, -1.0).otherwise(0.0)
    made = [(s, name, 100 * F.col(f"g{n}")) for s, g in GROWTH.items() for name, n in g.items()]
    made += [(s, name, 100 * F.col(f"d{n}")) for s, (name, n) in ACCELERATION.items()] + [(s, name, phase) for s, name in CYCLE.items()]
    arr = F.array(*[F.when(F.col("series") == s, F.struct(F.lit(name).alias("series"), v.alias("value"))) for s, name, v in made])
    return (rows.select("date", F.explode(F.array_compact(arr)).alias("s")).select("date", "s.series", "s.value").where(F.col("value").isNotNull()))


def same_day_indicators(series: DataFrame) -> DataFrame:
    """Derived series of several others, on the dates on which all are observed:
    ratios, spreads, and the stress index, the mean of the z-scores (sample
    deviation, over each series' own observations) of those of its parts that
    there are at all."""
    index, parts = STRESS
    names = sorted({*parts, *(c for p in (*RATIOS.values(), *SPREADS.values()) for c in p)})
    whole = Window.partitionBy("series")
    rows = series.where(F.col("series").isin(*names)).withColumn(
        "z", safe_div(F.col("value") - F.avg("value").over(whole), F.stddev_samp("value").over(whole)))
    of = {c: F.max(F.when(F.col("series") == c, F.col("value"))) for c in names}
    scored = F.when(F.col("series").isin(*parts), F.col("z"))
    there = series.where(F.col("series").isin(*parts)).agg(F.count_distinct("series").alias("n"))
    by_day = rows.groupBy("date").agg(
        *[safe_div(of[a], of[b]).alias(name) for name, (a, b) in RATIOS.items()], *[(of[a] - of[b]).alias(name) for name, (a, b) in SPREADS.items()],
        F.avg(scored).alias(index), F.count(scored).alias("n"))
    by_day = by_day.withColumn(index, F.when(F.col("n") == there.scalar(), F.col(index)))
    stack = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in (*RATIOS, *SPREADS, index)])
    return by_day.select("date", F.explode(stack).alias("s")).select("date", "s.*").where(F.col("value").isNotNull())


def economic_indicators(series: DataFrame) -> DataFrame:
    """M6: all derived series as long rows (date, series, value)."""
    return own_row_indicators(series).unionByName(same_day_indicators(series))


def derived_names(series: Sequence[str]) -> list[str]:
    """The derived series that these series give, in a fixed order."""
    have = set(series)
    out = [name for s, g in GROWTH.items() if s in have for name in g]
    out += [name for s, (name, _) in ACCELERATION.items() if s in have] + [name for s, name in CYCLE.items() if s in have]
    out += [name for name, p in (*RATIOS.items(), *SPREADS.items()) if have.issuperset(p)]
    return out + ([STRESS[0]] if have & set(STRESS[1]) else [])


def economic_composite(groups: Mapping[str, DataFrame], date_col: str = "date", backfill: bool = True) -> DataFrame:
    """The groups' series and the derived ones on the union of all dates, the
    last known value carried forward; ``backfill`` gives dates before a
    series begins its first value.  The outer assembly is one aggregation by
    date, not a chain of joins."""
    names = list(dict.fromkeys(c for f in groups.values() for c in f.columns if c != date_col))
    series = long_series(groups, date_col)
    names += [c for c in derived_names(names) if c not in names]
    dates = reduce(DataFrame.unionByName, [f.select(F.col(date_col).alias("date")) for f in groups.values()]).select(
        "date", F.lit(None).cast("string").alias("series"), F.lit(None).cast("double").alias("value"))
    rows = series.unionByName(economic_indicators(series)).unionByName(dates)
    wide = rows.groupBy("date").agg(*[F.max(F.when(F.col("series") == c, F.col("value"))).alias(c) for c in names])
    fill = W.forward_then_backward_fill if backfill else W.forward_fill
    return fill(wide, names, ["date"]).select(F.col("date").alias(date_col), *names)
