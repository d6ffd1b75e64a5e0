"""Global-order helpers for fact-size tables (H1).

``Window.orderBy`` without a partition sends every row to one task.  These
helpers give the same answers with the work spread over range partitions:

1. ``repartitionByRange`` + ``sortWithinPartitions`` on the order keys,
2. tag rows with ``spark_partition_id`` and ``monotonically_increasing_id``
   and cut lineage with a reliable checkpoint, so a recomputation after an
   executor loss cannot change partition boundaries or ids,
3. per-partition counts/sums (one row per partition, a bounded table) are
   turned into offsets with a window over that small table and joined back
   by broadcast.

Order keys must be unique (ties would get an arbitrary but stable order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

PID, MID = "__go_pid", "__go_mid"


def _tagged(df: DataFrame, order_cols: Sequence, num_partitions: int | None) -> DataFrame:
    # without an explicit count AQE may coalesce neighbouring ranges, which
    # keeps partition ids in key order while sizing partitions from the data
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    ranged = ranged.sortWithinPartitions(*order_cols)
    tagged = ranged.select("*", F.spark_partition_id().alias(PID),
                           F.monotonically_increasing_id().alias(MID))
    return reliable_checkpoint(tagged)


def with_global_position(df: DataFrame, order_cols: Sequence, pos_col: str = "pos",
                         num_partitions: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row in the total order."""
    t = _tagged(df, order_cols, num_partitions)
    per = t.groupBy(PID).agg(F.count(F.lit(1)).alias("__n"), F.min(MID).alias("__m0"))
    # one row per partition: an unpartitioned window here is bounded
    offs = per.select(PID, "__m0",
                      F.coalesce(F.sum("__n").over(Window.orderBy(PID).rowsBetween(
                          Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return (t.join(F.broadcast(offs), PID)
             .select(*df.columns, (F.col("__off") + F.col(MID) - F.col("__m0")).alias(pos_col)))


def global_lag(df_with_pos: DataFrame, cols: Sequence[str], pos_col: str = "pos",
               same: Sequence[str] = (), suffix: str = "_prev") -> DataFrame:
    """Value of ``cols`` on the previous position (equi-join on pos - 1,
    balanced because positions are unique).  ``same`` columns must agree
    between the two rows (e.g. model name), else the lag is NULL."""
    prev = df_with_pos.select((F.col(pos_col) + 1).alias(pos_col),
                              *[F.col(c).alias(f"{c}{suffix}") for c in list(cols) + list(same)])
    j = df_with_pos.join(prev, pos_col, "left")
    ok = F.lit(True)
    for c in same:
        ok = ok & (F.col(c) == F.col(f"{c}{suffix}"))
    out = [F.col(c) for c in df_with_pos.columns]
    out += [F.when(ok, F.col(f"{c}{suffix}")).alias(f"{c}{suffix}") for c in cols]
    return j.select(*out)


def value_count_ladder(df: DataFrame, col: str, by: Sequence[str] = (),
                       num_partitions: int | None = None) -> DataFrame:
    """Distinct non-null values of ``col`` (per ``by`` group) with their
    count ``c``, the number of values strictly below them in the same group
    ``below`` (a cumulative count over the sorted distinct values) and the
    group's number of values ``__n``.

    One plan at every size: a hot value collapses to one row in the map-side
    partial aggregation, and the values are range-partitioned by (group,
    value), so a hot group is spread over as many partitions as its values
    need.  A partition's counts by group become offsets, which are joined on
    (partition, group): no join brings a whole group together.
    """
    keys = list(by)
    vc = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("c"))
    t = _tagged(vc, [*keys, col], num_partitions)
    w_local = Window.partitionBy(PID, *keys).orderBy(MID).rowsBetween(Window.unboundedPreceding, -1)
    local = t.select(*keys, col, "c", PID, F.coalesce(F.sum("c").over(w_local), F.lit(0)).alias("__lb"))
    # a row per partition and group that it holds, of which all but two are
    # wholly inside it
    per = t.groupBy(PID, *keys).agg(F.sum("c").alias("__pc"))
    before = Window.partitionBy(*keys).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offs = per.select(F.col(PID).alias("__opid"), *[F.col(k).alias(f"__o_{k}") for k in keys],
                      F.coalesce(F.sum("__pc").over(before), F.lit(0)).alias("__off"),
                      F.sum("__pc").over(whole).alias("__n"))
    same = local[PID] == offs["__opid"]
    for k in keys:
        same = same & local[k].eqNullSafe(offs[f"__o_{k}"])
    return local.join(offs, same).select(*keys, col, "c", (F.col("__off") + F.col("__lb")).alias("below"), "__n")


#: Tasks over which ``join_groups`` deals the rows of one group.
SPREAD = 32


def join_groups(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of ``df`` with ``stats`` (one row per group of ``keys``) that works
    when a few groups hold all rows: the statistics are repeated for ``SPREAD``
    salts and a row's salt is the hash of the row, so a group's rows go to as
    many tasks, whatever its size."""
    here = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SPREAD)).cast("int"))
    there = stats.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return here.join(there, [*keys, "__salt"], how).drop("__salt")


def rank_pct(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """W9 at scale: pandas ``rank(pct=True)`` (average ranks over non-null
    values).  The ladder join is on the value; AQE splits a hot value."""
    lad = value_count_ladder(df, col)
    avg_rank = F.col("below") + (F.col("c") + 1) / 2.0
    lad = lad.select(col, (avg_rank / F.col("__n")).alias(out or f"{col}_rank_pct"))
    return df.join(lad, col, "left")


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], names: Sequence[str] | None = None,
                    by: Sequence[str] = (), ladder: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy / pandas default), one
    row (per ``by`` group), computed from the value ladder so that no task
    ever holds all distinct values (the built-in exact ``percentile``
    merges every distinct value of a group into one buffer).  Position
    q*(n-1) falls on the value whose rank range [below, below + c) holds it."""
    keys = list(by)
    names = list(names) if names else [f"q{q}" for q in qs]
    lad = ladder if ladder is not None else value_count_ladder(df, col, keys)
    n = F.col("__n")
    v, c, below = F.col(col), F.col("c"), F.col("below")
    aggs = []
    for i, q in enumerate(qs):
        pos = (n - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        v_lo = F.max(F.when((below <= lo) & (lo < below + c), v))
        v_hi = F.max(F.when((below <= hi) & (hi < below + c), v))
        frac = F.max(pos - lo)
        aggs.append((v_lo + (v_hi - v_lo) * frac).alias(names[i]))
    return lad.groupBy(*keys).agg(*aggs)


def long_quantiles(ladder: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The quantiles of ``exact_quantiles`` as rows (by, i, q, value), for many
    ``qs``: a ladder row gives a row per quantile whose position lies on it or
    next to it, so that two rows of a group and quantile at most are shuffled."""
    keys = list(by)
    n, v, c, below = F.col("__n"), F.col(col), F.col("c"), F.col("below")
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)])

    def low(q):
        return F.floor((n - 1) * q)

    def high(q):
        return F.ceil((n - 1) * q)

    near = F.filter(wanted, lambda w: (low(w["q"]) < below + c) & (high(w["q"]) >= below))
    d = ladder.select(*keys, v.alias("__v"), "c", "below", "__n", F.explode(near).alias("__w")) \
              .select(*keys, "__v", "c", "below", "__n", "__w.i", "__w.q")
    q = F.col("q")
    at_low, at_high = (below <= low(q)) & (low(q) < below + c), (below <= high(q)) & (high(q) < below + c)
    g = d.groupBy(*keys, "i", "q").agg(F.max(F.when(at_low, F.col("__v"))).alias("__lo"),
                                       F.max(F.when(at_high, F.col("__v"))).alias("__hi"),
                                       F.max((n - 1) * q - low(q)).alias("__f"))
    return g.select(*keys, "i", "q", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias("value"))
