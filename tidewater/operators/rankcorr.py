"""Kendall's tau-b without comparing pairs of rows.

Rows sorted by (x, y) have as many discordant pairs as the sequence of their
ranks by (y, place) has inversions; ties never count as inversions in this
order.  Inversions are added up from parts that fit a task: the sequence is
cut into blocks by place and into bands by rank, of ``BLOCK`` rows or, of more
than ``BLOCK * PARTS`` rows, into ``PARTS`` of each.  Two rows are in

* other blocks and other bands: counted on the table of cell sizes,
* the same block, or the same band: counted inside a task by halving ranks bit
  by bit; what both count, the rows of one cell, is taken off once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.global_order import with_global_position
from ..session import reliable_checkpoint

BLOCK, PARTS = 1 << 19, 2048


def inversions(part: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Per part 0..k: pairs of its rows, in the given order, of which the first
    has the greater rank.  Ranks differ.

    Rows are dealt by their rank's bits from the top: among rows that agree
    above a bit, a pair is inverted there if a 1 comes before a 0.
    """
    out = np.zeros(int(part.max(initial=-1)) + 1, np.int64)
    order = np.lexsort((rank, part))
    dense = np.empty(len(rank), np.int64)
    dense[order] = np.arange(len(rank))
    first = np.searchsorted(part[order], np.arange(len(out)))
    dense -= first[part]  # ranks within the part
    at = np.argsort(part, kind="stable")
    part, dense = part[at], dense[at]
    bits = int(dense.max(initial=0)).bit_length()
    key = part.astype(np.int64) << bits | dense
    for level in range(bits - 1, -1, -1):
        one = (key >> level & 1).astype(np.int64)
        ones = np.cumsum(one) - one
        head = key >> (level + 1)
        start = np.r_[True, head[1:] != head[:-1]]
        before = ones - np.maximum.accumulate(np.where(start, ones, 0))
        np.add.at(out, key >> bits, np.where(one == 0, before, 0))
        key = key[np.argsort(key >> level, kind="stable")]
    return out


def _within(rows: DataFrame, by: str, other: str, cells: bool) -> DataFrame:
    """(g, d) sums of inversions inside each ``by`` (less those inside its cells)."""
    def count(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_numpy() for c in ("g", "pos", "q", other)}
        order = np.argsort(cols["pos"], kind="stable")
        g, q, o = (cols[c][order] for c in ("g", "q", other))
        groups, part = np.unique(g, return_inverse=True)
        total = inversions(part, q)
        if cells:
            pairs, cell = np.unique(np.stack([part, o], 1), axis=0, return_inverse=True)
            np.subtract.at(total, pairs[:, 0], inversions(cell.reshape(-1), q))
        return pa.table({"g": pa.array(groups, pa.int32()), "d": pa.array(total, pa.int64())})

    return rows.select("g", "pos", "q", by, other).groupBy(by).applyInArrow(count, "g int, d long")


def discordant(pairs: DataFrame) -> DataFrame:
    """(g, d): discordant pairs of rows of each group g (an int) of (g, x, y)."""
    placed = with_global_position(pairs.select("g", "x", "y"), ["g", "x", "y"], "pos")
    ranked = with_global_position(placed.select("g", "y", "pos"), ["g", "y", "pos"], "q").select("g", "pos", "q")
    n = ranked.count()
    size = max(BLOCK, -(-n // PARTS))
    rows = reliable_checkpoint(ranked.withColumn("block", F.expr(f"cast(pos div {size} as int)")).withColumn("band", F.expr(f"cast(q div {size} as int)")))
    cells = rows.groupBy("g", "block", "band").agg(F.count(F.lit(1)).alias("n"))
    # the whole table of cells of each group: PARTS * PARTS at most, in all
    grid = cells.groupBy("g").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("block", "band") for f in (F.min, F.max)])
    grid = grid.select("g", F.explode(F.sequence("min_block", "max_block")).alias("block"), "min_band", "max_band")
    grid = grid.select("g", "block", F.explode(F.sequence("min_band", "max_band")).alias("band")).join(cells, ["g", "block", "band"], "left").fillna(0, ["n"])
    above = Window.partitionBy("g", "block").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("g", "band").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("above", F.sum("n").over(above)).withColumn("both", F.sum("above").over(before))
    across = grid.select("g", (F.col("n") * F.coalesce("both", F.lit(0))).alias("d"))
    inside = _within(rows, "block", "band", True).unionByName(_within(rows, "band", "block", False))
    return across.unionByName(inside).groupBy("g").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d"))


def _tied(pairs: DataFrame, cols: list[str], name: str) -> DataFrame:
    n = F.col("n").cast("decimal(19,0)")
    return pairs.groupBy("g", *cols).agg(F.count(F.lit(1)).alias("n")).groupBy("g").agg(F.sum(n * (n - 1) / 2).cast("double").alias(name))


def kendall_tau_b(pairs: DataFrame, min_periods: int = 10) -> DataFrame:
    """(g, n, tau) for rows (g, x, y) without nulls: tau-b, NULL with fewer than
    ``min_periods`` rows or where x or y is constant."""
    n = F.col("n").cast("decimal(19,0)")
    out = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("all", (n * (n - 1) / 2).cast("double"))
    for cols, name in ((["x"], "tx"), (["y"], "ty"), (["x", "y"], "txy")):
        out = out.join(_tied(pairs, cols, name), "g")
    out = out.join(discordant(pairs), "g")
    varied: Column = F.sqrt((F.col("all") - F.col("tx")) * (F.col("all") - F.col("ty")))
    tau = (F.col("all") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d").cast("double")) / F.nullif(varied, F.lit(0.0))
    return out.select("g", "n", F.when(F.col("n") >= min_periods, tau).alias("tau"))
