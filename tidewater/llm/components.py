"""Connected components of a link table, as a sequence of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Cells over which the edges of one node are dealt.
SPREAD = 32


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m) for edges (a, b): m is the smallest of a and its neighbours.

    A node's edges are dealt over cells by their other end, so that no node's
    edges meet in one task, however many it has.
    """
    cells = edges.withColumn("at", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    parts = cells.groupBy("a", "at").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m")).select("a", F.least("a", "m").alias("m"))
    return cells.join(parts.select("a", "at").join(least, "a"), ["a", "at"]).select("a", "b", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest
    node that can be reached.

    Alternates two steps until nothing changes, each a minimum by node (combined
    before the shuffle) and a join.  The large step ties every larger neighbour
    of a node to the smallest one; the small step ties the smaller ones.  Each
    round's links are written to the shared folder, which cuts the lineage.
    The number of rounds grows with the logarithm of the longest chain.
    """
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = written(_with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = _with_least(large)
        small = down.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.unionByName(down.select("a", F.col("m").alias("b"))).where("a > b").distinct())
        now = _mark(links)
        if now == mark:
            break
        mark = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
