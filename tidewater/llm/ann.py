"""Nearest neighbours by inner product with multi-index hashing.

Codes: vectors are put on a sphere (one more coordinate makes all lengths
equal, so that the largest inner product is the smallest angle), rotated so
that the signs of the coordinates lose least (principal axes, then iterative
quantisation, fitted on a bounded sample), and the signs are the code of
``BITS`` bits.

Search: a code is split into ``PARTS`` substrings.  If two codes differ in at
most ``radius`` bits, some substring differs in at most radius / PARTS, so
probing every substring's index for all values that close finds every code
within the radius.  Those are ranked by the inner products of the original
vectors in double precision.  Rows that are all indexed are dealt over chunks
of bounded size, each with its own indexes; queries visit the chunks in blocks.

A query for which fewer rows are found than asked for is searched again among
all rows.

Defined cases: a vector that is null, zero, holds null or non-finite
components, or has not the most frequent length takes no part, nor does a row
without id; equal vectors are indexed once with their smallest ids (k + 1,
which is all that k neighbours can need); rows that repeat an id are that id's
vectors; an empty table gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BITS, PARTS = 64, 8
RADIUS = 30
#: Vectors that the rotation is fitted on.
SAMPLE = 10_000
CHUNK, QUERIES = 8_192, 4_096

_COUNT = np.array([bin(k).count("1") for k in range(256)], np.uint8)
_VALUES = np.arange(256)


@dataclass
class Codes:
    """Signs of (x - mean) @ axes are the code; ``longest`` is the norm that
    all vectors are brought to."""

    mean: np.ndarray
    axes: np.ndarray
    longest: float

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes as rows of ``PARTS`` bytes."""
        return np.packbits((lifted(x, self.longest, query) - self.mean) @ self.axes > 0, axis=1)


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors on the sphere of radius ``longest`` in one more dimension.
    Queries are scaled to it, which doesn't change their order of rows."""
    n2 = (x * x).sum(1)
    if query:
        return np.hstack([x * (longest / np.sqrt(n2))[:, None], np.zeros((len(x), 1))])
    return np.hstack([x, np.sqrt(np.maximum(longest ** 2 - n2, 0))[:, None]])


def fit_codes(x: np.ndarray, longest: float, rounds: int = 30, seed: int = 5) -> Codes:
    """Principal axes and iterative quantisation; if there are fewer axes than
    bits, more rotations of them give the other bits."""
    rng = np.random.default_rng(seed)
    y = lifted(x, longest, False)
    mean = y.mean(0)
    w, axes = np.linalg.eigh((y - mean).T @ (y - mean))
    axes = axes[:, ::-1][:, :BITS]
    z, out = (y - mean) @ axes, []
    while sum(a.shape[1] for a in out) < BITS:
        r = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ v).T
        out.append(axes @ r)
    return Codes(mean, np.hstack(out)[:, :BITS], longest)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, v an array of doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    return (flat.flatten() if n else pa.array([], pa.float64())).to_numpy(zero_copy_only=False).reshape(n, -1)


_FOUND = pa.schema([("asked", pa.int64()), ("cid", pa.int64()), ("score", pa.float64()), ("least", pa.int64())])


def search_chunk(q: np.ndarray, qcode: np.ndarray, x: np.ndarray, xcode: np.ndarray, least: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows within the radius, per query.

    For each substring the rows are sorted by its value, which is the index.
    Each value's bucket meets the queries that probe it: a table lookup says
    which.  Only pairs that may beat a query's k-th best so far are kept.
    """
    near = radius // PARTS
    close = _COUNT[_VALUES[:, None] ^ _VALUES] <= near
    words_q, words_x = qcode.view(np.uint64).ravel(), xcode.view(np.uint64).ravel()
    bar = np.full(len(q), -np.inf)
    slack = 1e-9 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
    kept = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    found: list[list[np.ndarray]] = [[], [], []]
    pending = 0

    def settle() -> None:
        nonlocal kept, found, pending
        a, b, s = (np.concatenate([kept[i], *found[i]]) for i in range(3))
        order = np.lexsort((b, least[b], -s, a))
        a, b, s = a[order], b[order], s[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # a pair found by two substrings
        a, b, s = a[new], b[new], s[new]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        last = rank == k - 1
        bar[a[last]] = s[last]
        kept, found, pending = [a[rank < k], b[rank < k], s[rank < k]], [[], [], []], 0

    for part in range(PARTS):
        order = np.argsort(xcode[:, part], kind="stable")
        at = np.searchsorted(xcode[order, part], np.arange(257))
        for value in np.flatnonzero(np.diff(at)):
            rows = order[at[value]:at[value + 1]]
            ask = np.flatnonzero(close[value][qcode[:, part]])
            if not len(ask):
                continue
            far = np.bitwise_count(words_q[ask, None] ^ words_x[rows])
            score = q[ask] @ x[rows].T
            a, b = np.nonzero((far <= radius) & (score >= (bar[ask] - slack[ask])[:, None]))
            if len(a):
                a, b = ask[a], rows[b]
                found[0].append(a)
                found[1].append(b)
                found[2].append(np.einsum("ij,ij->i", q[a], x[b]))
                pending += len(a)
                if pending > 4 * k * len(q) + 10_000:
                    settle()
    settle()
    return tuple(kept)


def nearest(rows: DataFrame, asks: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            radius: int = RADIUS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``asks`` (a
    condition on column ``id``) holds, its k nearest other rows."""
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(rows, key, vector))
    spark = rows.sparkSession
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("n2")).first()
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    longest = float(np.sqrt(facts["n2"])) or 1.0

    by_id = Window.partitionBy("v").orderBy("id")
    some = rows.withColumn("r", F.dense_rank().over(by_id)).where(F.col("r") <= k + 1)
    classes = some.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    picked = classes.where(F.pmod(F.xxhash64("v"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / n)) + 1).select("v").limit(2 * sample).toPandas()
    if len(picked) < 2:
        picked = classes.select("v").limit(2).toPandas()
    codes = fit_codes(np.stack(picked["v"].to_numpy()), longest)

    asking = rows.where(asks).distinct()
    queries = written(asking.select("v").distinct().join(classes, "v").select(F.col("cid").alias("asked"), "v"))
    m = queries.count()
    chunks, turns = -(-n // CHUNK), max(1, -(-m // QUERIES))

    def search(q: DataFrame, radius: int) -> DataFrame:
        left = classes.select("cid", "v", F.col("ids")[0].alias("least"), F.pmod(F.xxhash64("cid"), F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
        right = q.select("asked", F.col("v").alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.pmod(F.xxhash64("asked"), F.lit(turns)).cast("int").alias("turn"))

        def block(x: pa.Table, y: pa.Table) -> pa.Table:
            if not x.num_rows or not y.num_rows:
                return _FOUND.empty_table()
            vx, vq = _matrix(x["v"], x.num_rows), _matrix(y["w"], y.num_rows)
            least = x["least"].to_numpy()
            a, b, s = search_chunk(vq, codes.of(vq, True), vx, codes.of(vx, False), least, radius, k + 1)
            return pa.Table.from_arrays([pa.array(y["asked"].to_numpy()[a]), pa.array(x["cid"].to_numpy()[b]), pa.array(s), pa.array(least[b])], schema=_FOUND)

        got = left.groupBy("chunk", "turn").cogroup(right.groupBy("chunk", "turn")).applyInArrow(block, "asked long, cid long, score double, least long")
        best = Window.partitionBy("asked").orderBy(F.desc("score"), "least", "cid")
        got = got.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
        return got.groupBy("asked").agg(F.collect_list(F.struct("score", "cid")).alias("got"))

    first = written(search(queries, radius))
    want = min(k + 1, n)
    poor = queries.join(first.where(F.size("got") >= want), "asked", "left_anti")
    poor = written(poor)
    found = first
    if poor.count():
        found = first.join(poor, "asked", "left_anti").unionByName(search(poor, BITS))
    pairs = found.select("asked", F.explode("got").alias("g")).select("asked", F.col("g.cid").alias("cid"), F.col("g.score").alias("score"))
    lists = pairs.join(classes.select("cid", "ids"), "cid").groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("got"))
    one = asking.join(classes.select("v", F.col("cid").alias("asked")), "v").select("id", "asked").join(lists, "asked")
    # per query: all ids of its classes but its own, by score and id, k of them
    each = F.expr("flatten(transform(got, g -> transform(filter(g.ids, i -> i <> id), i -> struct(-g.score as s, i as i))))")
    top = one.select("id", F.slice(F.array_sort(F.array_distinct(each)), 1, k).alias("top"))
    out = top.select(F.col("id").alias("query_id"), F.posexplode("top").alias("rank", "t"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("t.i").alias("vec_id"), (-F.col("t.s")).alias("score"))
