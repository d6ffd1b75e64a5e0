"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

1. A text's fingerprint has a bit where more than half of its 3-word shingles
   (repeats included) have that bit in their XXH64.
2. Equal fingerprints form a class; its smallest doc_id stands for it.
3. The classes' fingerprints are the paths of a binary trie, which is joined
   with itself: pairs of nodes are traversed together from the top, a pair's
   differing bits are added up, and a pair that has more than ``MOST`` of them
   is left.  Two fingerprints that differ in ``MOST`` = 3 bits at most agree in
   one of four quarters; so there are four tries, each with another quarter in
   front, and each is joined with an error budget of none in its first 16
   levels and ``MOST`` below.  The nodes of level 16 are therefore independent
   and are dealt over the tasks.
4. A node (later a pair of nodes) with more than ``LARGE`` rows is first split
   eight levels further by Spark, into the pairs of its descendants that are
   still within budget, again and again while a pair is that large.
5. Each task returns, for the fingerprints it holds, a star for each group that
   its links tie, so rows and not pairs; connected components unite them.

Defined cases: a null or blank text has fingerprint zero, which links like any
other; fewer than three words are one shingle; texts are read in blocks and
whole; rows that repeat a doc_id keep their own fingerprints and are one
document (its texts' groups are tied); a null doc_id is linked with nothing
and has a null component; an empty table gives no rows; further columns of any
name are ignored.  There are no ties to break: a bit set in exactly half of
the shingles is 0, and components are named by their smallest id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, written
from .components import components

SEED = 42
WIDTH = 3
#: Differing bits up to which fingerprints link.
MOST = 3
#: Rows of a node pair beyond which Spark splits it before a task takes it.
LARGE = 100_000
#: Bytes of a text hashed at a time; node pairs and rows handled at a time.
BLOCK, PAIRS, ROWS = 1 << 20, 1 << 14, 1 << 16
#: Node pairs with so few row pairs are compared row by row.
LEAF = 64

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def fingerprint(data: bytes) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes."""
    ones, total, tail, at = np.zeros(64, np.int64), 0, [], 0

    def add(shingles, n: int) -> None:
        nonlocal ones, total
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), _U, n)
        ones += np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += n

    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            blank = _BLANK.search(data, end)
            end = blank.start() if blank else len(data)
        words = tail + data[at:end].lower().split()
        if len(words) >= WIDTH:
            add(map(b" ".join, zip(*(words[k:] for k in range(WIDTH)))), len(words) - WIDTH + 1)
        tail, at = words[-(WIDTH - 1):], end
    if not total and tail:
        add([b" ".join(tail)], 1)
    return int(np.packbits(2 * ones > total, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py() or b"") for t in b.column(1)), _U, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string").cast("binary")).mapInArrow(rows, "doc_id long, fp long")


def _bits(x: Column, depth: int, n: int) -> Column:
    """The ``n`` bits of x below its first ``depth``."""
    return F.shiftrightunsigned(x, 64 - depth - n).bitwiseAND((1 << n) - 1)


_UNIT = ["trie", "depth", "p", "q"]


def _split(units: DataFrame, large: DataFrame, step: int = 8) -> DataFrame:
    """The rows of the node pairs in ``large``, dealt over the pairs of their
    descendants ``step`` levels below that are within budget."""
    rows = written(looked_up(units, large, _UNIT, F.col("key"), "inner").withColumn(
        "c", F.expr(f"shiftrightunsigned(key, 64 - depth - {step}) & {(1 << step) - 1}").cast("int")))
    ends = rows.groupBy(*_UNIT, "diff", "side", "c").agg(F.count(F.lit(1)).alias("n")).drop("n")
    one = ends.where("side = 0").select(*_UNIT, "diff", F.col("c").alias("c1"))
    # a node paired with itself has rows of side 0 only
    two = ends.where("side = 1 or p = q").select(*_UNIT, F.col("c").alias("c2"))
    pairs = one.join(two, _UNIT).where("p <> q or c1 <= c2").withColumn("more", F.bit_count(F.col("c1").bitwiseXOR(F.col("c2"))) + F.col("diff")).where(F.col("more") <= MOST)
    child = lambda end, c: F.shiftleft(F.col(end), step).bitwiseOR(F.col(c)).alias(end)
    down = [child("p", "c1"), child("q", "c2"), F.col("more").cast("int").alias("diff")]

    def sent(where: str, side: int, c: str, to: int) -> DataFrame:
        return pairs.where(where).select(*[F.col(k).alias(f"_{k}") for k in _UNIT], F.lit(side).alias("_side"), F.col(c).alias("_c"), F.struct(*down, F.lit(to).alias("side")).alias("to"))

    targets = sent("true", 0, "c1", 0).unionByName(sent("p <> q", 1, "c2", 1)).unionByName(sent("p = q and c1 < c2", 0, "c2", 1))
    targets = targets.groupBy(*[f"_{k}" for k in _UNIT], "_side", "_c").agg(F.collect_list("to").alias("to"))  # 163 at most
    targets = targets.select(*[F.col(f"_{k}").alias(k) for k in _UNIT], F.col("_side").alias("side"), F.col("_c").alias("c"), "to")
    dealt = looked_up(rows, targets, [*_UNIT, "side", "c"], F.col("key"), "inner").withColumn("to", F.explode("to"))
    return dealt.select("trie", (F.col("depth") + step).alias("depth"), "to.p", "to.q", "to.diff", "to.side", "key", "doc")


def join_nodes(keys: np.ndarray, pairs: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` that differ in at most ``MOST`` bits, from pairs of
    nodes: (depth, first and end of one's rows, first and end of the other's,
    differing bits, whether they are the same node), arrays but for depth.

    A node is a stretch of rows, sorted by key, that share their first ``depth``
    bits.  All pairs of a stack entry go down a level together; an entry is
    taken ``PAIRS`` pairs at a time, last in first out, so memory is bounded.
    """
    stack, before = list(pairs), {}
    while stack:
        depth, *cols = stack.pop()
        if len(cols[0]) > PAIRS:
            stack.append((depth, *(c[PAIRS:] for c in cols)))
            cols = [c[:PAIRS] for c in cols]
        al, ah, bl, bh, diff, same = cols
        size = (ah - al) * (bh - bl)
        leaf = size <= LEAF if depth < 64 else np.ones(len(size), bool)
        if leaf.any():
            n = size[leaf]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat((bh - bl)[leaf], n)
            i = np.repeat(al[leaf], n) + nth // wide
            j = np.repeat(bl[leaf], n) + nth % wide
            near = (np.bitwise_count(keys[i] ^ keys[j]) <= MOST) & (~np.repeat(same[leaf], n) | (i < j))
            yield i[near], j[near]
        al, ah, bl, bh, diff, same = (c[~leaf] for c in cols)
        if not len(al):
            continue
        if depth not in before:
            bit = (keys >> _U(63 - depth) & _U(1)).astype(np.int64)
            before[depth] = np.concatenate(([0], np.cumsum(bit)))
        ones = before[depth]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        no = np.zeros(len(al), bool)
        down = [np.concatenate(c) for c in zip((al, am, bl, bm, diff, same), (am, ah, bm, bh, diff, same), (al, am, bm, bh, diff + 1, no), tuple(c[~same] for c in (am, ah, bl, bm, diff + 1, no)))]
        live = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= MOST) & ~(down[5] & (down[1] - down[0] < 2))
        stack.append((depth + 1, *(c[live] for c in down)))


def tied(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after tying i to j: each row has the smallest of its group."""
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) for rows sorted by node pair, side and key: each row tied to another
    with the smallest row of its group, node pairs taken together."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        unit, side, keys = rows[:, :4], rows[:, 5], rows[:, 6].copy().view(_U)
        first = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]).any(1)]) if len(rows) else np.zeros(0, int)
        end = np.r_[first[1:], len(rows)]
        middle = first + np.add.reduceat(side == 0, first) if len(rows) else first
        same = unit[first, 2] == unit[first, 3]
        cols = (first, middle, np.where(same, first, middle), end, rows[first, 4], same)
        pairs = [(int(d), *(c[rows[first, 1] == d] for c in cols)) for d in np.unique(rows[first, 1])]
        label = np.arange(len(rows))
        for i, j in join_nodes(keys, pairs):
            label = tied(label, i, j)
        off = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(rows[off, 7]), pa.array(rows[label[off], 7])], ["a", "b"])

    for b in batches:
        held.append(np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1))
        if sum(map(len, held)) >= ROWS:
            rows = np.concatenate(held)
            new = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last node pair may go on
            if cut:
                yield links(rows[:cut])
            held = [rows[cut:]]
    if held:
        yield links(np.concatenate(held))


def trie_links(classes: DataFrame) -> DataFrame:
    """(a, b): ties between the docs of ``classes`` (fp, doc), one row per
    fingerprint, that have the connected components of all links."""
    turned = F.explode(F.array(*[F.struct(F.lit(k).alias("trie"), (F.shiftleft("fp", 16 * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * k)) if k else F.col("fp")).alias("key")) for k in range(4)]))
    rows = classes.select(turned.alias("t"), "doc").select("t.trie", "t.key", "doc")
    top = _bits(F.col("key"), 0, 16)
    units = rows.select("trie", F.lit(16).alias("depth"), top.alias("p"), top.alias("q"), F.lit(0).alias("diff"), F.lit(0).alias("side"), "key", "doc")
    ready = None
    for _ in range(6):
        large = written(units.groupBy(*_UNIT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).drop("n"))
        if large.isEmpty():
            break
        rest = units.join(large, _UNIT, "left_anti")
        ready = rest if ready is None else ready.unionByName(rest)
        units = written(_split(units, large))
    units = units if ready is None else ready.unionByName(units)
    order = [*_UNIT, "side", "key"]
    dealt = units.select(*_UNIT, "diff", "side", "key", "doc").repartition(*_UNIT).sortWithinPartitions(*order)
    return dealt.mapInArrow(_stars, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint, component_id, class_id (the
    smallest doc_id with the same fingerprint)."""
    made = written(fingerprints(docs, doc_id, text))
    named = made.where(F.col("doc_id").isNotNull())
    classes = written(named.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    # a doc_id with several fingerprints ties their classes
    several = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    ties = named.join(several, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    comp = components(trie_links(classes).unionByName(ties))
    final = classes.join(comp, classes["doc"] == comp["node"], "left").select("fp", F.col("doc").alias("class_id"), F.coalesce("comp", "doc").alias("component_id"))
    found = looked_up(made, final, ["fp"], F.col("doc_id"))
    of = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), of("component_id"), of("class_id"))
