"""The prefix trie of conversations by truncation peeling.

A node is a sequence of turns (role, text) with which conversations begin; its
key is the depth and 128 bits of hashes of its turns and their places, joined
by exclusive or, so that a key without its last turn is again a key.

1. Conversations are ordered and rebuilt (see ``rebuilt``) as one row per turn
   with the key of the prefix that ends there.  Long conversations are worked on
   in blocks of ``BLOCK`` turns, whose sums are carried on, so that none has to
   fit a task.
2. Conversations with the same whole sequence are one, with a count and its
   smallest id.
3. The turns of a sequence below the last prefix that it shares with another
   are a tail without branches: it is stripped at once, its sums are running
   sums.
4. Peeling: from the largest shared depth down, the sequences that end at a
   depth and the tails that begin below it are merged with the nodes that
   survive from the depth before; grouped by key they are the nodes of that
   depth, with members, children, leaves and saved tokens added up; each gives
   up its last turn and is grouped with its siblings in the next round.  One
   round a shared depth; groups are combined before they are shuffled, so that
   the root, or any prefix that a third of the conversations share, is no task's
   burden.

Defined cases: rows without a conv_id belong to no conversation; turns are in
the order of turn (null first), repeated ones further by role, then by a hash of
role and text, and each counts; a null role or text is an empty one, of any
length otherwise; an empty table has no nodes, not even a root; further
columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import looked_up, written

#: Turns of a conversation that one window holds (as a power of two).
BLOCK = 12
#: Ids in a piece of a list of members.
PIECE = 1 << 16
#: Conversations of so many consecutive ids begin with turns of the first of them,
#: fewer than ``HEADS`` each.
FAMILY, HEADS = 100, 6

_KEY = ["depth", "k1", "k2"]


def _turn_hashes(depth: Column, t1: Column, t2: Column) -> list[Column]:
    """What the turn at ``depth`` adds to the key of its prefix."""
    return [F.xxhash64(F.lit(lane), depth.cast("long"), t1, t2).alias(f"f{lane}") for lane in (1, 2)]


def ordered(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, id, t1, t2, len): one row per turn, narrow; ids rise in the order of
    the turns."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = convs.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), said[0].alias("role"),
        F.xxhash64(F.lit(1), *said).alias("t1"), F.xxhash64(F.lit(2), *said).alias("t2"), F.length(said[1]).cast("long").alias("len"))
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), *(F.col(c).asc() for c in ("role", "t1", "t2"))]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.select("conv", F.monotonically_increasing_id().alias("id"), "t1", "t2", "len"))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The conversations of ``ordered`` rows as they are rebuilt: conversation c
    begins with the first h turns of conversation c - c % ``FAMILY`` and goes on
    with its own after its first h, h = crc32(c) % ``HEADS``.

    Returns the conversations, those without turns too (conv, depth, k1, k2,
    total code points, head: the turns that it borrows), their own turns with
    running sums inside a block (conv, blk, depth, len, f1, f2, x1, x2, xlen),
    and what to add to the sums of a block (conv, blk, o1, o2, olen).
    """
    rows = rows.withColumn("blk", F.shiftright("id", BLOCK))
    earlier = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv", "blk").orderBy("id")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = rows.groupBy("conv", "blk").agg(F.count(F.lit(1)).alias("n"))
    blocks = written(blocks.withColumn("off", _or_zero(F.sum("n").over(earlier))))
    at = written(rows.join(blocks.drop("n"), ["conv", "blk"]).withColumn("pos", F.col("off") + F.row_number().over(inside)).drop("off"))

    # what each conversation borrows: at most HEADS - 1 turns of its family's first
    first = at.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "len"))).alias("first"))
    convs = blocks.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    convs = convs.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int")).join(first, "base", "left")
    convs = convs.withColumn("head", F.expr("coalesce(slice(first, 1, h), array())")).withColumn("hs", F.size("head"))
    convs = convs.withColumn("head", F.transform("head", lambda x, i: F.struct((i + 1).cast("long").alias("depth"), x["len"].alias("len"), *_turn_hashes(i + 1, x["t1"], x["t2"]))))
    zero = F.lit(0).cast("long")
    convs = convs.withColumn("head", F.transform("head", lambda x, i: F.struct(
        x["depth"].alias("depth"), x["len"].alias("len"), x["f1"].alias("f1"), x["f2"].alias("f2"),
        F.aggregate(F.slice("head", F.lit(1), i + 1), zero, lambda z, y: z.bitwiseXOR(y["f1"])).alias("k1"),
        F.aggregate(F.slice("head", F.lit(1), i + 1), zero, lambda z, y: z.bitwiseXOR(y["f2"])).alias("k2"),
        F.aggregate(F.slice("head", F.lit(1), i + 1), zero, lambda z, y: z + y["len"]).alias("upto"))))
    convs = written(convs.select("conv", "h", "hs", (F.col("hs") + F.greatest(F.col("n") - F.col("h"), zero)).alias("depth"), "head", *[
        F.when(F.col("hs") > 0, F.element_at("head", -1)[f]).otherwise(zero).alias(f"head_{f}") for f in ("k1", "k2", "upto")]))

    place = blocks.select("conv", "blk").join(convs.select("conv", "h", "hs"), "conv")
    own = at.join(place, ["conv", "blk"]).where(F.col("pos") > F.col("h")).withColumn("depth", F.col("pos") - F.col("h") + F.col("hs"))
    own = own.select("conv", "blk", "id", "depth", "len", *_turn_hashes(F.col("depth"), F.col("t1"), F.col("t2")))
    own = written(own.select("*", F.bit_xor("f1").over(upto).alias("x1"), F.bit_xor("f2").over(upto).alias("x2"), F.sum("len").over(upto).alias("xlen")).drop("id"))
    sums = written(own.groupBy("conv", "blk").agg(F.bit_xor("f1").alias("s1"), F.bit_xor("f2").alias("s2"), F.sum("len").alias("slen")))
    added = lambda s, h: _or_zero(s).bitwiseXOR(F.col(h))
    whole = sums.groupBy("conv").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), F.sum("slen").alias("slen"))
    ends = convs.join(whole, "conv", "left").select("conv", "depth", added(F.col("s1"), "head_k1").alias("k1"), added(F.col("s2"), "head_k2").alias("k2"),
                                                    (F.col("head_upto") + _or_zero(F.col("slen"))).alias("total"), "head")
    starts = sums.join(convs.select("conv", "head_k1", "head_k2", "head_upto"), "conv").select(
        "conv", "blk", added(F.bit_xor("s1").over(earlier), "head_k1").alias("o1"), added(F.bit_xor("s2").over(earlier), "head_k2").alias("o2"),
        (F.col("head_upto") + _or_zero(F.sum("slen").over(earlier))).alias("olen"))
    return written(ends), own, written(starts)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the SHA-256 of the sorted, comma-joined ids
    of the conversations (conv) that end at a node.

    Ids are sorted and written out in pieces everywhere; only the pieces of one
    node meet, and are hashed as they stream by.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        key = None

        def piece() -> pa.RecordBatch:
            cols = [pa.array([v], t) for v, t in zip((*key, held[0], ",".join(map(str, held)).encode()), (pa.int64(),) * 4 + (pa.binary(),))]
            return pa.RecordBatch.from_arrays(cols, [*_KEY, "first", "ids"])

        for b in batches:
            for *now, conv in zip(*(c.to_pylist() for c in b.columns)):
                if now != key or len(held) == PIECE:
                    if held:
                        yield piece()
                    key, held = now, []
                held.append(conv)
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sha = None

        def row(hashed) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in key), pa.array([hashed.hexdigest()])], [*_KEY, "ends_sha256"])

        for b in batches:
            for *now, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if now == key:
                    sha.update(b"," + ids)
                    continue
                if sha:
                    yield row(sha)
                key, sha = now, hashlib.sha256(ids)
        if sha:
            yield row(sha)

    order = [*_KEY, "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "depth long, k1 long, k2 long, first long, ids binary")
    # most nodes have few ends: their piece is the whole list
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _turns(sequences: DataFrame, own: DataFrame, starts: DataFrame) -> DataFrame:
    """One row per turn of the conversations ``u`` that stand for a sequence."""
    told = ["u", "n", "end", "total"]
    place = starts.join(sequences.drop("head"), F.col("conv") == F.col("u")).drop("u")
    mine = own.join(place, ["conv", "blk"]).select(
        "depth", F.col("o1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("o2").bitwiseXOR(F.col("x2")).alias("k2"), "f1", "f2", "len",
        (F.col("olen") + F.col("xlen")).alias("upto"), F.col("conv").alias("u"), "n", "end", "total")
    borrowed = sequences.select(*told, F.explode("head").alias("t")).select(
        *[F.col(f"t.{c}").alias(c) for c in ("depth", "k1", "k2", "f1", "f2", "len", "upto")], *told)
    return mine.unionByName(borrowed)


def prefix_trie(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ends, own, starts = rebuilt(ordered(convs, conv_id, turn, role, text))
    sequences = written(ends.groupBy(*_KEY).agg(F.min("conv").alias("u"), F.count(F.lit(1)).alias("n"), F.min("total").alias("total"), F.first("head").alias("head")).withColumnRenamed("depth", "end"))
    turns = _turns(sequences.drop("k1", "k2"), own, starts)
    parent = [F.col(k).bitwiseXOR(F.col(f)).alias(p) for k, f, p in (("k1", "f1", "p1"), ("k2", "f2", "p2"))]
    found = written(turns.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("sequences"), *[F.min(c).alias(c) for c in ("f1", "f2", "len", "upto", "u", "n", "end", "total")]).select("*", *parent).drop("f1", "f2"))

    # tails without branches, stripped at once
    saved = (F.col("n") - 1) * (F.col("total") - F.col("upto") + F.col("len"))
    tails = found.where("sequences = 1").select(
        *_KEY, "p1", "p2", F.col("u").alias("conv_id"), F.col("n").alias("n_convs"), (F.col("depth") < F.col("end")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
    tops = tails.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2", "n_convs", "saved_tokens")).alias("t"))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    merging = ["k1", "k2", "p1", "p2", "len", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    begun = tops.select((F.col("t.depth") - 1).alias("depth"), F.col("t.p1").alias("k1"), F.col("t.p2").alias("k2"), none.alias("p1"), none.alias("p2"), none.alias("len"),
                        "conv_id", "t.n_convs", F.lit(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "t.saved_tokens")
    ended = sequences.join(tops, sequences["u"] == tops["conv_id"], "left_anti").select(
        F.col("end").alias("depth"), "k1", "k2", none.alias("p1"), none.alias("p2"), none.alias("len"), F.col("u").alias("conv_id"), F.col("n").alias("n_convs"),
        zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    seeds = found.where("sequences > 1").select(*_KEY, "p1", "p2", "len", none.alias("conv_id"), zero.alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
    arriving = written(begun.unionByName(ended).unionByName(seeds).sortWithinPartitions("depth"))

    deepest = arriving.agg(F.max("depth")).first()[0]
    nodes = tails
    survivors = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = arriving.where(F.col("depth") == depth).select(*merging)
        if survivors is not None:  # they give up their last turn
            level = level.unionByName(survivors.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), none.alias("p1"), none.alias("p2"), none.alias("len"), "conv_id", "n_convs",
                                                       F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"))
        level = level.groupBy("k1", "k2").agg(*[F.max(c).alias(c) for c in ("p1", "p2", "len")], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in merging[6:]])
        survivors = written(level.select(
            F.lit(depth).cast("long").alias("depth"), "k1", "k2", "p1", "p2", "conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * _or_zero(F.col("len"))).alias("saved_tokens")))
        nodes = nodes.unionByName(survivors)

    # a parent that branches tells its children its conversation; any other is
    # a tail, of the same one
    nodes = written(nodes)
    above = nodes.join(arriving.select(*_KEY).distinct(), _KEY, "left_semi").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    named = looked_up(nodes, above, ["depth", "p1", "p2"], F.col("k1"))
    named = named.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")))
    nobody = hashlib.sha256(b"").hexdigest()
    return named.join(end_digests(ends), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
