"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from tidewater.llm import conv_trie, queries

from . import cases

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    for c in own:
        own[c] = [t[1:] for t in sorted(own[c])]
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, who in members.items():
        ended = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed=4):
    """Copies, prefixes, gaps, families with and without a first conversation,
    null and empty values, one long conversation and its copy."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 12), *range(100, 130), *range(205, 240), 999, -3, -150, -200]:
        n = rng.choice([1, 2, 3, 5, 7])
        start = rng.randint(0, 3)
        rows += [(c, start + 2 * k, rng.choice(["user", "bot"]) if rng.random() < .3 else "user", f"hello {k}" if rng.random() < .8 else f"é🙂 {rng.randint(0, 2)}") for k in range(n)]
    rows += [(c, k, "user", "the same") for c in (300, 301, 305, 307, 399) for k in range(9)]
    rows += [(c, k, "user", f"long {k}") for c in (400, 450) for k in range(60)] + [(450, 60, None, "end")]
    rows += [(500, None, None, None), (500, 0, "", ""), (500, -1, "user", None), (501, None, None, None), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(502, 1, "user", "z" * 50_000), (502, 2, None, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,piece", [(12, 1 << 16), (2, 2)])
def test_any_conversations(spark, monkeypatch, block, piece):
    monkeypatch.setattr(conv_trie, "BLOCK", block)
    monkeypatch.setattr(conv_trie, "PIECE", piece)
    rows = made()
    wide = T.StructType([*SCHEMA.fields, T.StructField("depth", T.StringType()), T.StructField("n_convs", T.IntegerType())])
    docs = spark.createDataFrame([r + ("x", 1) for r in rows], wide).repartition(5)
    assert result(conv_trie.prefix_trie(docs)) == brute(rows)


def test_repeated_turns_all_count(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "bot", "b"), (7, None, "user", "a"), (7, None, "user", "a")]
    assert result(conv_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nothing(spark):
    assert conv_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conv_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).collect() == []


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op12_conversation_trie(spark, cases.SF)) == brute(rows)
