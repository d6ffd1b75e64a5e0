"""SimHash near-duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidewater.llm import queries, simhash

from . import cases


def brute_fingerprint(text):
    w = [x.encode() for x in cases.words("".join(c.lower() if c.isascii() else c for c in text or ""))]
    grams = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    ids = [(i, f) for i, f in fps if i is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(ids, 2) if a == b or bin(x ^ y).count("1") <= 3]
    comp = cases.components({i for i, _ in ids}, links)
    return sorted(((i, f"{f:016x}", comp.get(i)) for i, f in fps), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_edge_rows(spark):
    assert result(simhash.near_duplicates(cases.documents(spark))) == brute([r[:2] for r in cases.rows()])
    assert simhash.near_duplicates(cases.nothing(spark)).collect() == []


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()]
    assert result(queries.op11_simhash_neardup(spark, cases.SF)) == brute(rows)


def test_long_texts_in_blocks(monkeypatch):
    text = cases.prose(random.Random(3), 4_000) + "\n\x0b" + "y" * 5_000 + " tail of it "
    whole = simhash.fingerprint(text.encode())
    assert whole == brute_fingerprint(text)
    for size in (1, 7, 64, 4_096):
        monkeypatch.setattr(simhash, "BLOCK", size)
        assert simhash.fingerprint(text.encode()) == whole


def near(rng, n, centres=6, flips=5):
    """Fingerprints around a few centres and others anywhere."""
    out = set(rng.getrandbits(64) for _ in range(n // 3)) | {0, 1, 7, 15, 2 ** 64 - 1, 2 ** 63}
    middle = [rng.getrandbits(64) for _ in range(centres)]
    while len(out) < n:
        x = rng.choice(middle)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randint(0, 63)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("large,pairs,leaf", [(100_000, 1 << 14, 64), (20, 5, 1), (3, 1 << 14, 64)])
def test_trie_join_equals_all_pairs(spark, monkeypatch, large, pairs, leaf):
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "ROWS", 50)
    fps = near(random.Random(large), 400)
    rows = [(x - 2 ** 64 if x >> 63 else x, k) for k, x in enumerate(fps)]
    got = [(r["a"], r["b"]) for r in simhash.trie_links(spark.createDataFrame(rows, "fp long, doc long").repartition(3)).collect()]
    want = [(i, j) for i, j in combinations(range(len(fps)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    assert len(want) > 300 and len(got) < 60 * len(fps)
    assert cases.components(range(len(fps)), got) == cases.components(range(len(fps)), want)


def test_traversal_finds_every_pair_once_and_prunes():
    keys = np.array(near(random.Random(9), 3_000), np.uint64)
    one = np.array([0]), np.array([len(keys)])
    found = [np.stack(p, 1) for p in simhash.join_nodes(keys, [(0, *one, *one, np.array([0]), np.array([True]))])]
    found = sorted(map(tuple, np.concatenate(found).tolist()))
    apart = np.bitwise_count(keys[:, None] ^ keys[None, :])
    assert found == sorted(map(tuple, np.argwhere(np.triu(apart <= 3, 1)).tolist()))
