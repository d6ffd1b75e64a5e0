"""Near duplicates and components against brute force."""

import random
from itertools import combinations

import numpy as np

from tidewater.llm import components, neardup, queries
from tidewater.llm.wordhash import shingle_sets
import pyarrow as pa

from . import cases


def brute(rows):
    sets = [(i, cases.shingles(t)) for i, t in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if a == b or x and y and 100 * len(x & y) >= 85 * len(x | y)]
    comp = cases.components({i for i, _ in sets}, links)
    return sorted(((i, len(cases.shingles(t)), comp.get(i)) for i, t in rows), key=repr)


def result(df):
    rows = df.collect()
    for r in rows:
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


def test_shingle_sets_have_the_right_size():
    texts = [r[1] for r in cases.rows()]
    assert [len(s) for s in shingle_sets(pa.array(texts, pa.string()))] == [len(cases.shingles(t)) for t in texts]
    some = pa.array(["skip"] + texts, pa.string())[1:]
    assert [len(s) for s in shingle_sets(some)] == [len(cases.shingles(t)) for t in texts]


def test_edge_rows(spark):
    assert result(neardup.near_duplicates(cases.documents(spark))) == brute([r[:2] for r in cases.rows()])
    assert neardup.near_duplicates(cases.nothing(spark)).collect() == []


def test_documents_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()]
    assert result(queries.op4_minhash_neardup(spark, cases.SF)) == brute(rows)


def variants(seed=2, n=150, size=90):
    """Edits of one text by up to 12 words: similarities on both sides of the
    limit, so that components hang together by other texts than the first."""
    rng = random.Random(seed)
    whole = [f"w{rng.randint(0, 400)}" for _ in range(size)]
    out = []
    for k in range(n):
        w = list(whole)
        at = rng.randint(0, size - 13)
        for j in range(rng.randint(0, 12)):
            w[at + j] = f"x{rng.randint(0, 3)}"
        out.append((k * 3 + 1, " ".join(w)))
    return out


def test_star_points_that_link_only_to_each_other(spark, monkeypatch):
    rows = variants() + [(900 + k, t) for k, t in enumerate(["a b c d e f g"] * 40)]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.near_duplicates(docs)) == want
    # the same with every bucket taken for a large one, in small blocks
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BLOCK", 600)
    monkeypatch.setattr(neardup, "STAR", 5)
    assert result(neardup.near_duplicates(docs)) == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for size in (7, 40, 600):
        x = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[: int(size * 0.92)], rng.integers(0, 2 ** 63, size - int(size * 0.92), dtype=np.uint64) * np.uint64(2)]))
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((neardup.signature(x) == neardup.signature(y)).mean() - j) < 0.3


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (7, 7), (300, 301)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 150: 100, 200: 100, 300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_document_of_each_group_stays(spark):
    docs = cases.documents(spark)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {i for i, _, c in brute([r[:2] for r in cases.rows()]) if i == c and i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_id_filter_never_misses(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidewater.llm import common
    ids = spark.range(0, 40_000, 2).select(F.col("id").alias("k"))
    all_ = spark.range(-10, 40_000).withColumn("id", F.when(F.col("id") >= 0, F.col("id")))
    hit = {r["id"] for r in all_.where(common.maybe_among(ids)(F.col("id"))).collect()}
    assert set(range(0, 40_000, 2)) <= hit and len(hit) < 20_000 * 1.05 and None not in hit
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 14)  # outgrown: says true more often, misses nothing
    assert set(range(0, 40_000, 2)) <= {r["id"] for r in all_.where(common.maybe_among(ids)(F.col("id"))).collect()}
    assert all_.where(common.maybe_among(ids.limit(0))(F.col("id"))).count() == 0
