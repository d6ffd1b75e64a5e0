"""Language identification, quality voting and nearest neighbours."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.llm import ann, knn_quality, langid, queries

from . import cases

SF = "/root/testdata/sf0.01"


def test_languages_on_held_out_documents(spark):
    got = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right")).first()
    assert r["n"] > 250 and r["right"] > 0.97
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where("held_out").count() == got.where("crc32(cast(doc_id as string)) % 3 = 1").count()


def test_language_edge_rows(spark):
    docs = cases.documents(spark)
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    for k in (0, 1, 2, 18):
        assert by[k]["lang_pred"] == "und" and by[k]["score"] == 0
    assert by[17]["lang_pred"] in model.langs
    assert langid.identify(cases.nothing(spark), model).collect() == []
    empty = langid.fit(cases.nothing(spark))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_every_language_is_sampled(spark):
    copies = spark.range(15_000).selectExpr("concat('copied', id % 5) as lang", "concat('the only text of language ', id % 5) as text")
    some = spark.range(600).selectExpr("'some' as lang", "concat('text of words ', id) as text")
    rare = spark.range(210).selectExpr("concat('rare', id) as lang", "concat('a rare text ', id) as text")
    got = langid.labelled_sample(copies.union(some).union(rare), "text", "lang", 400)
    n = Counter(r[0] for r in got)
    assert len(n) == 5 + 1 + 210 and n["some"] == 400
    assert all(n[f"copied{k}"] == 1 for k in range(5))


def test_grams_respect_texts_and_blocks(monkeypatch):
    texts = ["Ab1c", None, "", "ab c", "x" * 50, "é漢🙂z"]
    whole = [c.tolist() for lo, hi, code, at in langid.grams(texts) for c in np.split(code, at[1:-1])]
    monkeypatch.setattr(langid, "BLOCK", 3)
    assert [c.tolist() for lo, hi, code, at in langid.grams(texts) for c in np.split(code, at[1:-1])] == whole
    assert sorted(whole[0]) == sorted(whole[3]) and whole[1] == whole[2] == []


def test_temperature_and_sparsity():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    z = np.stack([np.where(y == 0, 1.0, -1.0), np.where(y == 1, 1.0, -1.0)], 1) + rng.normal(0, 1, (500, 2))
    t = langid.temperature(5 * z, y)
    nll = lambda t: -np.log(langid._softmax(5 * z / t)[np.arange(500), y]).mean()
    assert nll(t) <= min(nll(t / 1.1), nll(t * 1.1)) and t > 2
    rows = [(np.array([k % 2, 2 + k % 7]), np.array([1.0, 1.0])) for k in range(200)]
    w, _ = langid.ftrl(rows, np.arange(200) % 2, 2, 50)
    assert (w[0] != 0).any() and (w[20:] == 0).all()


def test_quality_on_held_out_documents(spark):
    got = queries.op8_knn_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good = np.array([r["score"] for r in got if r["quality"] == 1])
    bad = np.array([r["score"] for r in got if r["quality"] == 0])
    auc = (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()
    assert auc > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_quality_edge_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(6, 1), (9, 1), (10, 1), (11, 0), (12, 0), (12, 1), (13, None), (77, 0), (None, 1), (3, 5)], "doc_id long, quality int")
    model = knn_quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in knn_quality.scored(docs, model).collect()}
    assert len(got) == len({r[0] for r in cases.rows()})
    assert all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[1] == got[2] == model.prior
    assert got[6] > got[11]
    assert knn_quality.scored(cases.nothing(spark), model).collect() == []
    none = knn_quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in knn_quality.scored(docs, none).collect()} == {0.5}


def test_quality_features_ignore_blocks(monkeypatch):
    texts = pa.array([r[1] for r in cases.rows()], pa.string())
    flat = lambda: [f[a:b].tolist() for _, _, f, at in knn_quality.features(texts) for a, b in zip(at[:-1], at[1:])]
    whole = flat()
    monkeypatch.setattr(knn_quality, "BLOCK", 100)
    assert flat() == whole and [len(x) for x in whole] == [len(cases.words(r[1])) for r in cases.rows()]


def brute_nearest(rows, k=20, by=20):
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, (i, v) in enumerate(rows):
        if i % by == 0:
            s = x @ np.array(v, float)
            order = sorted((j for j in range(len(rows)) if rows[j][0] != i), key=lambda j: (-s[j], rows[j][0]))[:k]
            out[i] = [(rows[j][0], s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        want, got = brute_nearest(rows), found(queries.op6_multi_index_hashing(spark, sf))
        assert want.keys() == got.keys()
        hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / len(want[q]) for q in want]
        assert np.mean(hits) >= 0.9
        score = {(q, i): s for q in want for i, s in want[q]}
        assert all(len(got[q]) == 20 for q in got)
        assert all(math.isclose(s, score[q, i], rel_tol=1e-12) for q in got for i, s in got[q] if (q, i) in score)


def test_neighbours_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).round(2).tolist()) for k in range(90)]
    rows += [(100 + k, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for k in range(60)] + [(40, rows[40][1])]
    odd = [(400, None), (420, [0.0] * 6), (440, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (460, [float("nan")] * 6), (480, [1.0, 2.0]), (None, rows[1][1]), (500, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, score string")
    got = found(ann.nearest(df, F.col("id") % 20 == 0, radius=ann.BITS))
    want = brute_nearest(list(dict(rows).items()))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert found(ann.nearest(few, F.col("id") % 20 == 0)) == {0: [(20, 0.5), (3, 0.0)], 20: [(0, 0.5), (3, 0.5)]}
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert ann.nearest(one, F.col("id") % 20 == 0).collect() == []


def test_quality_scores_do_not_depend_on_the_partitions(spark):
    texts = ["the quiet river and the stone garden of winter music", "buy now buy now cheap cheap click", "la la la la la", "a letter of the cloud in the field", "win win win money money"]
    docs = spark.createDataFrame([(k % 3, texts[(k * 7) % 5] + f" {k}") for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = [[r["score"] for r in knn_quality.scored(asked, knn_quality.fit(docs.repartition(n), labels)).orderBy("doc_id").collect()] for n in (1, 4, 7)]
    assert scores[0] == scores[1] == scores[2]
