"""Quality scores by voting of the nearest labelled documents.

A document is a bag of hashed features: its lower-cased words, their shapes
(runs of small letters, capitals, digits; symbols as they are), neighbouring
pairs of shapes, and whether a word repeats the one before.  Weighted by TF-IDF
and projected on the leading singular vectors of a bounded labelled sample, it
becomes a short latent vector.  The sample's vectors are broadcast; every
document is compared with all of them by cosine, in blocks of one matrix
product each, and its ``NEIGHBOURS`` nearest vote with their label, weighted by
similarity and so that each class counts with its share of all labels.

Document frequencies come from all documents.

Defined cases: a text that is null or has no word gets the share of label 1
among the labels (0.5 without labels); texts of any length count whole; labels
other than 0 and 1 and rows without a document teach nothing; a document with
both labels counts once with each; repeated rows are scored each; further
columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import summed
from .wordhash import blocks, mix, words

WORDS, SHAPES, PAIRS = 4096, 2048, 2048
REPEAT = WORDS + SHAPES + PAIRS
SIZE = REPEAT + 1
DIMENSIONS = 48
NEIGHBOURS = 25
#: Labelled documents of either class that the sample holds.
SAMPLE_PER_CLASS = 1_000
BLOCK = 1 << 17

_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = 97
_KIND[65:91] = 65
_KIND[48:58] = 48
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, a word's four features each, index of
    each text's first word and the end); ``SIZE`` stands for no feature."""
    for lo, hi, data, at in blocks(texts, BLOCK):
        h, _, _, first = words(data, at)
        kind = _KIND[data]
        keep = np.ones(len(kind), bool)
        keep[1:] = (kind[1:] != kind[:-1]) | _BLANK[kind[1:]]
        keep[at[:-1][at[:-1] < len(kind)]] = True
        shape, _, _, _ = words(kind[keep], np.concatenate(([0], np.cumsum(keep)))[at], lower=False)
        begins = np.zeros(len(h), bool)
        begins[first[:-1][first[:-1] < len(h)]] = True
        out = np.full((len(h), 4), SIZE, np.int32)
        out[:, 0] = h % np.uint64(WORDS)
        out[:, 1] = WORDS + shape % np.uint64(SHAPES)
        pair = WORDS + SHAPES + mix(shape[:-1] * np.uint64(3) + shape[1:]) % np.uint64(PAIRS)
        inside = ~begins[1:]
        out[1:, 2][inside] = pair[inside]
        out[1:, 3][inside & (h[1:] == h[:-1])] = REPEAT
        yield lo, hi, out, first


def document_frequency(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each feature occurs, and how many there are."""
    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(SIZE + 1, np.int64)
        for _, _, f, at in features(batch.column(0)):
            for a, b in zip(at[:-1], at[1:]):
                seen = np.zeros(SIZE + 1, bool)
                seen[f[a:b]] = True
                total += seen
        total[SIZE] = batch.num_rows
        return total

    v = summed(docs.select(text), SIZE + 1, count)
    return v[:SIZE], int(v[SIZE])


@dataclass
class QualityModel:
    """``table`` (SIZE + 1 x dimensions) is idf times singular vectors, its last
    row zero; ``vectors`` are the labelled documents', of unit length; ``votes``
    their weights and ``labels``; ``prior`` is the share of label 1."""

    table: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float

    def latent(self, texts: pa.Array) -> np.ndarray:
        """Unit vectors of texts; zero without a word."""
        out = np.zeros((len(texts), self.table.shape[1]), np.float32)
        for lo, hi, f, at in features(texts):
            full = np.diff(at) > 0
            if full.any():
                out[lo:hi][full] = np.add.reduceat(self.table[f.ravel()], 4 * at[:-1][full], axis=0)
        return _unit(out)

    def scores(self, texts: pa.Array) -> np.ndarray:
        v = self.latent(texts)
        out = np.full(len(texts), self.prior)
        k = min(NEIGHBOURS, len(self.vectors))
        some = np.flatnonzero(np.abs(v).sum(1) > 0) if k else np.zeros(0, int)
        for at in np.array_split(some, max(1, len(some) // 512)):
            if not len(at):
                continue
            cosine = v[at] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(float) ** 4 * self.votes[near]
            out[at] = (w * self.labels[near]).sum(1) / w.sum(1)
        return np.clip(out, 0.0, 1.0)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, per_class: int) -> tuple[list, dict[int, int]]:
    """(label, features, counts) of at most ``per_class`` documents of each
    label, and how many labels of each there are.

    The ids are chosen by their hash before any text is read; there are about
    twice ``per_class`` at most, so they are broadcast to the documents.
    """
    labels = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).distinct()
    counts = {r["_label"]: r["count"] for r in labels.groupBy("_label").count().collect()}
    if not counts:
        return [], {}
    draw = F.pmod(F.xxhash64("_id", F.lit(8)), F.lit(1_000_003))
    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col("_label") == k, F.lit(int(1_000_003 * (1.3 * per_class + 30) / n) + 1)).otherwise(share)
    some = labels.where(draw < share)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, cnt = [], []
            for _, _, f, at in features(b.column("text")):
                for x, y in zip(at[:-1], at[1:]):
                    u, n = np.unique(f[x:y], return_counts=True)
                    idx.append(u[u < SIZE])
                    cnt.append(n[u < SIZE].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(idx, pa.list_(pa.int32())), pa.array(cnt, pa.list_(pa.int32()))], ["id", "label", "idx", "cnt"])

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(some), texts["id"] == some["_id"])
    # of an id's rows the one whose text has the smallest digest, wherever they lie
    rows = rows.groupBy("id", F.col("_label").alias("label")).agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text"))
    got = rows.mapInArrow(bags, "id long, label int, idx array<int>, cnt array<int>").collect()
    got.sort(key=lambda r: (r["label"], r["id"]))
    out, have = [], {0: 0, 1: 0}
    for r in got:
        if len(r["idx"]) and have[r["label"]] < per_class:
            have[r["label"]] += 1
            out.append((r["label"], np.array(r["idx"]), np.array(r["cnt"], np.float32)))
    return out, counts


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id",
        per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """The model from the documents that ``labels`` names."""
    sample, counts = labelled_sample(docs, labels, text, label, key, per_class)
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if not sample:
        none = np.zeros((0, 1), np.float32)
        return QualityModel(np.zeros((SIZE + 1, 1), np.float32), none, np.zeros(0), np.zeros(0), prior)
    df, n = document_frequency(docs, text)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    x = np.zeros((len(sample), SIZE), np.float32)
    for k, (_, i, c) in enumerate(sample):
        x[k, i] = c * idf[i]
    x = _unit(x)
    basis = leading_vectors(x, min(DIMENSIONS, len(sample), SIZE))
    y = np.array([s[0] for s in sample], float)
    share = np.where(y == 1, prior / max((y == 1).sum(), 1), (1 - prior) / max((y == 0).sum(), 1))
    table = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)
    return QualityModel(table, _unit(x @ basis), y, share * len(y), prior)


def leading_vectors(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """The k leading right singular vectors, by subspace iteration."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(x.T @ (x @ rng.normal(size=(x.shape[1], min(k + 10, x.shape[1]))).astype(np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :k]).astype(np.float32)


def scored(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(score, "doc_id long, score double")
