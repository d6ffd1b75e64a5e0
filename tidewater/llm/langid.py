"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams, hashed to ``BUCKETS``.
Letters are lower-cased; every stretch without letters becomes one blank, so
digits, symbols and mark-up don't count.  The model is fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of
labelled rows; a temperature fitted on part of that sample calibrates it.
Document frequencies come from all rows that may be learned from.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
rows without a language teach nothing; with no labelled row at all every text
is ``und``; texts of any length count whole; repeated rows are scored each;
further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import attach, summed, written

BUCKETS = 1 << 15
ORDERS = 3
#: Labelled texts per language that the model is fitted on.
SAMPLE_PER_LANGUAGE = 400
#: Characters that are worked on at once; a longer text is taken alone.
BLOCK = 1 << 17
UNKNOWN = "und"
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank; built once a process."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x33480):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        _FOLD = table
    return _FOLD


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, hashed grams, place of each text's
    first gram and the end) for blocks of texts."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= BLOCK):
            size += len(texts[hi] or "") + 1
            hi += 1
        part = [" " + (t or "") for t in texts[lo:hi]]
        c = _fold()[np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)]
        of = np.repeat(np.arange(hi - lo), [len(t) for t in part])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (of[1:] != of[:-1])
        c, of = c[keep].astype(np.uint64), of[keep]
        codes, owner = [], []
        h = np.zeros(len(c), np.uint64)
        for n in range(ORDERS):
            m = max(len(c) - n, 0)
            h = h[:m] + (c[n:] + np.uint64(1)) * _STEPS[n]
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            good = of[:m] == of[n:]
            if not n:
                good &= c[:m] != 32  # a blank alone says nothing
            codes.append((x >> np.uint64(64 - 15))[good].astype(np.int32))
            owner.append(of[:m][good])
        code, own = np.concatenate(codes), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        yield lo, hi, code[order], np.searchsorted(own[order], np.arange(hi - lo + 1))
        lo = hi


def _has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([any(map(str.isalpha, t or "")) for t in texts], bool)


def document_frequency(rows: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and how many rows there are."""
    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(BUCKETS + 1, np.int64)
        for lo, hi, code, at in grams(batch.column(0).to_pylist()):
            for a, b in zip(at[:-1], at[1:]):
                seen = np.zeros(BUCKETS, bool)
                seen[code[a:b]] = True
                total[:-1] += seen
        total[-1] = batch.num_rows
        return total

    v = summed(rows.select(text), BUCKETS + 1, count)
    return v[:-1], int(v[-1])


def labelled_sample(rows: DataFrame, text: str, lang: str, per_language: int) -> list:
    """At most ``per_language`` different texts of each language, chosen by a
    hash of the text, as (lang, buckets, counts).

    Counts of the different texts by language thin the rows first, so no
    language's rows meet in one task; the copies of a text are then made one,
    and the exact cut is made on what is left.  The counts shuffle hashes
    only.  A language with any labelled text is in the sample.
    """
    rows = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    most = F.floor(1_000_003 * (1.5 * per_language + 30) / F.col("n")) + 1
    shares = written(rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", most.alias("share")))
    key = F.pmod(F.col("h"), F.lit(1_000_003))
    some = attach(rows, shares, "lang", F.col("h")).withColumn("key", key).where(F.col("key") < F.col("share"))
    some = some.groupBy("lang", "h").agg(F.min("text").alias("text"), F.min("key").alias("key"))
    w = Window.partitionBy("lang").orderBy("key", F.length("text"), "text")
    some = some.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).select("lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idx, cnt = [], []
            for _, _, code, at in grams(b.column("text").to_pylist()):
                for a, z in zip(at[:-1], at[1:]):
                    u, n = np.unique(code[a:z], return_counts=True)
                    idx.append(u.astype(np.int32))
                    cnt.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(idx, pa.list_(pa.int32())), pa.array(cnt, pa.list_(pa.int32()))], ["lang", "idx", "cnt"])

    return [(r["lang"], np.array(r["idx"], np.int64), np.array(r["cnt"], float))
            for r in some.mapInArrow(features, "lang string, idx array<int>, cnt array<int>").collect()]


@dataclass
class LanguageModel:
    """langs in order; ``table`` (BUCKETS x langs) holds weight times idf;
    logits are ``bias`` + the mean of a text's rows of it, over temperature."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for lo, hi, code, at in grams(texts):
            n = np.diff(at)
            if len(code):
                full = n > 0
                out[lo:hi][full] = np.add.reduceat(self.table[code], at[:-1][full], axis=0, dtype=np.float64) / n[full, None]
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        has = _has_letter(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return [self.langs[k] if h else UNKNOWN for k, h in zip(best, has)], np.where(has, p.max(1), 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, size: int, epochs: int = 4,
         alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size x classes) and bias by FTRL-proximal, one row at a time.

    The proximal step with both penalties sets a weight to zero unless its
    gradient sum passes ``l1``; per-coordinate rates shrink with the gradients
    seen.  The bias is a coordinate without penalties.
    """
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(i: np.ndarray) -> np.ndarray:
        small = np.where(i == size, 0.0, 1.0)[:, None]
        return -np.sign(z[i]) * np.maximum(np.abs(z[i]) - l1 * small, 0) / ((beta + np.sqrt(n[i])) / alpha + l2 * small)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x = rows[k]
            i, x = np.append(i, size), np.append(x, 1.0)
            w = weights(i)
            p = _softmax(x @ w)
            p[labels[k]] -= 1
            g = x[:, None] * p
            old = n[i]
            n[i] = old + g * g
            z[i] += g - (np.sqrt(n[i]) - np.sqrt(old)) / alpha * w
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


#: The mean TF-IDF weight of a text is this small a number; scaled to about one.
SCALE = 30.0


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """The model from the rows of ``rows`` with a language: frequencies from
    all of them, weights and temperature from the bounded sample (a fifth of
    it, every fifth row in hash order, is kept for the temperature)."""
    rows = rows.where(F.col(lang).isNotNull())
    sample = labelled_sample(rows, text, lang, per_language)
    langs = sorted({s[0] for s in sample})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    df, n = document_frequency(rows, text)
    idf = SCALE * np.log((1 + n) / (1 + df))
    sample.sort(key=lambda s: (s[0], len(s[1]), s[1].tolist()))
    x = [(i, c / c.sum() * idf[i]) for _, i, c in sample]
    y = np.array([langs.index(s[0]) for s in sample])
    aside = np.arange(len(x)) % 5 == 4 if len(x) >= 10 * len(langs) else np.zeros(len(x), bool)
    w, bias = ftrl([x[k] for k in np.flatnonzero(~aside)], y[~aside], len(langs), BUCKETS)
    held = aside if aside.any() else ~aside
    z = np.array([x[k][1] @ w[x[k][0]] + bias for k in np.flatnonzero(held)])
    return LanguageModel(langs, (w * idf[:, None]).astype(np.float32), bias, temperature(z, y[held]))


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature in [0.2, 20] with the least loss on logits ``z``."""
    def loss(t: float) -> float:
        p = _softmax(z / t)[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    return float(min(np.geomspace(0.2, 20, 93), key=loss))


def predictions(model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, score = model.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": score})

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), predictions(model, F.col(text)).alias("p"))
    return rows.select("doc_id", "p.lang_pred", "p.score")
