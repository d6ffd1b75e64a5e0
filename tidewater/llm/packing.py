"""Packing of tokenized documents into sequences of a fixed length.

Documents are tokenized and cut into pieces of at most ``CONTEXT`` tokens.  How
pieces share sequences is decided on the histogram of piece lengths alone,
which has ``CONTEXT`` bins whatever the corpus:

1. enumerate the patterns, the ways in which one, two or three lengths fill a
   sequence exactly;
2. fit a repeat count to each pattern by non-negative least squares, so that
   the patterns used so often need the histogram's pieces;
3. round the counts down and take their pieces off the histogram;
4. pack what is left by best fit, longest first, still by whole bins: as many
   sequences at once as the bins allow.

The plan is a table of runs: of the pieces of one length, those ranked lo to
hi - 1 go to consecutive sequences, at a fixed offset.  A piece's rank within
its length comes from its place within the task that made it and the counts of
the tasks before.

Defined cases: a null text is an empty one and makes one piece, the closing
id; the string of an added token in a text is that token, as in the library; texts of any length are cut, never shortened; repeated rows are packed
each; an empty table gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

CONTEXT = 1024
END = 2
_LOADED: dict[tuple[str, str], object] = {}


def _encoder(path: str, pattern: str):
    """An encoder for the byte-level BPE file of the ``tokenizers`` library.

    The file's vocabulary is run by ``tiktoken``, whose merging is five times
    as fast; ids are the same, as the tests check against ``tokenizers``.  The
    file's added tokens are the special tokens; whether their strings in a text
    are taken for them is up to the caller.  Loaded once a process.
    """
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model.get("added_tokens", [])
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that are more than plain strings")
        special = {t["id"] for t in added}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): k for token, k in model["model"]["vocab"].items() if k not in special}
        _LOADED[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
    return _LOADED[path, pattern]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text", context: int = CONTEXT, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth counts the
    task's pieces of that length."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(tokenizer, pattern), np.zeros(context + 1, np.int64)
        special = encoder.special_tokens_set
        task, last = TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        for b in batches:
            rows = []
            for at, text_ in enumerate(b.column(1)):
                text_ = text_.as_py() or ""
                # the library cuts a text at the strings of its added tokens
                allowed = special if any(s in text_ for s in special) else set()
                ids = encoder.encode_to_numpy(text_, allowed_special=allowed, disallowed_special=()).astype("<u4").tobytes() + last
                n = len(ids) // 4
                for k, z in enumerate(range((n - 1) % context + 1, n + 1, context)):
                    a = max(z - context, 0)
                    rows.append((at, k, a, z - a, zlib.crc32(ids[4 * a:4 * z]), seen[z - a]))
                    seen[z - a] += 1
            cols = np.array(rows, np.int64).reshape(-1, 6).T.copy()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:5]), pa.array(np.full(len(rows), task, np.int32)), pa.array(cols[5])],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, _PIECES)


def patterns(context: int, used: np.ndarray) -> np.ndarray:
    """All multisets of at most three of the lengths in use that add up to
    ``context``, as rows of three (0: none)."""
    have = np.zeros(context + 1, bool)
    have[used] = True
    out = [np.array([[context, 0, 0]])] if have[context] else []
    a = np.arange(1, context // 2 + 1)
    b = context - a
    both = have[a] & have[b]
    out.append(np.stack([b, a, np.zeros_like(a)], 1)[both])
    for c in np.flatnonzero(have[:context // 3 + 1]):
        b = np.arange(c, (context - c) // 2 + 1)
        a = context - c - b
        good = have[b] & have[a]
        out.append(np.stack([a, b, np.full_like(a, c)], 1)[good])
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def fitted(kinds: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths close to the
    histogram in least squares, by accelerated projected gradient steps.

    A row of the pattern matrix has three entries at most, so a step is a
    gather and a bincount.
    """
    if not len(kinds):
        return np.zeros(0)
    size = len(histogram)
    mass = (kinds > 0).astype(float)
    weight = 1.0 / np.sqrt(np.maximum(histogram, 1.0))  # every bin's error in its own size

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(kinds.ravel(), (mass * x[:, None]).ravel(), size)[:size]

    def back(r: np.ndarray) -> np.ndarray:
        return (r[kinds] * mass).sum(1)

    uses = times(np.ones(len(kinds)))
    # a bound on the largest eigenvalue: columns sum to three at most
    step = 1.0 / max(3.0 * float((uses * weight ** 2).max()), 1e-12)
    start = np.min(np.where(kinds > 0, histogram[kinds] / np.maximum(uses[kinds], 1), np.inf), 1)
    x = y = start
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * back(weight ** 2 * (times(y) - histogram)), 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: np.ndarray, context: int = CONTEXT) -> np.ndarray:
    """Runs (length, lo, hi, sequence, offset): piece ranked lo + i of that
    length is at ``offset`` of sequence ``sequence`` + i."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros(context + 1, np.int64)
    runs, sequence = [], 0

    def place(lengths: list[int], times: int) -> None:
        """``times`` sequences of these lengths; equal lengths take turns."""
        nonlocal sequence
        offset = 0
        for n in lengths:
            runs.append((n, used[n], used[n] + times, sequence, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequence += times

    kinds = patterns(context, np.flatnonzero(left))
    counts = np.floor(fitted(kinds, left.astype(float)) + 1e-9).astype(np.int64)
    for k in np.argsort(-counts, kind="stable"):
        lengths = [int(n) for n in kinds[k] if n]
        times = min([int(counts[k])] + [int(left[n]) // lengths.count(n) for n in lengths])
        if times > 0:
            place(lengths, times)
    # residuals: take the longest, fill it with the longest that still fits,
    # and repeat that sequence as often as all its lengths are there
    while left.any():
        room, chosen, have = context, [], left.copy()
        while True:
            fits = np.flatnonzero(have[:room + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            m = min(int(have[n]), room // n)
            chosen += [n] * m
            have[n] -= m
            room -= n * m
        place(chosen, min(int(left[n]) // chosen.count(n) for n in set(chosen)))
    return np.array(runs, np.int64).reshape(-1, 5)


def packed(made: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``made`` (as ``pieces`` gives it, written) with sequence_id and offset."""
    counts = written(made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(context + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    runs = plan(histogram, context)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = runs[:, 0] << 48 | runs[:, 1]  # a length has fewer than 2 ** 48 pieces

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, n << 48 | rank, "right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = made.join(starts, ["task", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text", context: int = CONTEXT, end: int = END) -> DataFrame:
    return packed(written(pieces(docs, tokenizer, pattern, doc_id, text, context, end)), context)
