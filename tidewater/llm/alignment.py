"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Every text is encoded as A (byte-level BPE of a space and the text) and as B
(sentencepiece BPE, which puts the space itself).  Where a token of A and a
token of B end at the same byte, the text is cut into groups; within a group
all tokens of A are linked with all of B.

1. The texts of a batch become lanes, stretches of ``LANE`` tokens or
   a few times that, that begin and end where both tokenizers surely do (before a
   space that follows no white space); a usual text is one lane.
2. One state vector holds for all lanes the next token of A and of B.  Each step
   compares the ends of all lanes' tokens at once and advances the one that
   ends first, or both where they end together, which emits the cut and with it
   the group's links; finished lanes are taken out of the vector.
3. Per text: counts, a digest of the groups, and its distinct id pairs.
4. Corpus-wide: how many texts hold each pair linked, and each A id's highest
   such count.  The ``COMMON`` most frequent pairs are broadcast, which look up
   almost all; the others are joined.

Encoding remembers chunks (words with their leading space), so it costs a
look-up for most words; neither tokenizer joins anything across such a cut.

Defined cases: a text that is null or empty, or that the tokens of A or B don't
give back byte for byte (it holds U+2581, say), has no tokens: zeros and ''.
Strings of special tokens are plain text.  Texts of any length are aligned
whole, lane by lane.  Each row is a document, also if rows repeat a doc_id or
have none.  Ties for an A id's highest count all count.  An empty table gives
no rows; further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ENTRIES, LONGEST, in_groups
from .common import written
from .packing import _encoder

LANE = 512
#: Tokens of A aligned at a time, links spread out at a time.
TOKENS, LINKS = 1 << 19, 1 << 20
#: Pairs that are broadcast (17 bytes each).
COMMON = 1 << 19

_ODD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def split(text: str) -> list[str]:
    """The chunks of a space and ``text``: each begins with the spaces before it,
    at a space that follows no white space."""
    if not _ODD.search(" " + text):
        return [" " + w for w in text.split(" ")]
    text = " " + text
    cuts = [0, *(m.start() for m in _CUT.finditer(text))]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _ragged(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as a padded matrix and their lengths."""
    size = np.array([len(t) for t in tokens])
    out = np.zeros((len(tokens), int(size.max(initial=1))), np.uint8)
    for k, t in enumerate(tokens):
        out[k, :len(t)] = np.frombuffer(t, np.uint8)
    return out, size


class Pair:
    """Two tokenizers, with a bounded memory of chunks, and tables of the bytes
    that their ids stand for and of their ids as text."""

    def __init__(self, a_path: str, pattern: str, b_path: str) -> None:
        import sentencepiece

        self.a = _encoder(a_path, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_a, self.n_b = self.a.n_vocab, self.b.get_piece_size()
        if any("▁" in self.b.id_to_piece(k).lstrip("▁") for k in range(self.n_b)):
            raise ValueError(f"{b_path} has pieces with a space after another character, so chunks can't be encoded apart")
        a_bytes = {i: t for t, i in self.a._mergeable_ranks.items()}
        self.b_text, self.b_size = _ragged([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) else p.replace("▁", " ").encode()
                                             for k, p in enumerate(self.b.id_to_piece(k) for k in range(self.n_b))])
        self.a_size = np.array([len(a_bytes.get(k, b"")) for k in range(self.n_a)])
        a, b = range(self.n_a), range(self.n_b)
        self.names, self.name_size = _ragged([b"%d%s" % (k, end) for ids, ends in ((a, (b",", b"|")), (b, (b",", b";"))) for k in ids for end in ends])
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def _encode(self, chunks: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """The ids of new chunks, None where B's don't give the chunk back."""
        raw = [c.encode() for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = self.b.encode([c[1:] for c in chunks], num_threads=1)
        if " " in chunks:  # the library gives nothing for an empty text
            ids[chunks.index(" ")] = [self.b.piece_to_id("▁")]
        n_b = np.fromiter(map(len, ids), np.int64, len(ids))
        b = np.fromiter(chain.from_iterable(ids), np.uint32, n_b.sum())
        end_b = np.cumsum(n_b)
        bytes_upto = np.append(0, np.cumsum(self.b_size[b]))
        good = (bytes_upto[end_b] - bytes_upto[end_b - n_b] == size).tolist()
        wide = self.b_size[b]
        text, at = self.b_text[b][np.arange(self.b_text.shape[1]) < wide[:, None]].tobytes(), bytes_upto[end_b - n_b].tolist()
        # chunks that end in no white space may be encoded as one text
        apart = [k for k, c in enumerate(chunks) if c[-1].isspace()]
        together = sorted(set(range(len(chunks))) - set(apart))
        a = self.a.encode_to_numpy("".join([chunks[k] for k in together]), disallowed_special=()).astype("<u4")
        end_a = np.searchsorted(np.cumsum(self.a_size[a]), np.cumsum(size[together]), "right").tolist()
        a = a.tobytes()
        ids_a = {k: a[4 * x:4 * y] for k, x, y in zip(together, [0, *end_a], end_a)}
        ids_a |= {k: self.a.encode_to_numpy(chunks[k], disallowed_special=()).astype("<u4").tobytes() for k in apart}
        b, end_b, n_b = b.astype("<u4").tobytes(), end_b.tolist(), n_b.tolist()
        for k, r in enumerate(raw):
            yield (ids_a[k], b[4 * (end_b[k] - n_b[k]):4 * end_b[k]]) if good[k] and text.startswith(r, at[k]) else None

    def encode(self, texts: list[list[str]]) -> list[list[tuple[bytes, bytes] | None]]:
        """Per chunk of each text: its ids of A and B, or None."""
        if len(self.young) > ENTRIES:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        new = set().union(*texts).difference(known)
        for c in [c for c in new if c in old]:
            known[c] = old[c]
            new.remove(c)
        new = list(new)
        long = {}
        for c, v in zip(new, self._encode(new) if new else ()):
            (known if len(c) <= LONGEST else long)[c] = v
        if long:
            known = known | long
        return [[known[c] for c in t] for t in texts]


_LOADED: dict[tuple[str, str, str], Pair] = {}


def load(*paths: str) -> Pair:
    if paths not in _LOADED:
        _LOADED[paths] = Pair(*paths)
    return _LOADED[paths]


def lanes(chunks: list[tuple[bytes, bytes] | None]) -> list[tuple[bytes, bytes]]:
    """The ids of a text's lanes; none if a chunk has no ids."""
    if None in chunks:
        return []
    parts = list(zip(*chunks))
    a, b = map(b"".join, parts)
    if len(a) <= 16 * LANE:
        return [(a, b)]
    x, y = (np.cumsum(np.fromiter(map(len, p), np.int64, len(p))) for p in parts)
    cut = np.unique(np.searchsorted(x, np.append(np.arange(4 * LANE, len(a), 4 * LANE), len(a))))
    cut = np.append(cut[cut < len(x) - 1], len(x) - 1)
    return [(a[p:q], b[r:s]) for p, q, r, s in zip(np.append(0, x[cut[:-1]]), x[cut], np.append(0, y[cut[:-1]]), y[cut])]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where groups begin in A and in B (marks), merging all lanes together.

    ``ends`` are the tokens' end bytes; a lane has the tokens from ``a`` to
    ``a_end`` of A, and those from ``b`` of B up to the same byte.
    """
    cut_a, cut_b = np.zeros(len(ends_a) + 1, bool), np.zeros(len(ends_b) + 1, bool)
    cut_a[a], cut_b[b] = True, True
    while len(a):
        x, y = ends_a[a], ends_b[b]
        a, b = a + (x <= y), b + (y <= x)
        cut = x == y
        cut_a[a[cut]], cut_b[b[cut]] = True, True
        live = ~cut | (a < a_end)
        if not live.all():
            a, a_end, b = a[live], a_end[live], b[live]
    return cut_a[:-1], cut_b[:-1]


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: each item's group's ``first``, and its place in the group."""
    return np.repeat(first, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


def pair_counts(doc: np.ndarray, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc * n_a + A id) * n_b + B id of all links, sorted, and how often
    each is linked; groups begin at ``at_a`` and ``at_b`` and belong to ``doc``."""
    m, n = np.diff(np.append(at_a, len(a))), np.diff(np.append(at_b, len(b)))
    key = lambda doc, x, y: (doc * n_a + x) * n_b + y
    wide = m * n > LINKS >> 4
    parts = []
    for g in np.flatnonzero(wide):  # by distinct ids
        x, p = np.unique(a[at_a[g]:at_a[g] + m[g]], return_counts=True)
        y, q = np.unique(b[at_b[g]:at_b[g] + n[g]], return_counts=True)
        parts.append((key(doc[g], x[:, None], y[None, :]).ravel(), (p[:, None] * q[None, :]).ravel()))
    doc, at_a, at_b, m, n = (v[~wide] for v in (doc, at_a, at_b, m, n))
    turn = np.cumsum(m * n) // LINKS
    for t in np.unique(turn):
        g = slice(*np.searchsorted(turn, [t, t + 1]))
        first, nth = _spread(np.arange(g.start, g.stop), (m * n)[g])
        links = key(doc[first], a[at_a[first] + nth // n[first]], b[at_b[first] + nth % n[first]])
        parts.append(np.unique(links, return_counts=True))
    if len(parts) == 1:
        return parts[0]
    return _counted(*(np.concatenate([p[k] for p in parts]) for k in (0, 1))) if parts else (np.zeros(0, np.int64),) * 2


class _Told:
    """What is known of one text so far."""

    __slots__ = ("counts", "sha", "tail", "pairs")

    def __init__(self) -> None:
        self.counts, self.sha, self.tail, self.pairs = np.zeros(4, np.int64), hashlib.sha256(), b"", []

    def add(self, counts: np.ndarray, groups: bytes, pairs: np.ndarray, times: np.ndarray) -> None:
        self.counts += counts
        self.sha.update(self.tail + groups[:-1])
        self.tail = groups[-1:]
        self.pairs.append((pairs, times))

    def row(self) -> tuple:
        if not self.pairs:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = self.pairs[0] if len(self.pairs) == 1 else _counted(*(np.concatenate([p[k] for p in self.pairs]) for k in (0, 1)))
        return *map(int, self.counts), self.sha.hexdigest(), *pairs


def _merge(two: Pair, batch: list[tuple[int, bytes, bytes]], told: dict[int, _Told]) -> None:
    """Aligns the lanes (doc, ids of A, ids of B) of consecutive docs and adds
    to what is told of each."""
    doc = np.array([x[0] for x in batch])
    base = int(doc[0])
    a, b = (np.frombuffer(b"".join([x[k] for x in batch]), "<u4").astype(np.int64) for k in (1, 2))
    size_a, size_b = (np.array([len(x[k]) >> 2 for x in batch]) for k in (1, 2))
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    cut_a, cut_b = lockstep(np.cumsum(two.a_size[a]), np.cumsum(two.b_size[b]), end_a - size_a, end_a, end_b - size_b)
    at_a, at_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    m, n = np.diff(np.append(at_a, len(a))), np.diff(np.append(at_b, len(b)))
    group_doc = np.repeat(doc, size_a)[at_a] - base
    # the groups as text: the tokens of A, then of B, group by group
    last_a, last_b = np.append(cut_a[1:], True), np.append(cut_b[1:], True)
    names = np.empty(len(a) + len(b), np.int64)
    names[np.arange(len(a)) + np.repeat(at_b, m)] = 2 * a + last_a
    names[np.arange(len(b)) + np.repeat(at_a + m, n)] = 2 * (two.n_a + b) + last_b
    wide = two.name_size[names]
    text = two.names[names][np.arange(two.names.shape[1]) < wide[:, None]].tobytes()
    keys, times = pair_counts(group_doc, a, b, at_a, at_b, two.n_a, two.n_b)

    docs, first = np.unique(doc, return_index=True)
    groups = np.searchsorted(group_doc, docs - base)
    per_doc = [np.add.reduceat(v, first) for v in (size_a, size_b)] + [np.diff(np.append(groups, len(m))), np.add.reduceat(m * n, groups)]
    at_text = np.append(0, np.cumsum(wide))[np.append((end_a - size_a + end_b - size_b)[first], len(names))]
    at_key = np.searchsorted(keys, np.append(docs - base, docs[-1] - base + 1) * (two.n_a * two.n_b))
    for k, d in enumerate(docs.tolist()):
        part = slice(at_key[k], at_key[k + 1])
        told.setdefault(d, _Told()).add(np.array([v[k] for v in per_doc]), text[at_text[k]:at_text[k + 1]], keys[part] % (two.n_a * two.n_b), times[part])


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, a_path: str, pattern: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts, the digest of the groups, the distinct pairs (A id * size of
    B's vocabulary + B id) and how often each is linked.  ``row`` tells rows apart."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, row = load(a_path, pattern, b_path), TaskContext.get().partitionId() << 33
        for b in batches:
            told: dict[int, _Told] = {}
            batch, size, done = [], 0, 0

            def finished(upto: int) -> pa.RecordBatch:
                nonlocal done, row
                rows = [(told.pop(d, None) or _Told()).row() for d in range(done, upto)]
                cols = list(zip(*rows)) if rows else [()] * 7
                ends = pa.array(np.cumsum([0] + [len(p) for p in cols[5]]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64())) for c in cols[5:]]
                out = [pa.array(np.arange(row, row + len(rows))), b.column(0).slice(done, len(rows)), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), *lists]
                done, row = upto, row + len(rows)
                return pa.RecordBatch.from_arrays(out, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

            d = 0
            for group in in_groups(b.column(1).to_pylist()):
                for chunks in two.encode([split(t) if t else [] for t in group]):
                    for x, y in lanes(chunks) if chunks else []:
                        batch.append((d, x, y))
                        size += len(x) >> 2
                        if size >= TOKENS:
                            _merge(two, batch, told)
                            batch, size = [], 0
                            yield finished(d)
                    d += 1
            if batch:
                _merge(two, batch, told)
            yield finished(d)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(align, _ALIGNED)


def linked_counts(found: DataFrame, n_b: int) -> DataFrame:
    """``found`` (as ``aligned`` gives it, written) with n_best and count_sum."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")))
    highest = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("docs").alias("highest"))  # one row per A id at most
    stats = written(counts.join(highest, F.expr(f"pair div {n_b}") == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best")))
    top = stats.orderBy(F.col("docs").desc(), "pair").limit(COMMON).toPandas()
    least = (int(top["docs"].iloc[-1]), int(top["pair"].iloc[-1])) if len(top) == COMMON else None
    top = top.sort_values("pair")
    tables = found.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["docs"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def look(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        pairs, docs, _ = tables.value
        col, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
        ends = col.offsets.to_numpy().astype(np.int64)
        keys = col.flatten().to_numpy()
        at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
        known = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
        return ends - ends[0], keys, times, at, known

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs, best = tables.value
        for b in batches:
            ends, _, times, at, known = look(b)
            times = np.where(known, times, 0)
            total = lambda v: pa.array(np.diff(np.append(0, np.cumsum(v))[ends]), pa.int64())
            some = len(docs) > 0
            out = [*b.columns[:7], total(times * best[at] if some else times), total(times * docs[at] if some else times)]
            yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, keys, times, _, known = look(b)
            rows = np.repeat(b.column("row").to_numpy(), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(v[~known], pa.int64()) for v in (rows, keys, times)], ["row", "pair", "times"])

    out = found.mapInArrow(sums, _ALIGNED.split(", pairs")[0] + ", n_best long, count_sum long")
    if least is not None:
        rare = stats.where((F.col("docs") < least[0]) | (F.col("docs") == least[0]) & (F.col("pair") > least[1]))
        more = found.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long").join(rare, "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("docs")).alias("c"))
        out = out.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("c", F.lit(0)))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def alignment(docs: DataFrame, a_path: str, pattern: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return linked_counts(written(aligned(docs, a_path, pattern, b_path, doc_id, text)), load(a_path, pattern, b_path).n_b)
