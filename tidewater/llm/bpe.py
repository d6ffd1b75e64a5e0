"""Byte-level BPE, encoding and decoding, in numpy.

The pieces that the splitting pattern makes are grouped by byte length and put
into matrices, one row a piece, padded.  Each round looks every neighbouring
pair up in a hash table, merges each row's leftmost pair of least rank, and
closes the gap; rows without a known pair are done and leave the matrix.
Pieces longer than ``WIDEST`` bytes, for which rounds over a whole row would
cost the square of the length, are merged pair by pair from a heap in the same
order.  A pair's rank is that of its joined bytes, as in the rank files.

Defined cases: a null or empty text has no ids and decodes to nothing; texts of
any length are encoded whole; repeated rows are encoded each; an empty table
gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memory, in_groups, split

WIDEST = 256
#: Cells of a matrix.
CELLS = 1 << 16
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(1 << 30)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Bpe:
    """A vocabulary of ranks with its pair table."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.find = regex.compile(pattern).findall
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, r in ranks.items():
            self.bytes[r] = token
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        pairs = {}
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[(a, b)] = r
        self.pairs = pairs
        self._table(pairs)

    def _table(self, pairs: dict[tuple[int, int], int]) -> None:
        """Open addressing: a pair is at its slot or at most ``self.reach`` on."""
        bits = max(4, (2 * len(pairs)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        key = np.array([a << 32 | b for a, b in pairs], np.uint64).reshape(-1)
        val = np.array(list(pairs.values()), np.int32)
        slot = ((key * _MULT) >> self.shift).astype(np.int64)
        self.keys, self.vals = np.full((1 << bits) + 64, _FREE), np.full((1 << bits) + 64, _NONE)
        todo, self.reach = np.arange(len(key)), 0
        while len(todo):
            at = slot[todo] + self.reach
            free = self.keys[at] == _FREE
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(todo), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.vals[at[put]] = key[todo[put]], val[todo[put]]
            todo, self.reach = todo[~put], self.reach + 1
            if self.reach >= 64 and len(todo):
                raise ValueError("the pair table is too full")

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; ``_NONE`` where there is no such token
        (b below 0: padding)."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint32)
        slot = ((key * _MULT) >> self.shift).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == key, self.vals[slot], _NONE).ravel()
        open_ = np.flatnonzero((held != key) & (held != _FREE) & (b >= 0))
        key, slot = key.ravel(), slot.ravel()
        for step in range(1, self.reach):
            if not len(open_):
                break
            at = slot[open_] + step
            held = self.keys[at]
            found = held == key[open_]
            out[open_[found]] = self.vals[at[found]]
            open_ = open_[~found & (held != _FREE)]
        return out.reshape(a.shape)

    def _matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (32-bit) of pieces of two bytes or more, by rounds over a padded
        matrix."""
        n = np.array([len(p) for p in pieces])
        width, rows = int(n.max()), np.arange(len(pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < n[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        result, count = np.zeros_like(ids), n.copy()
        who = rows.copy()
        while True:
            best = ranks.argmin(1)  # the leftmost of the least
            least = ranks[rows[:len(who)], best]
            go = least < _NONE
            if not go.all():
                done = ~go
                result[who[done], :ids.shape[1]], count[who[done]] = ids[done], n[done]
                who, ids, ranks, n, best, least = who[go], ids[go], ranks[go], n[go], best[go], least[go]
                if not len(who):
                    break
            here = rows[:len(who)]
            n = n - 1
            wide = int(n.max())
            # close the gap: what stands right of the merged pair moves left
            after = np.arange(1, ids.shape[1] + 1) > best[:, None] + 1
            ids = np.where(after[:, :-1], ids[:, 1:], ids[:, :-1])[:, :wide]
            ids[here, best] = least
            if wide == 1:
                result[who, :1], count[who] = ids, 1
                break
            ranks = np.where(after[:, :wide - 1], ranks[:, 1:wide], ranks[:, :wide - 1])
            row = np.concatenate((here[best > 0], here[best < wide - 1]))
            col = np.concatenate((best[best > 0] - 1, best[best < wide - 1]))
            ranks[row, col] = self.rank_of(ids[row, col], ids[row, col + 1])
        flat = result[np.arange(width) < count[:, None]].tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        return [flat[x:y] for x, y in zip([0] + ends[:-1], ends)]

    def _heap(self, piece: bytes) -> bytes:
        """The same merges, least rank and leftmost first, for a long piece."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        size = len(ids)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        pairs, heap = self.pairs, []
        for k in range(size - 1):
            r = pairs.get((ids[k], ids[k + 1]))
            if r is not None:
                heap.append((r, k, ids[k], ids[k + 1]))
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            z = right[k]
            if ids[k] != a or z >= size or ids[z] != b:
                continue
            ids[k], ids[z] = r, -1
            right[k] = right[z]
            if right[k] < size:
                left[right[k]] = k
            for x, y in ((left[k], k), (k, right[k])):
                if x >= 0 and y < size:
                    new = pairs.get((ids[x], ids[y]))
                    if new is not None:
                        heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (32-bit) of every piece."""
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:  # as the library does: a whole token needs no merging
                out[k] = r.to_bytes(4, "little")
            elif len(p) > WIDEST:
                out[k] = self._heap(p)
            else:
                by.setdefault((len(p) - 1).bit_length(), []).append(k)
        for bits, group in by.items():
            rows = max(1, CELLS >> bits)
            for a in range(0, len(group), rows):
                part = group[a:a + rows]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part])):
                    out[k] = ids
        return out

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every chunk of text."""
        found = [self.find(c) for c in chunks]
        new = list({p for f in found for p in f})
        ids = dict(zip(new, self.pieces([p.encode() for p in new])))
        return [b"".join([ids[p] for p in f]) for f in found]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for group in in_groups(texts):
            yield from _memory_of(self).look_up([split(t) for t in group])

    def decode(self, ids: bytes) -> bytes:
        token = self.bytes
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_LOADED: dict[tuple[str, str], Bpe] = {}
_MEMORIES: dict[int, Memory] = {}


def _memory_of(bpe: Bpe) -> Memory:
    if id(bpe) not in _MEMORIES:
        _MEMORIES[id(bpe)] = Memory(bpe.chunks)
    return _MEMORIES[id(bpe)]


def load(path: str, pattern: str) -> Bpe:
    """The vocabulary, read once a process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (array<int>)."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in bpe.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids and of the bytes that the
    ids decode to.  Ids stay inside the task."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            n, one, two = [], [], []
            for ids in bpe.encode(b.column(1).to_pylist()):
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
