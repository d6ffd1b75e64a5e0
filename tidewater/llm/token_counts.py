"""Token counts of a unigram tokenizer, without making the tokens.

A text is prepared as unigram tokenizers do: blanks become ``MARK``, one is put
in front unless there is one, and a chunk begins at each.  Within a chunk an
Aho-Corasick automaton over the vocabulary enumerates all matches by their
ends, and dynamic programming keeps for each place the best score and the
number of tokens on its path.

Tie rules are the tokenizer's: at a place the best score wins, among equal
scores the match that begins first (the longest).  A character without a piece
of its own is unknown at the least score minus 10; neighbouring unknowns are
one token, or as many as they have bytes if the vocabulary has byte pieces.

Defined cases: a null or empty text has no tokens and score 0; texts of any
length count whole; repeated rows are counted each; an empty table gives no
rows; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memory, in_groups

MARK = "▁"
UNKNOWN_PENALTY = 10.0


class Unigram:
    """A vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0) -> None:
        self.automaton = ahocorasick.Automaton()
        for k, (piece, score) in enumerate(vocabulary):
            if piece and k != unknown:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown_score = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(self, chunk: str) -> tuple[int, float]:
        """(tokens, score) of the best path through one chunk."""
        size = len(chunk)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        if len(self.automaton):
            for at, match in self.automaton.iter(chunk):
                ends[at].append(match)
        best, tokens, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for at in range(size):
            score, n, strange, start = None, 0, False, 0
            single = False
            for length, value in ends[at]:
                single |= length == 1
                begin = at + 1 - length
                total = value + best[begin]
                if score is None or total > score or total == score and begin < start:
                    score, n, start = total, tokens[begin] + 1, begin
            if not single:
                total = self.unknown_score + best[at]
                if score is None or total > score:
                    score, strange = total, True
                    n = tokens[at] + (len(chunk[at].encode()) if self.bytes else not unknown[at])
            best[at + 1], tokens[at + 1], unknown[at + 1] = score, n, strange
        return tokens[size], best[size]

    def many(self, chunks: list[str]) -> list[bytes]:
        return [np.array(self.count(c)).tobytes() for c in chunks]


def chunks(text: str) -> list[str]:
    """The marked chunks of a text."""
    if not text:
        return []
    first, *rest = text.replace(MARK, " ").split(" ")
    return ([MARK + first] if first or not rest else []) + [MARK + r for r in rest]


_LOADED: dict[str, Memory] = {}


def load(path: str) -> Memory:
    """The vocabulary of a sentencepiece model file, read once a process."""
    if path not in _LOADED:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = [(m.id_to_piece(k), m.get_score(k)) for k in range(m.get_piece_size())]
        _LOADED[path] = Memory(Unigram(vocabulary, m.unk_id()).many)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, score (the sum over the chunks)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = load(path)
        for b in batches:
            n, score = [], []
            for group in in_groups(b.column(1).to_pylist()):
                for v in memory.look_up([chunks(t) for t in group]):
                    v = np.frombuffer(v).reshape(-1, 2).sum(0)
                    n.append(int(v[0]))
                    score.append(float(v[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(count, "doc_id long, n_tokens long, score double")
