"""Packing, byte-level BPE and token counts against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from tidewater.llm import bpe, chunks, packing, queries, token_counts

from . import cases

JSON, RANKS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
ALPHABET = " \n\t\r\x0b\x0c\x1c\x85\xa0 'sStreaddlmve019..,,!éßñ漢字🙂́​A<|>▁"
TEXTS = st.text(alphabet=ALPHABET, max_size=80) | st.text(max_size=60)


@pytest.fixture(scope="module")
def hf():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe_round_trip_equals_the_library(tik, text):
    vocabulary = bpe.load(RANKS, public_tokenizers.PATTERN)
    ids = next(vocabulary.encode([text]))
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
    assert vocabulary.decode(ids) == text.encode()


def test_long_pieces_and_narrow_matrices(tik, monkeypatch):
    vocabulary = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdehtn") for _ in range(n)) for n in (255, 256, 257, 900, 5000)] + ["ha" * 400, " " * 999 + "x", "é" * 300]
    for widest, cells in ((256, 1 << 16), (2, 64), (10_000, 64)):
        monkeypatch.setattr(bpe, "WIDEST", widest)
        monkeypatch.setattr(bpe, "CELLS", cells)
        got = [np.frombuffer(vocabulary.chunks([t])[0], "<u4").tolist() for t in texts]
        assert got == [tik.encode_ordinary(t) for t in texts]


@given(TEXTS)
def test_chunks_join_to_the_text(text):
    parts = chunks.split(text)
    assert "".join(parts) == text and all(parts)


def test_memory_forgets_and_still_answers():
    m = chunks.Memory(lambda cs: [c.upper().encode() for c in cs], entries=3)
    for k in range(50):
        texts = [[f"a{k}", "b", "c" * 100], [], [f"a{k % 7}"]]
        assert m.look_up(texts) == ["".join(t).upper().encode() for t in texts]
        assert len(m.young) + len(m.old) < 20


def test_bpe_query(spark, tik):
    docs = cases.documents(spark)
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    want = set()
    for r in cases.rows():
        ids = tik.encode_ordinary(r[1] or "")
        want.add((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == want
    ids = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert all(len(r["ids"]) == r["n_tokens"] for r in ids) and len(ids) == len(cases.rows())
    assert bpe.digests(cases.nothing(spark), RANKS, public_tokenizers.PATTERN).collect() == []


def test_packed_documents(spark, hf):
    got = packing.pack_documents(cases.documents(spark), JSON, public_tokenizers.PATTERN).collect()
    want = []
    for r in cases.rows():
        ids = hf.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        for k, z in enumerate(range(first, len(ids) + 1, 1024)):
            a = max(0, z - 1024)
            want.append((r[0], k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    assert packing.pack_documents(cases.nothing(spark), JSON, public_tokenizers.PATTERN).collect() == []


def check_sequences(placed, context=1024):
    by = {}
    for s, at, n in placed:
        by.setdefault(s, []).append((at, n))
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= context
    return len(by)


def test_packing_query(spark):
    got = queries.op2_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    n = check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    assert n <= 1.01 * sum(r["length"] for r in got) / 1024 + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=300))
def test_plan_places_every_piece_once(lengths):
    context = 40
    histogram = np.bincount(lengths, minlength=context + 1) if lengths else np.zeros(context + 1, int)
    placed, seen = [], set()
    for n, lo, hi, sequence, offset in packing.plan(histogram, context):
        for k in range(lo, hi):
            seen.add((n, k))
            placed.append((sequence + k - lo, offset, n))
    assert seen == {(n, k) for n in range(context + 1) for k in range(histogram[n])} and len(placed) == len(lengths)
    # no worse than first fit of the lengths, longest first, by more than a twentieth
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = next((k for k, r in enumerate(rooms) if r >= n), None)
        if at is None:
            rooms.append(context - n)
        else:
            rooms[at] -= n
    assert check_sequences(placed, context) <= 1.05 * len(rooms) + 1


def test_patterns_fill_the_context():
    kinds = packing.patterns(12, np.arange(1, 13))
    assert {tuple(sorted(int(n) for n in k if n)) for k in kinds} == {t for t in [(12,)] + [(a, 12 - a) for a in range(1, 7)] + [
        (a, b, 12 - a - b) for a in range(1, 13) for b in range(a, 13) if b <= 12 - a - b]}
    assert len(kinds) == len({tuple(sorted(k)) for k in kinds.tolist()})


@pytest.fixture(scope="module")
def pieces():
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [(m.id_to_piece(k), m.get_score(k)) for k in range(m.get_piece_size())]


def library(vocabulary, fallback):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


@pytest.fixture(scope="module")
def unigram(pieces):
    return library(pieces, True)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(unigram, text):
    memory = token_counts.load(PIECES)
    n, score = np.frombuffer(memory.look_up([token_counts.chunks(text)])[0]).reshape(-1, 2).sum(0)
    assert n == len(unigram.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab cz", max_size=30))
def test_ties_and_unknowns(text):
    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("aba", -3.5), ("▁a", -2.0), ("ba", -2.5), ("bb", -3.0)]
    u = token_counts.Unigram(vocabulary)
    assert sum(u.count(c)[0] for c in token_counts.chunks(text)) == len(library(vocabulary, False).encode(text).ids)


def test_count_query(spark, unigram):
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(cases.documents(spark), PIECES).collect()), key=repr)
    assert got == sorted(((r[0], len(unigram.encode(r[1] or "", add_special_tokens=False).ids)) for r in cases.rows()), key=repr)
    assert token_counts.token_counts(cases.nothing(spark), PIECES).collect() == []


def test_added_tokens_as_in_the_library(spark, hf):
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x" * 3_000 + "<|endoftext|>" + " y" * 1_500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pieces(docs, JSON, public_tokenizers.PATTERN).collect())
    want = []
    for i, t in enumerate(texts):
        ids = hf.encode(t, add_special_tokens=False).ids + [2]
        for k, z in enumerate(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)):
            a = max(0, z - 1024)
            want.append((i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    assert got == sorted(want) and hf.encode(texts[0], add_special_tokens=False).ids == [5303, 220, 50256, 612]
