"""Cross-tokenizer alignment against a plain version that uses the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from tokenizers import Tokenizer

from tidewater.llm import alignment, queries

from . import cases
from .test_tokens import ALPHABET, JSON, PIECES, TEXTS


@pytest.fixture(scope="module")
def two():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True  # the contract: their strings are plain text
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
    b_bytes = {k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())}
    return a, b, a_bytes, b_bytes


def tokens(two, text):
    a, b, a_bytes, b_bytes = two
    if not text:
        return [], [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    u, v = [a_bytes[i] for i in x], [b_bytes[i] for i in y]
    return (x, y, u, v) if b"".join(u) == b"".join(v) == (" " + text).encode() else ([], [], [], [])


def groups(x, y, u, v):
    ends = []
    for w in (u, v):
        at, out = 0, []
        for t in w:
            at += len(t)
            out.append(at)
        ends.append(out)
    both = sorted(set(ends[0]) & set(ends[1]))
    lo, out = 0, []
    for hi in both:
        out.append(([i for i, e in zip(x, ends[0]) if lo < e <= hi], [i for i, e in zip(y, ends[1]) if lo < e <= hi]))
        lo = hi
    return out


def brute(two, rows):
    made = [groups(*tokens(two, t)) for _, t in rows]
    links = [Counter((a, b) for g in gs for a in g[0] for b in g[1]) for gs in made]
    count = Counter(p for c in links for p in c)
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for (i, _), gs, c in zip(rows, made, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((i, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(c.values()), sum(n for p, n in c.items() if count[p] == highest[p[0]]),
                    sum(n * count[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if gs else ""))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def odd():
    rng = random.Random(8)
    texts = ["▁x", "a ▁ b", "<s>hi</s><unk>", "<0x41>", "  a   b ", " ", "\n", "a\t b\n  c", "漢字かな交じり文" * 40, "é" * 300, "z" * 700, "x" + " " * 900 + "y", "🙂🙃" * 50, "abc\x00def", "don't we'll I'm",
             "".join(rng.choice("abcdefghij0123456789+/") for _ in range(3_000)), cases.prose(rng, 6_000)]
    return [(k, t, None, None, None) + ("z",) * len(cases.CLASHING) for k, t in enumerate(texts, 1_000)]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_chunks_are_encoded_as_the_whole_text(two, text):
    assert set(ALPHABET)
    chunks = alignment.split(text)
    assert "".join(chunks) == " " + text
    x, y, _, _ = tokens(two, text)
    got = alignment.lanes(alignment.load(JSON, public_tokenizers.PATTERN, PIECES).encode([chunks])[0]) if text else []
    assert [b"".join(v[k] for v in got) for k in (0, 1)] == [b"".join(i.to_bytes(4, "little") for i in ids) for ids in (x, y)]


@pytest.mark.parametrize("lane,size,links,common", [(512, 1 << 19, 1 << 20, 1 << 19), (8, 100, 64, 5), (3, 1, 16, 1)])
def test_any_rows(spark, monkeypatch, two, lane, size, links, common):
    for name, value in (("LANE", lane), ("TOKENS", size), ("LINKS", links), ("COMMON", common)):
        monkeypatch.setattr(alignment, name, value)
    rows = cases.rows() + odd()
    found = alignment.alignment(cases.documents(spark, rows).repartition(3), JSON, public_tokenizers.PATTERN, PIECES)
    assert result(found) == brute(two, [r[:2] for r in rows])


def test_nothing(spark):
    assert alignment.alignment(cases.nothing(spark), JSON, public_tokenizers.PATTERN, PIECES).collect() == []


def test_query_equals_the_plain_version(spark, two):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()]
    assert result(queries.op13_cross_tokenizer_alignment(spark, cases.SF)) == brute(two, rows)
