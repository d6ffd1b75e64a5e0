"""The pipeline's stages one by one and as a whole."""

import zlib

import corpus_pipeline as C
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm import secrets
from tidewater.llm.common import documents, written

from . import cases
from .test_native import base, counts
from .test_neardup import brute
from .test_tokens import check_sequences


def test_stages_bear_any_rows(spark):
    for docs in (cases.documents(spark), cases.nothing(spark)):
        for name, stage in C.STAGES:
            out = written(stage(spark, docs, cases.SF))
            assert name == C.STAGES[-1][0] or out.columns == docs.columns
            docs = out
    assert docs.count() == 0


def test_run_equals_brute_force(spark):
    docs = documents(spark, cases.SF)
    one = written(C.quality_stage(spark, docs, cases.SF))
    kept = {r["doc_id"] for r in one.collect()}
    for r in docs.collect():
        n, _, _, _, again = counts(r["text"])
        assert (r["doc_id"] in kept) == (n >= 50 and 100 * again <= 50 * n)  # no host is bad here
    two = written(C.language_stage(spark, one, cases.SF))
    right = [r for r in two.collect()]
    assert len(right) >= 0.98 * len(kept)
    three = written(C.neardup_stage(spark, two, cases.SF))
    want = {i for i, _, c in brute([(r["doc_id"], r["text"]) for r in right]) if i == c}
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(want)
    four = written(C.secret_stage(spark, three, cases.SF))
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in four.collect():
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        if not base(before[r["doc_id"]]):
            assert "[SECRET]" in r["text"] or r["text"] == before[r["doc_id"]]
    got = C.run(spark, cases.SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for r in four.collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids + [2]
        for k, z in enumerate(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)):
            a = max(0, z - 1024)
            pieces.append((r["doc_id"], k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces)
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    assert secrets.MIN_RUN > 0
