"""Inputs that every operator and stage must bear, and brute-force helpers."""

import random
import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Columns beside those of documents, with names that operators use inside.
CLASHING = ["n_words", "kept", "score", "spans", "p", "ids", "here", "counts", "lines", "windows", "found_hex", "row", "stay"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
                      + [T.StructField(c, T.StringType()) for c in CLASHING])


def prose(rng, n, words=tuple("the of and river stone lamp garden winter paper music quiet field cloud letter bread".split())):
    return " ".join(rng.choice(words) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(n))


def rows():
    rng = random.Random(5)
    a, b = prose(rng, 120), prose(rng, 400)
    edited = b.split(" ")
    edited[200] = "changed"
    texts = [None, "", " \n\t ", "one", "one two three four", "one two three four five", a, a, a.upper(), b, " ".join(edited), prose(rng, 60),
             "la " * 80, "x" * 30_000, prose(rng, 9_000), "naïve café Ünïcode 漢字 🙂 " * 20, "a\x0bb\x0cc\x1cd\x85e", "é", "12345 !!", "AKIA" + "A1" * 10,
             'password = "hunter2hunter2" and api_key:0123456789abcdef0123456789abcdef', "<|endoftext|>"]
    out = [(k, t, "en" if k % 5 else None, None if k % 7 == 0 else f"src{k % 3}") for k, t in enumerate(texts)]
    out += [(None, a, "en", "src0"), (None, None, None, None), (6, a, "en", "src1"), (6, a, "en", "src1"), (9, prose(rng, 70), "de", "src2")]
    return [(i, t, lang, s, None if t is None else len(t)) + ("z",) * len(CLASHING) for i, t, lang, s in out]


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}


def components(ids, linked):
    """Smallest reachable id of each id, by a union-find over all pairs."""
    up = {i: i for i in ids}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in linked:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}
