"""Near-duplicate documents by one-permutation MinHash.

1. Every text gives its set of 5-word shingles as 64-bit hashes, and from the
   set a signature: the hash space is cut into ``BANDS * ROWS`` bins, the
   smallest hash of each bin is kept, and an empty bin copies the bin that a
   fixed random probe sequence of its own finds first (optimal densification).
   ``ROWS`` bins make a band's key.
2. Documents with equal sets form a class; its smallest id stands for it.
3. Classes with an equal key share a bucket.  Each bucket gives a star: links
   from its smallest id to the others, so pairs grow with the rows.  The pairs
   are confirmed on whole sets, and components are made of the links.
4. A star can miss a link between two of its points.  So buckets that still
   hold several components are finished exactly: small ones (up to ``SMALL``)
   by their pairs across components, large ones in blocks: the classes are dealt
   over parts of about ``BLOCK`` shingles, every two parts are compared inside a
   task over an index of one's shingles, which returns a spanning forest of the
   links it finds.  A set is copied once for each part, so a bucket of m
   dissimilar sets of n shingles moves m * n / BLOCK copies of each; the
   comparing takes the square.  Nothing is capped.

A pair at the least similarity shares no bucket with probability
(1 - 0.85 ** 4) ** 24 = 2e-8.

Defined cases: a null or blank text has an empty set and is linked to nothing;
fewer than five words are one shingle; rows that repeat a doc_id are one
document, whatever their texts (they join their texts' groups); a null doc_id
is never linked, has a null component and is kept; an empty table gives no
rows; further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, looked_up, maybe_among, written
from .components import components
from .wordhash import mix, shingle_sets

BANDS, ROWS = 24, 4
LEAST_PERCENT = 85
SMALL = 16
#: Shingles of the classes that one task compares with as many others.
BLOCK = 1 << 21
#: Members of a star that one task compares with its centre at a time.
STAR = 256
SPREAD = 32
#: Shingles of sets handed over at a time.
HELD = 1 << 18

_U = np.uint64
_BINS = BANDS * ROWS
_EDGES = (np.arange(_BINS, dtype=np.float64) * (2.0 ** 64 / _BINS)).astype(_U)
_MULT = mix(np.arange(2_000, 2_000 + ROWS)) | _U(1)
_TURNS = 1 << 12
_PROBES = (mix(np.arange(_BINS * _TURNS)) % _U(_BINS)).astype(np.int16).reshape(_TURNS, _BINS)


def signature(s: np.ndarray) -> np.ndarray:
    """The densified signature of a sorted set with one member or more."""
    at = np.searchsorted(s, _EDGES)
    full = at < np.append(at[1:], len(s))
    out = np.where(full, s[np.minimum(at, len(s) - 1)], _U(0))
    empty, turn = np.flatnonzero(~full), 0
    while len(empty):
        probe = _PROBES[turn][empty] if turn < _TURNS else (empty + turn) % _BINS
        hit = full[probe]
        out[empty[hit]] = out[probe[hit]]
        empty, turn = empty[~hit], turn + 1
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    keys = (signature(s).reshape(BANDS, ROWS) * _MULT).sum(1, dtype=_U)
    return mix(mix(keys) + np.arange(BANDS, dtype=_U))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, _U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


_SIGNED = "doc_id long, n long, d1 long, d2 long, keys array<long>"


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, d1, d2, keys): set size, 128-bit digest of the set, and a
    key for each band (none for an empty set)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d, keys = [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                d.append((mix(s).sum(dtype=_U), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)))
                keys.append(band_keys(s) if len(s) else s)
            d = np.array(d, _U).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), _lists(keys)], ["doc_id", "n", "d1", "d2", "keys"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(sign, _SIGNED)


def _sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, hashes) of every row; a row repeated within a task counts once."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            doc, found, size = [], [], 0
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1))):
                mark = (i, len(s), int(mix(s).sum(dtype=_U)))
                if len(s) and mark not in seen:
                    seen.add(mark)
                    doc.append(i)
                    found.append(s)
                    size += len(s)
                if size >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), _lists(found)], ["doc", "hashes"])
                    doc, found, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), _lists(found)], ["doc", "hashes"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(sets, "doc long, hashes array<long>")


def _rows(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    col = batch.column(name)
    at, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False).view(_U)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < LEAST_PERCENT * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= LEAST_PERCENT * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    Rows are dealt by ``a`` and a salt, one for every ``STAR`` partners of a,
    and sorted so that a's set comes first; a task holds that set and reads its
    partners as they stream by.
    """
    pairs = written(pairs.distinct().withColumn("at", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int")))
    # only centres with many partners need salts; their counts are repeated for
    # each of SPREAD hashes, so that no centre's pairs meet in one task here
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts")).where("parts > 1")
    parts = parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salt = F.pmod(F.xxhash64("b", F.lit(1)), F.coalesce("parts", F.lit(1)))
    dealt = pairs.join(parts, ["a", "at"], "left").select("a", salt.alias("salt"), F.col("b").alias("doc"), F.lit(1).alias("side"))
    centres = dealt.select("a", "salt", F.col("a").alias("doc"), F.lit(0).alias("side")).distinct()
    rows = dealt.unionByName(centres).join(sets, "doc").repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, whose = [], None  # more than one only if rows repeat a's id
        for b in batches:
            one, two = [], []
            for a, doc, side, s in zip(b.column("a").to_pylist(), b.column("doc").to_pylist(), b.column("side").to_pylist(), _rows(b, "hashes")):
                if not side:
                    centres, whose = (centres if whose == a else []) + [s.copy()], a
                elif any(_linked(c, s) for c in centres):
                    one.append(a)
                    two.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])

    return rows.select("a", "doc", "side", "hashes").mapInArrow(compare, "a long, b long")


def _forest(keep: list[tuple[int, int]]) -> list[tuple[int, int]]:
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    out = []
    for a, b in keep:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _block_links(block: list[tuple[int, int, int, np.ndarray]], same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two sides of a block (within
    it, if ``same``); members are (side, doc, comp, set)."""
    left = [m for m in block if m[0] == 0]
    right = left if same else [m for m in block if m[0] == 1]
    if not left or not right:
        return []
    words, where = np.unique(np.concatenate([m[3] for m in left]), return_inverse=True)
    rows = np.repeat(np.arange(len(left)), [len(m[3]) for m in left])
    order = np.argsort(where, kind="stable")
    holders, begin = rows[order], np.searchsorted(where[order], np.arange(len(words) + 1))
    size = np.array([len(m[3]) for m in left])
    comp = np.array([m[2] for m in left])
    links = []
    for k, (_, doc, own, s) in enumerate(right):
        at = np.searchsorted(words, s)
        at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == s)]
        n = begin[at + 1] - begin[at]
        if not n.sum():
            continue
        idx = np.repeat(begin[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(holders[idx], minlength=len(left))
        good = (100 * both >= LEAST_PERCENT * (size + len(s) - both)) & (comp != own)
        if same:
            good[k:] = False
        links += [(left[j][1], doc) for j in np.flatnonzero(good)]
    return _forest(links)


def _large(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components in large buckets (key, doc, comp, shingles)."""
    chunks = F.ceil(F.col("shingles") / BLOCK).cast("int")
    dealt = buckets.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", "doc", "comp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                         (F.col("chunk") > F.col("other")).cast("int").alias("side"))
    rows = dealt.join(sets, "doc").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, int, np.ndarray]] = []
        now = None

        def links() -> pa.RecordBatch:
            found = _block_links(block, now[1] == now[2]) if now else []
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "i", "j", "side", "doc", "comp")]
            for key, i, j, side, doc, comp, s in zip(*cols, _rows(b, "hashes")):
                if (key, i, j) != now:
                    yield links()
                    block, now = [], (key, i, j)
                block.append((side, doc, comp, s.copy()))
        yield links()

    return rows.select("key", "i", "j", "side", "doc", "comp", "hashes").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, class_id
    (the smallest doc_id with the same set)."""
    all_ = written(signed(docs, doc_id, text))
    whole = all_.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    digest = ["n", "d1", "d2"]
    classes = written(whole.groupBy(*digest).agg(F.min("doc_id").alias("doc"), F.first("keys").alias("keys")))

    # stars: each bucket's smallest id with all others
    keyed = classes.select("doc", "n", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("hub"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    members = written(looked_up(keyed, hubs, ["key"], F.col("doc"), "inner").select("key", "doc", "n", "members", "shingles", "hub"))
    wanted = written(members.select(F.col("doc").alias("_wanted")).distinct())
    texts = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    # few texts are candidates; the filter keeps most others out of the shuffle
    texts = texts.where(maybe_among(wanted)(F.col("_doc"))).join(wanted, F.col("_doc") == F.col("_wanted"), "left_semi")
    sets = written(_sets(texts, "_doc", "_text"))
    near = f"100 * least(x.n, y.n) >= {LEAST_PERCENT} * greatest(x.n, y.n)"
    stars = members.select(F.col("hub").alias("x"), F.struct("doc", "n").alias("y")).where("x.doc <> y.doc").where(near)
    comp = written(components(confirmed(stars.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")), sets)))

    # the rest: buckets that still hold more than one component
    labelled = members.join(comp, members["doc"] == comp["node"], "left").select("key", "doc", "n", "members", "shingles", F.coalesce("comp", "doc").alias("comp"))
    labelled = written(labelled)
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = written(looked_up(labelled, mixed, ["key"], F.col("doc"), "inner"))
    few = rest.where(F.col("members") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("doc", "n", "comp")).alias("m"))
    few = few.select(F.explode(F.expr(
        f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> x.comp <> y.comp and {near}), "
        "y -> struct(least(x.doc, y.doc) as a, greatest(x.doc, y.doc) as b))))")).alias("p")).select("p.a", "p.b")
    more = confirmed(few, sets).unionByName(_large(rest.where(F.col("members") > SMALL), sets))

    # documents that repeat an id tie their classes; links between components
    # found above tie those
    ids = whole.select("doc_id", *digest).join(classes.select(*digest, "doc"), digest)
    twice = ids.groupBy("doc_id").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("doc_id")
    twice = ids.join(twice, "doc_id").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    ties = more.unionByName(twice)
    for end in ("a", "b"):
        ties = ties.join(comp.select(F.col("node").alias("_n"), F.col("comp").alias("_c")), F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c")
    final = components(ties)
    final = comp.join(final.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "full").select(
        F.coalesce("node", "comp").alias("node"), F.coalesce("up", "comp").alias("comp"))

    named = classes.join(final, classes["doc"] == final["node"], "left").select(*digest, F.col("doc").alias("class_id"), F.coalesce("comp", "doc").alias("component_id"))
    full = whole.select("doc_id", *digest).join(named, digest).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    empty = all_.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return (full.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
            .select("doc_id", "n_shingles", "component_id", "kept", "class_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document stands for its group, one row per
    document (the one with the smallest text, if rows repeat its id)."""
    found = near_duplicates(docs, doc_id, text)
    stay, last, keep = fresh(docs, "stay", "last", "keep")
    ids = written(found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(stay)).agg(
        F.max("kept").alias(keep), F.count(F.lit(1)).alias(last)).where(~F.col(keep) | (F.col(last) > 1)))
    # ids that go or repeat need a join; a row that is surely neither stays
    # where it is, so that few texts are shuffled
    special = maybe_among(ids.select(stay))
    rest = docs.where(~special(F.col(doc_id)))
    here = docs.where(special(F.col(doc_id)))
    here = here.join(ids, here[doc_id].cast("long") == ids[stay], "left").where(F.coalesce(keep, F.lit(True)))
    once = here.where(F.col(last).isNull())
    many = here.where(F.col(last) > 1)
    (row,) = fresh(docs, "row")
    many = many.groupBy(stay).agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text), F.lit(""))).alias(row)).select(f"{row}.*")
    return rest.unionByName(once.select(*docs.columns)).unionByName(many.select(*docs.columns))


ORACLE_SQL = f"""
WITH RECURSIVE split AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'),
  lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 2)) END) AS i FROM split)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS m FROM grams GROUP BY doc_id),
classes AS (SELECT m, any_value(n) AS n, min(doc_id) AS class_id FROM sizes GROUP BY m),
own AS (SELECT g, class_id, n FROM grams JOIN classes ON grams.doc_id = classes.class_id),
pairs AS (SELECT a.class_id AS a, b.class_id AS b FROM own a JOIN own b ON a.g = b.g AND a.class_id < b.class_id
    AND 100 * least(a.n, b.n) >= {LEAST_PERCENT} * greatest(a.n, b.n)
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= {LEAST_PERCENT} * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id,
  coalesce(component_id, s.doc_id) = s.doc_id AS kept, coalesce(c.class_id, s.doc_id) AS class_id
FROM split s LEFT JOIN sizes z USING (doc_id) LEFT JOIN classes c USING (m) LEFT JOIN comp USING (class_id)"""
