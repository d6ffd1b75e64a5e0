"""Secret scan, in DataFrame functions only.

Three patterns find secrets of known form (``BASE``).  What they can't know is
found by two character Markov models, one of random strings and one of ordinary
identifiers: a run of token characters is a secret (kind ``random``) if the
logarithm of the ratio of its likelihoods reaches ``MIN_EVIDENCE``, which is
what it takes to believe in a secret that is one run in ten million.  If the
whole run does not, its stretches that do are secrets, each with the letters
and digits that touch it, so that ordinary words before or after don't outvote
a secret.  Runs end at base spans; what is left beside those is scanned.

Defined cases: a null text is an empty one and has no spans; texts of any
length are scanned whole; repeated rows are scanned each; an empty table gives
no rows (the identifier model then knows only its smoothing); further columns
of any name are carried by ``redacted`` and ignored by ``secret_scan``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, least length of group 2.  The last two patterns have their
#: least length in them: they match maximal runs, so nothing shifts.
BASE = [("assign", ASSIGN, 8), ("access", r"AKIA[A-Z0-9]{12,}", 0), ("hex", r"[0-9a-f]{32,}", 0)]
KINDS = [kind for kind, _, _ in BASE] + ["random"]
#: Any run is scored that is long enough for the evidence (``least_run``).
MIN_RUN = 1
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: the start of a string
MIN_EVIDENCE = 16.0
#: Bounds of the labelled sample: random strings of each spelling, and about
#: so many documents, chosen by a hash, whose words make identifiers.
RANDOM_SAMPLES = 2_000
IDENTIFIER_DOCUMENTS = 100

#: Values whose running sums grow one array; code points of a page of a text.
BLOCK, PAGE = 256, 4096

_SPANS = "array<struct<s:bigint,e:bigint,m:string>>"
_STRETCHES = "array<struct<a:int,b:int>>"
_MARKED = "array<struct<s:bigint,rank:int,e:bigint,kind:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running sums (or maxima) of an array of longs that is not empty.

    Adding to an array copies it; so sums run inside stretches of ``BLOCK``
    values, then over the stretches, which takes BLOCK steps a value at most.
    """
    def grown(xs: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.slice(xs, F.lit(2), F.size(xs)), F.array(of(F.get(xs, F.lit(0)))), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), of(x)))))

    def joined(parts: Column) -> Column:
        ends = grown(parts, lambda part: F.element_at(part, -1))
        first = F.array(F.get(parts, F.lit(0)))
        more = F.zip_with(F.slice(parts, F.lit(2), F.size(parts)), F.slice(ends, F.lit(1), F.size(parts) - 1), lambda part, upto: F.transform(part, lambda x: add(upto, x)))
        return F.flatten(F.concat(first, more))

    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    return _let(F.transform(starts, lambda k: grown(F.slice(values, k * BLOCK + 1, F.lit(BLOCK)), lambda x: x)), joined)


def _places(text: Column, pattern: str, hits: Column) -> Column:
    """The ends of a pattern's matches ``hits`` (one or more), in code points:
    running sums of their lengths and those of the stretches between them."""
    lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda p, h: (F.length(p) + F.length(h)).cast("bigint"))
    return _let(lengths, lambda x: _running(x, lambda y, z: y + z))


def _found(text: Column, pattern: str, least: int = 0) -> Column:
    """Spans (start, end, match) of a pattern's matches, in code points.  Only
    texts with a match come that far."""
    span = lambda end, h: F.struct((end - F.length(h)).alias("s"), end.alias("e"), h.alias("m"))

    def spans(hits: Column) -> Column:
        ends = _places(text, pattern, hits)
        if not least:
            return F.zip_with(ends, hits, span)
        rows = F.arrays_zip(ends.alias("e"), hits.alias("h"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
        return F.transform(F.filter(rows, lambda x: F.length(x["v"]) >= least), lambda x: span(x["e"], x["h"]))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _states(token: Column) -> Column:
    """A token's characters as places in the alphabet, the start before them."""
    chars = F.filter(F.split(token, "", -1), lambda c: c != "")
    return F.concat(F.array(F.lit(0)), F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)))


def labelled_samples(docs: DataFrame, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(token, random boolean), the training sample.

    Random: digests of counters, spelled as lower and upper hex and as base64.
    Ordinary: the words of a hash-chosen part of the documents, alone and
    joined the way names, paths and constants join them; dates, times and
    numbers; ruled lines.
    """
    spark = docs.sparkSession
    n = docs.count()
    body = F.coalesce(F.col(text), F.lit(""))
    some = docs.where(F.pmod(F.xxhash64(F.col(by), body), F.lit(max(1, n))) < IDENTIFIER_DOCUMENTS)
    words = some.select(F.filter(F.split(body, "[^A-Za-z]+", -1), lambda x: F.length(x).between(2, 24)).alias("w"))
    two = words.where(F.size("w") > 1).select(F.explode(F.arrays_zip(
        F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("x"))
    a, b = F.col("x.a"), F.col("x.b")
    some_digits = F.pmod(F.hash(a, b), F.lit(1000)).cast("string")
    spellings = F.array(
        a, F.upper(a), F.concat_ws("_", a, b), F.upper(F.concat_ws("_", a, b)), F.concat_ws("-", a, b),
        F.concat(F.lower(a), F.initcap(b)), F.concat_ws("/", a, b), F.concat(F.lower(a), F.lit("_"), some_digits),
        F.concat(F.lower(a), F.lit("="), F.lower(b)))
    ids = two.select(F.element_at(spellings, F.pmod(F.hash(b, a), F.lit(9)) + 1).alias("token"), F.lit(False).alias("random"))
    at = F.col("id").cast("string")
    lots = spark.range(RANDOM_SAMPLES).select(F.explode(F.array(
        F.sha1(at), F.upper(F.sha1(at)), F.base64(F.unhex(F.sha2(at, 256))))).alias("token"), F.lit(True).alias("random"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") * 11).cast("int"))
    plain = spark.range(RANDOM_SAMPLES).select(F.explode(F.array(
        day.cast("string"), F.date_format(day, "yyyy/MM/dd"), F.concat(F.date_format(day, "yyyyMMdd"), F.lit("000000")),
        (F.col("id") * 1_000_003).cast("string"), *[F.repeat(F.lit(c), F.lit(24)) for c in ALPHABET[62:]])).alias("token"), F.lit(False).alias("random"))
    return lots.unionByName(ids).unionByName(plain)


def likelihood_ratios(samples: DataFrame) -> np.ndarray:
    """log P(b | a; random) - log P(b | a; ordinary) for all pairs of states.

    The pairs are counted by Spark; two tables of ``STATES`` x ``STATES``
    counts come to the driver, however many samples there are.  Half of every
    probability is that of the characters' classes (small letter, capital,
    digit, each symbol), so that words with pairs of letters that the sample
    lacks still look like words.
    """
    pairs = samples.select("random", _states(F.col("token")).alias("s")).select("random", F.explode(F.zip_with(
        F.expr("slice(s, 1, size(s) - 1)"), F.expr("slice(s, 2, size(s) - 1)"), lambda a, b: a * STATES + b)).alias("pair"))
    counts = {k: np.zeros(STATES * STATES) for k in (False, True)}
    for r in pairs.groupBy("random", "pair").count().collect():
        counts[r["random"]][r["pair"]] += r["count"]
    kind = np.array([0] + [1] * 26 + [2] * 26 + [3] * 10 + [4, 5, 6, 7, 8])
    member = np.eye(kind.max() + 1)[kind]
    size = member.sum(0)
    log = {}
    for k, c in counts.items():
        c = c.reshape(STATES, STATES)
        classes = member.T @ c @ member + 0.5
        by_class = (classes / classes.sum(1, keepdims=True) / size)[kind][:, kind]
        total = c.sum(1, keepdims=True)
        seen = np.where(total > 0, c / np.maximum(total, 1), by_class)
        log[k] = np.log(0.5 * seen + 0.5 * by_class)
    return log[True] - log[False]


def least_run(ratios: np.ndarray) -> int:
    """A length (64 at most) below which no string's evidence can reach
    ``MIN_EVIDENCE``: the best sum over strings grows from character to character."""
    best = np.zeros(STATES)
    for n in range(MIN_RUN, 64):
        best = (np.maximum(best, 0)[:, None] + ratios).max(0)
        if best[1:].max() >= MIN_EVIDENCE:
            return n
    return 64


def _ratios(token: Column, table: Column) -> Column:
    """The log-ratio of each of a token's characters after the one before it."""
    s = _states(token)
    return F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.element_at(table, a * STATES + b + 1))


def _gains(token: Column, steps: Column) -> Column:
    """The sum of a token's positive log-ratios in thousandths, each rounded
    up: at least the evidence of any of its stretches.

    One pass over the characters: the state is the sum and, in the last seven
    bits, the place of the character before; ``steps`` is ``gain_steps``.
    """
    def step(acc: Column, c: Column) -> Column:
        before = acc.bitwiseAND(F.lit(127).cast("bigint"))
        return acc - before + F.get(steps, (before * STATES + F.instr(F.lit(ALPHABET), c)).cast("int"))

    return F.shiftright(F.aggregate(F.split(token, "", -1), F.lit(0).cast("bigint"), step), 7)


def gain_steps(ratios: np.ndarray) -> np.ndarray:
    """By the places of two characters: what the second adds to ``_gains``'
    state.  Place 0, the empty piece that ``split`` may leave, changes nothing."""
    steps = np.ceil(np.maximum(ratios, 0) * 1000).astype(np.int64) * 128 + np.arange(STATES)
    steps[:, 0] = np.arange(STATES)
    return steps


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _stretches(token: Column, table: Column) -> Column:
    """The places [a, b) of a token's secrets: all of it or its stretches.

    A stretch starts where the running sum was least and ends where it is most,
    as soon as the sum has fallen from there by ``MIN_EVIDENCE`` or to nothing;
    so every stretch with the evidence meets one that is found.
    """
    out = lambda acc: F.when(acc["most"] >= MIN_EVIDENCE, F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))).otherwise(acc["out"])
    state = lambda at, a, b, now, most, out: F.struct(at.alias("at"), a.alias("a"), b.alias("b"), now.alias("now"), most.alias("most"), out.alias("out"))
    none, zero = F.lit(0.0), F.lit(0)

    def step(acc: Column, x: Column) -> Column:
        at, now = acc["at"] + 1, acc["now"] + x
        return (F.when((now <= 0) | (now <= acc["most"] - MIN_EVIDENCE), state(at, at, at, none, none, out(acc)))
                .when(now > acc["most"], state(at, acc["a"], at, now, now, acc["out"]))
                .otherwise(state(at, acc["a"], acc["b"], now, acc["most"], acc["out"])))

    ratios = _ratios(token, table)
    found = F.aggregate(ratios, state(zero, zero, zero, none, none, F.array().cast(_STRETCHES)), step, out)

    def whole_words(x: Column) -> Column:
        before = F.length(F.regexp_extract(F.substring(token, F.lit(1), x["a"]), "[A-Za-z0-9]*$", 0))
        after = F.length(F.regexp_extract(F.substring(token, x["b"] + 1, F.length(token)), "^[A-Za-z0-9]*", 0))
        return F.struct((x["a"] - before).alias("a"), (x["b"] + after).alias("b"))

    def joined(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] >= x["a"])
        return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))).otherwise(
            F.concat(acc, F.array(x)))

    words = F.aggregate(F.transform(found, whole_words), F.array().cast(_STRETCHES), joined)
    all_of_it = F.array(F.struct(zero.alias("a"), F.length(token).alias("b")))
    return F.when(_sum(ratios) >= MIN_EVIDENCE, all_of_it).otherwise(words)


def _piece(pages: Column, a: Column, b: Column) -> Column:
    """The code points [a, b) of a text cut into pages of ``PAGE``; the page is
    looked up, so the text before it is not walked through."""
    a, b = a.cast("int"), b.cast("int")
    page = lambda at: F.coalesce(F.get(pages, F.floor(at / PAGE).cast("int")), F.lit(""))
    i, j = F.floor(a / PAGE).cast("int"), F.floor(b / PAGE).cast("int")
    across = F.concat(F.substring(page(a), a % PAGE + 1, F.lit(PAGE)), F.array_join(F.slice(pages, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(page(b), F.lit(1), b % PAGE))
    return F.when(i == j, F.substring(page(a), a % PAGE + 1, b - a)).otherwise(across)


def _replaced(body: Column, spans: Column, by: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with ``by(before, start, end)`` for each of the sorted spans;
    ``before`` is the end of what is replaced before it."""
    def joined(pages: Column, spans: Column) -> Column:
        ends = _running(F.transform(spans, lambda x: x["e"].cast("bigint")), lambda a, b: F.greatest(a, b))
        rows = F.arrays_zip(spans.alias("x"), F.concat(F.array(F.lit(0).cast("bigint")), F.slice(ends, F.lit(1), F.size(spans) - 1)).alias("at"))
        parts = F.transform(rows, lambda r: F.concat(_piece(pages, r["at"], F.greatest(r["at"], r["x"]["s"])), by(r["at"], r["x"]["s"], r["x"]["e"])))
        return F.concat(F.array_join(parts, ""), _piece(pages, F.array_max(F.transform(spans, lambda x: x["e"])), F.length(body)))

    pages = F.regexp_extract_all(body, F.lit("(?s).{1,%d}" % PAGE), F.lit(0))
    done = _let(F.struct(pages.alias("p"), spans.alias("s")), lambda x: joined(x["p"], x["s"]))
    return F.when(F.size(spans) > 0, done).otherwise(body)


def _without(body: Column, spans: Column) -> Column:
    """The text with blanks for the spans; places stay."""
    return _replaced(body, F.sort_array(spans), lambda at, s, e: F.repeat(F.lit(" "), F.greatest(e - F.greatest(at, s), F.lit(0)).cast("int")))


def _random(body: Column, likely: Column, pattern: str, table: Column, steps: Column) -> Column:
    """Spans of the secrets in a text's runs; few texts have a ``likely`` one."""
    none = F.array().cast(_STRETCHES)

    def spans(hits: Column) -> Column:
        secret = F.transform(hits, lambda h: F.when(_gains(h, steps) >= int(1000 * MIN_EVIDENCE), _stretches(h, table)).otherwise(none))
        rows = F.arrays_zip(_places(body, pattern, hits).alias("e"), hits.alias("h"), secret.alias("w"))
        return F.flatten(F.transform(F.filter(rows, lambda x: F.size(x["w"]) > 0), lambda x: _let(x["e"] - F.length(x["h"]), lambda at: F.transform(
            x["w"], lambda y: F.struct((at + y["a"]).alias("s"), (at + y["b"]).alias("e"), x["h"].alias("m"))))))

    found = _let(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), spans)
    return F.when(F.size(likely) > 0, found.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def with_spans(docs: DataFrame, ratios: np.ndarray, text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` and an array of all spans (s, rank, e, kind), in order."""
    parts = fresh(docs, *[f"found_{k}" for k in KINDS], "rest", "likely")
    parts, rest, likely = parts[:-2], *parts[-2:]
    body = F.coalesce(F.col(text), F.lit(""))
    table = F.split(F.lit(",".join(f"{v:.6g}" for v in ratios.ravel())), ",", -1).cast("array<double>")
    steps = F.split(F.lit(",".join(map(str, gain_steps(ratios).ravel()))), ",", -1).cast("array<bigint>")
    run = rf"[A-Za-z0-9+/_=-]{{{least_run(ratios)},}}"
    out = docs.withColumns({p: _found(body, pattern, least) for p, (_, pattern, least) in zip(parts, BASE)})
    out = out.withColumn(rest, _without(body, F.concat(*[F.col(p) for p in parts[:-1]])))
    # few runs gain enough for a look at their stretches
    words = F.array_distinct(F.regexp_extract_all(F.col(rest), F.lit(run), F.lit(0)))
    out = out.withColumn(likely, F.filter(
        F.filter(words, lambda x: _gains(x, steps) >= int(1000 * MIN_EVIDENCE)), lambda x: F.size(_stretches(x, table)) > 0))
    out = out.withColumn(parts[-1], _random(F.col(rest), F.col(likely), run, table, steps))

    def marked(spans: Column, k: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("rank"), x["e"].alias("e"), F.lit(KINDS[k]).alias("kind")))

    base = F.concat(*[marked(F.col(p), k) for k, p in enumerate(parts[:-1])])
    random = F.col(parts[-1])
    spans = F.sort_array(F.concat(base, marked(random, len(KINDS) - 1)))
    none = F.lit(True)
    for p in parts:
        none = none & (F.size(p) == 0)
    return out.withColumn(name, F.when(none, F.array().cast(_MARKED)).otherwise(spans.cast(_MARKED))).drop(*parts, rest, likely)


def trained(docs: DataFrame, text: str = "text", by: str = "doc_id") -> np.ndarray:
    return likelihood_ratios(labelled_samples(docs, text, by))


def secret_scan(docs: DataFrame, ratios: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and ``found``, the array of spans."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_spans(rows, ratios, "text", "found").drop("text")


def redacted(docs: DataFrame, ratios: np.ndarray, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span's text replaced; overlapping spans by one mark."""
    (name,) = fresh(docs, "spans")
    marked = with_spans(docs, ratios, text, name)
    mark = lambda at, s, e: F.when(s >= at, F.lit(by)).otherwise("")
    return marked.withColumn(text, _replaced(F.col(text), F.col(name), mark)).select(*docs.columns)
