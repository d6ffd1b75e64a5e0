"""Quality rules with verdicts by host, in DataFrame functions only.

Every document is measured by simple counts.  A document that breaks a rule
counts against its host (the ``source`` column).  Host failure rates are shrunk
by a beta prior whose two parameters are fitted to all hosts by moments, so
that a host of three documents is judged by what hosts are like and a host of
a million by its own record.  A document is kept if it passes the base rule
itself and its host's shrunk rate is below ``host_limit``.

Defined cases: a null text is an empty one; a null host is a host of its own;
repeated rows count once each; an empty table gives no rows (and no prior);
further columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, written

BLANK = "\\x20\\x09-\\x0D"
_BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules that count against a host only: at most this many symbols a hundred
#: words, repeated lines a hundred words, and characters a word.
MAX_SYMBOL_PERCENT = 30
MAX_LINE_PERCENT = 10
MAX_WORD_CHARS = 25
#: Documents of a host whose shrunk failure rate reaches this are rejected.
HOST_LIMIT = 0.6
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame, text: str = "text", names: list[str] | None = None) -> DataFrame:
    """``docs`` and the five counts (longs), under ``names``.

    Repeated windows are found inside the row: the 3-word windows are sorted
    with their positions, so equal ones become neighbours.  That takes
    n log n steps for n words and no shuffle, and compares whole words.
    """
    names = names or fresh(docs, *COUNTS)
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = names
    words, lines, sorted_, pos = fresh(docs.columns + names, "words", "lines", "windows", "positions")
    whole = F.coalesce(F.col(text), F.lit(""))
    body = F.btrim(whole, F.lit(_BLANKS))
    out = docs.withColumns({
        words: F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{BLANK}]+", -1)),
        lines: F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(f"[^{BLANK}]")),
        n_symbols: F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    w = F.col(words)
    m = F.size(w) - 2
    out = out.withColumns({
        n_words: F.size(w).cast("long"),
        word_chars: F.length(F.array_join(w, "")).cast("long"),
        n_dup_lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        sorted_: F.when(m > 1, F.sort_array(F.arrays_zip(
            F.slice(w, 1, m).alias("a"), F.slice(w, 2, m).alias("b"), F.slice(w, 3, m).alias("c"),
            F.sequence(F.lit(0), m - 1).alias("at")))),
    })
    s = F.col(sorted_)

    def same(j: Column) -> Column:
        x, y = s[j], s[j - 1]
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def covered(j: Column) -> Column:
        x, y = s[j]["at"], s[j - 1]["at"]
        return F.array(x, x + 1, x + 2, y, y + 1, y + 2)

    out = out.withColumn(pos, F.filter(F.sequence(F.lit(1), F.size(s) - 1), same))
    repeated = F.size(F.array_distinct(F.flatten(F.transform(pos, covered)))).cast("long")
    out = out.withColumn(n_repeat, F.when(s.isNull() | (F.size(pos) == 0), F.lit(0).cast("long")).otherwise(repeated))
    # a generator of one row, below which no filter on the counts is moved: a
    # filter there would work the windows out anew for each of its terms
    (all_,) = fresh(docs.columns + names, "counts")
    out = out.select(*docs.columns, F.explode(F.array(F.struct(*names))).alias(all_))
    return out.select(*docs.columns, *[F.col(all_)[n].alias(n) for n in names])


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def any_rule_failed(names: list[str]) -> Column:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = (F.col(n) for n in names)
    return (base_failed(n_words, n_repeat) | (100 * n_symbols > MAX_SYMBOL_PERCENT * n_words)
            | (100 * n_dup_lines > MAX_LINE_PERCENT * n_words) | (word_chars > MAX_WORD_CHARS * n_words))


def host_verdicts(counted: DataFrame, names: list[str], host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: host, host_docs, host_failed, host_rate (shrunk),
    host_rejected.

    The prior Beta(m * p, m * (1 - p)) has the mean p of all documents.  Its
    weight m comes from the variance of the hosts' rates beyond what chance
    gives: m = p (1 - p) / extra - 1, at least 1; if there is no such extra, m
    is the number of documents and every host gets close to p.
    """
    hosts = written(counted.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(any_rule_failed(names).cast("long")).alias("host_failed")))
    n, x = F.col("host_docs"), F.col("host_failed")
    total = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.sum(x * x / n).alias("xx"), F.count(F.lit(1)).alias("h"))
    t = total.first()
    docs = t["n"] or 0
    p = (t["x"] / docs) if docs else 0.0
    extra = (t["xx"] / docs - p * p - p * (1 - p) * t["h"] / docs) if docs else 0.0
    weight = float(max(1.0, min(p * (1 - p) / extra - 1, docs))) if extra > 0 else float(max(1, docs))
    rate = (x + F.lit(weight * p)) / (n + F.lit(weight))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") >= host_limit)


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                  host_limit: float = HOST_LIMIT) -> DataFrame:
    """Per row of ``docs``: id, host, the counts, base_failed, host_rate, kept.

    The counts are written once to the shared folder as narrow rows; the host
    table and the result both read them there.  Only host rows are broadcast,
    if few enough, else salted (``common.attach``).
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    counted = written(with_counts(narrow, names=COUNTS).drop("text"))
    hosts = host_verdicts(counted, COUNTS, "host", host_limit)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (attach(counted, hosts.select("host", "host_rate", "host_rejected"), "host", F.col("doc_id"))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
            .select("doc_id", "host", *COUNTS, "base_failed", "kept", "host_rate"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only.

    Every text is measured once: the rows are written with their counts, those
    that the base rules reject without their text, and the hosts judged on them.
    """
    names = fresh(docs, *COUNTS)
    n_words, n_repeat = names[0], names[4]
    (failed,) = fresh(docs.columns + names, "failed")
    counted = with_counts(docs, text, names).withColumn(failed, base_failed(F.col(n_words), F.col(n_repeat)))
    counted = written(counted.withColumn(text, F.when(~F.col(failed), F.col(text))))
    hosts = host_verdicts(counted, names, host, host_limit)
    bad = written(hosts.where("host_rejected").select(F.col("host").alias(host), F.lit(True).alias(fresh(docs, "host_bad")[0])))
    flag = bad.columns[1]
    good = counted.where(~F.col(failed))
    rows = bad.count()
    if rows:
        good = attach(good, bad, host, F.xxhash64(*docs.columns), rows).where(F.col(flag).isNull())
    return good.select(*docs.columns)


ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
windows AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
counts AS (SELECT r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words FROM split LEFT JOIN covered USING (r)),
rules AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words OR 100 * n_dup_lines > {MAX_LINE_PERCENT} * n_words
  OR word_chars > {MAX_WORD_CHARS} * n_words AS other FROM counts),
hosts AS (SELECT source, count(*) AS n, sum(CAST(base_failed OR other AS INT)) AS x FROM rules GROUP BY source),
facts AS (SELECT sum(n) AS docs, sum(x) / sum(n) AS p, sum(x * x / n) / sum(n) AS xx, count(*) AS h FROM hosts),
extra AS (SELECT docs, p, xx - p * p - p * (1 - p) * h / docs AS e FROM facts),
prior AS (SELECT p, CASE WHEN e > 0 THEN greatest(1, least(p * (1 - p) / e - 1, docs)) ELSE greatest(1, docs) END AS m FROM extra),
bad AS (SELECT source, (x + m * p) / (n + m) >= {HOST_LIMIT} AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM rules JOIN bad ON rules.source IS NOT DISTINCT FROM bad.source"""
