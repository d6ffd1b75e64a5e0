"""A training-data pipeline: documents that pass the quality rules and have a
language, one of each group of near copies, without secrets, packed into
sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written to the shared folder and read again as the next stage's ``docs``.  All
stages but the last return the columns of ``docs``.

Defined cases, for every stage: texts of any length are read whole; rows that
repeat a doc_id are judged each by their own text, but near-dedup, which makes
one document of them; a null doc_id is no reason to drop a row; columns beside
those of ``documents``, whatever their names, are carried on (by packing:
ignored); an empty table gives no rows.  Null and empty texts: see the stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import langid, neardup, packing, quality_rules, secrets
from tidewater.llm.common import documents, fresh, remainder, small_batches, written

#: Documents whose best language is less likely than this have none.
LEAST_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the base rules or come from a rejected host go.

    A null or empty text has no words and goes; a null source is a host of its own.
    """
    small_batches(spark)
    return quality_rules.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or a likely language go.

    A null or empty text has no letter and goes; rows without lang only don't
    teach the model (no rows with one: all go); of languages that are equally
    likely the first in order is taken.
    """
    small_batches(spark)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held))
    (p,) = fresh(docs, "p")
    found = docs.withColumn(p, langid.predictions(model, F.col("text")))
    likely = (F.col(p)["lang_pred"] != langid.UNKNOWN) & (F.col(p)["score"] >= LEAST_LANGUAGE_SCORE)
    return found.where(likely).select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest id.

    A null or blank text is near nothing and stays, as does a row without an id;
    of rows that repeat an id the one with the smallest text stays.
    """
    small_batches(spark)
    return neardup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; a mark replaces every secret, and n_chars follows.

    A null text stays null; spans that overlap get one mark.
    """
    small_batches(spark)
    out = secrets.redacted(docs, secrets.trained(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null or empty text is one piece, the closing id; equal pieces are packed
    each.
    """
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("MinHash near-dedup", neardup_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: Models and hashing can't be put in SQL; the tests use brute force.
ORACLE_SQL = None
