"""The operators as registered queries, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import read_table

from . import alignment, ann, bpe, conv_trie, knn_quality, langid, licenses, neardup, packing, quality_rules, secrets, simhash, token_counts
from .common import documents, remainder


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.secret_scan(docs, secrets.trained(docs))
    is_kind = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != "random")
    return found.select("doc_id", *[is_kind(k).alias(f"n_{k}") for k, _, _ in secrets.BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"), is_kind("random").alias("n_random"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    found = langid.identify(docs, langid.fit(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("host", "host_rate")


def op6_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = knn_quality.fit(docs, read_table(spark, sf_dir, "labels").where(~held))
    return (knn_quality.scored(docs, model).withColumn("held_out", held)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted")))


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir), licenses.known_licenses(spark))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scan, op2_best_fit_packing, op3_language_id, op4_minhash_neardup, op5_quality_rules,
    op6_multi_index_hashing, op7_byte_bpe, op8_knn_quality, op9_license_digests, op10_token_counts,
    op11_simhash_neardup, op12_conversation_trie, op13_cross_tokenizer_alignment)}

ORACLE_SQL: dict[str, str] = {"op4_minhash_neardup": neardup.ORACLE_SQL, "op5_quality_rules": quality_rules.ORACLE_SQL,
                              "op9_license_digests": licenses.ORACLE_SQL}
