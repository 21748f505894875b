"""The registered queries of this subpackage: each applies an operator, with
production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, mixing, quality, sharding, simhash, tokenfile, topk, toxicity, urlfilter
from .common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_path())
    return tokenfile.read_tokens(spark, path)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents"), vocabulary_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_verdicts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_cover_tree_topk": cover_tree_topk,
    "op2_token_files": token_files,
    "op3_quality_rules": quality_rules,
    "op4_mixed_sources": mixed_sources,
    "op5_jump_shards": jump_shards,
    "op6_simhash_groups": simhash_groups,
    "op7_toxicity_scores": toxicity_scores,
    "op8_bpe_chunks": bpe_chunks,
    "op9_language_filters": language_filters,
    "op10_url_rules": url_rules,
}
