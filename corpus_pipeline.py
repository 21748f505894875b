"""Cleaning a corpus in stages, each an operator of ``siltlake.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Stages may run one by one over Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltlake.llm import bpe, mixing, nearcopies, quality, toxicity
from siltlake.llm.common import staged, table
from siltlake.llm.queries import vocabulary_path
from siltlake.session import ensure_importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are: a null or empty text fails,
    repeated rows are judged alike, an empty table stays one, other columns of any
    name pass through."""
    return quality.keep_good(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, trained on them and ``labels``, accepts, as they
    are: all, where ``labels`` has not both labels; a null or empty text has the score
    of no features; repeated rows are judged alike."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or
    more): the one with the smallest id, no id last. Texts without words are copies of
    each other; of rows that agree in id and text one stays."""
    return nearcopies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at their sources' repetition rates: none, one or more copies of each
    row; equal ids draw alike, a null source is one of its own, last in order, and
    texts without words keep their source's rate."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's number of ids and the digests of its ids and of their decoding; a null
    or empty text has no ids and decodes to the empty text."""
    return bpe.bpe(docs, vocabulary_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality_rules), ("toxicity", civil), ("near_dedup", deduplicated), ("mixing", mixed), ("bpe", encoded)]

#: SQL cannot express the classifier or the tokenizer; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(ensure_importable(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
