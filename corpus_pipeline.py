"""A training corpus from `documents`: language, near-duplicates, decontamination, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from condensa.llm import decontaminate, language_id, minhash_dedup, mixing, token_codes
from condensa.llm.common import staged
from condensa.llm.queries import table, vocabulary


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on their own labelled rows, accepts.

    Null and letterless texts go; repeated rows stay or go alike; null ids and extra columns come along. Without labelled rows
    nothing can be accepted; an empty table stays empty.
    """
    return language_id.accepted(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of near-duplicates.

    Rows without an id, and null or empty texts, link with nothing and stay; of repeated rows one stays; extra columns come
    along; an empty table stays empty.
    """
    return minhash_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark.

    Rows go by their own text, whatever their id; null and empty texts overlap nothing and stay; extra columns come along;
    an empty table, or one without a benchmark, stays as it is.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights, each as often as it is taken.

    Rows without words are taken never; a null source is one of the sources; repeated rows are mixed each; an empty table stays
    empty.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' own account of every document: doc_id, start, n_tokens, ids_crc32.

    A null text is an empty one; repeated rows and null ids are written each; an empty table gives an empty one.
    """
    return token_codes.encode_table(docs, vocabulary())


STAGES = [
    ("language_id", languages),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_codes", tokens),
]

#: Trained models, signatures and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
