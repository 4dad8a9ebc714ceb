"""The corpus pipeline: documents in, encoded mix out.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as
Parquet and read again as the next stage's ``docs``.  All stages take nulls in any
column, empty and very long texts, repeated rows, other columns, and tables without rows (which give none).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from promoloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from promoloom.storage import shared_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of those it is given.

    Null and empty texts have the score of no evidence.  Rows that repeat a key stay if one of them is accepted.  Without
    labels every document stays.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the smallest key; null text equals empty text.

    Rows that repeat a key are told apart by their texts.
    """
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more.

    Texts without words link with nothing and stay; so do rows without a key.
    """
    return near_dedup.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it.

    Texts without words go.  Rows that agree in key, source and size share what the mix takes from them.
    """
    return mixing.repeat_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, repeats included."""
    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES = [
    ("quality", good),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
