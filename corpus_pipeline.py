"""The corpus pipeline: five stages from documents to encoded training data.

Every stage is written as Parquet in the shared folder and read again as the next one's input;
then the intermediate tables and shuffle files that made it go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from layerlens.llm import line_dedup, minhash, mixing, quality
from layerlens.llm.common import table
from layerlens.llm.queries import token_digests
from layerlens.session import dropped, noted_folders, shuffles_removed, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality.filter_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, and their new lengths."""
    out, name = line_dedup.dedup_lines(docs)
    return out.drop(name).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return minhash.filter_documents(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.copied(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's token ids and of the bytes they decode to."""
    return token_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Estimation, similarity and encoding are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with noted_folders() as made, shuffles_removed(spark):
            rows = stage(spark, docs, sf_dir)
            between = list(made)
            docs = written(rows, f"stage-{name}")
        dropped(spark, *between)
    return docs
