"""A pipeline from raw documents to packed training sequences: quality, toxicity, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattiq.llm import jaccard, packing, quality, toxicity
from lattiq.llm.common import saved, table
from lattiq.llm.queries import pattern, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject; it learns from the labels of the whole corpus."""
    return quality.keep_good(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance does not hold to be toxic."""
    return toxicity.keep_ordinary(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents kept, in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json"), pattern()))


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", one_of_each_group), ("packing", packed)]

#: SQL can express none of the two classifiers, so there is none for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what each keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
