"""A training corpus from raw documents: language ID, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordtide.llm.common import spill
from wordtide.llm.language_id import keep_identified
from wordtide.llm.mixing import keep_mixed
from wordtide.llm.ngram_join import keep_one_of_each
from wordtide.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language."""
    return keep_identified(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 0.8 of its shingles of five words, links taken together."""
    return keep_one_of_each(docs, n=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that expected tokens meet the target marginals."""
    return keep_mixed(docs, count="bpe", topics="terms")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, each mixed as the corpus is."""
    return pack(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("mixing", mixing), ("packing", packing)]

#: Language models, tokens and hashes can't be written in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spill(docs, f"pipeline-{name}")
    return docs
