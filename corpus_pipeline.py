"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last return the columns of
documents; the last gives the tokenised digest of every document that is left, once per copy the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, jaccard, langid, mixing, substring
from tidemark.llm._frames import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without words or without a confident language."""
    return langid.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays (five-word shingles, similarity 0.8 or more)."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier; documents of which nothing is left go."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the size and digests of its token ids and of the text decoded from them."""
    return bpe.op8(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("mixing", mix_sources),
    ("tokenize", tokenize),
]

#: SQL can't express the stages (trained models, iterations, tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
