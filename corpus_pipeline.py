"""A corpus pipeline of the training-data operators: each stage's result is written as Parquet and is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontaminate, jaccard_join, mixing, token_output, toxicity
from trackloom.llm.common import Scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.3 or more go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth or more go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn, some repeatedly, until the sources have their target weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards are written and read back."""
    return token_output.encode_documents(spark, docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontaminate", contaminated), ("mixing", mixed), ("token_output", tokens)]

#: Trees, factorization machines and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"{k}-{name}")
    return docs
