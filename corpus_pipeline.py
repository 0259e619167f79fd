"""A corpus pipeline of five operators: toxicity, quality, near duplicates, mixing, tokenization.

Each stage works on all that the one before it has kept; `run` writes each stage's result as Parquet into the
cluster's shared folder and reads it again for the next.

Nulls and odd rows: a null text counts as empty in each stage; the mix takes no document without words, so that none is
tokenized; a row with a null id is judged by its text, is no near duplicate and is mixed as the others; repeated rows
are judged alike and one of them stays; ties in the mix are parted by digests; an empty documents table gives an empty
result, and without labels of both classes no document is rejected below, or all are at, the label rate; further
columns pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from xylem.llm import byte_bpe, mixing, ngram_join, quality, toxicity
from xylem.llm.common import materialise

RANKS = "byte_bpe_50k.tiktoken"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id."""
    return ngram_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number and digests."""
    return byte_bpe.with_tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality", remove_low_quality),
    ("near_duplicates", remove_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None  # trained models and sampling by hash: SQL can't state them


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
