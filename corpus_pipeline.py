"""The corpus pipeline: five stages over ``documents``, each of them one operator of the llm package.

Cases, for all stages: rows with null, shared or repeated doc_ids are rows of their own; null and empty texts pass the
first four stages and are a piece of the end id alone in the last; texts of any length are read whole; columns other than
doc_id and text pass the first four stages unread, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prefscale.llm import common, decontaminate, ngram_join, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is learned from the documents it gets and the labels.
    Null, empty and other texts without evidence stay, and all do where labels are missing or of one kind."""
    model = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five words, similarity 0.8) the document of the smallest id stays, and one
    with an id before one without. Repeated rows are duplicates; rows without words are like nothing and all stay."""
    return ngram_join.first_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which benchmark windows cover a twentieth of the words or more. Null texts have no words
    and stay; an empty benchmark drops nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every row stays, and a null text stays null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences; ties are placed in order of (doc_id, piece, crc)."""
    return packing.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each),
    ("decontaminate", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]

#: Stages 1 and 5 can't be put into SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
