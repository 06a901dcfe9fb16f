"""A corpus made ready for training, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gistline.llm import pack, seeds, suffix, toxic, trie
from gistline.llm.common import free, ship, small, stage, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

PASSAGE_WORDS = 50  #: A repeated passage has at least so many words ...
PASSAGE_BYTES = suffix.least_bytes(PASSAGE_WORDS)  #: ... and so at least these bytes.


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    ship(spark)
    model = toxic.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxic.accepted(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group of exact and near copies."""
    ship(spark)
    return trie.one_of_each(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that occur twice; both occurrences go."""
    ship(spark)
    return suffix.without_passages(docs, PASSAGE_BYTES, PASSAGE_WORDS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows without a doc_id cannot be named and stay."""
    ship(spark)
    found = seeds.overlaps(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    name = free(docs, "_id")
    held = stage(found.filter("doc_id is not null").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(small(held, 16), docs.doc_id == F.col(name), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    ship(spark)
    return pack.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic), ("n-gram Jaccard join", without_copies), ("suffix-array dedup", without_passages),
    ("benchmark decontamination", without_benchmark), ("packing", packed)]

#: Learned scores and token ids cannot be had in SQL; the tests hold each stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
