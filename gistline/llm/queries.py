"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gistline.llm import forest, licenses, oracle, pack, rans, recount, resample, seeds, shard, sketch, suffix, toxic, trie, warc
from gistline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_rows(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_lookup_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.near_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with the best overlap."""
    return seeds.overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after an edit of each, the second from its tree."""
    return recount.recount(recount.count_trees(recount.own_edits(table(spark, sf_dir, "documents", "doc_id", "text"))))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that speaks of licences, with the wording it has and where it differs."""
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.classify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op11_bitmap_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return forest.trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives that it was written to."""
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's words."""
    return resample.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_hash_tree_shards, op2_rans_ids, op3_suffix_repeats, op4_lookup_sketches, op5_prefix_tree_join, op6_spaced_seeds, op7_edit_counts, op8_pack_sequences, op9_license_scan, op10_conv_toxicity, op11_bitmap_trie, op12_warc_captures, op13_importance_resampling)}

ORACLE: dict[str, str] = oracle.ORACLE
