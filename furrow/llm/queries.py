"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import (burst_trie, byte_bpe, byte_cnn, column_bwt, license_rules, mixing, order_minhash,
                        setsketch, suffix_trees, token_links, warc, weak_rules, word_bpe)
from furrow.sources.stages import stage

BPE_FILE = "word_bpe_49k.json"
RANKS_FILE = "byte_bpe_50k.tiktoken"
ALIGNED_FILES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path(file: str = BPE_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = stage(warc.write_archives(pages), "warc")
    return warc.page_records(warc.read_archives(archives))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(_documents(spark, sf_dir))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_neighbours(_documents(spark, sf_dir))


def op4_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = column_bwt.remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed",
                        F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_trees.remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.predict_held_out(_documents(spark, sf_dir))


def op7_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.report(weak_rules.judge(_documents(spark, sf_dir)))


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return word_bpe.digests(word_bpe.decode(word_bpe.encode(_documents(spark, sf_dir), path), path))


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_documents(spark, sf_dir))


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_documents(spark, sf_dir))


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = map(vocabulary_path, ALIGNED_FILES)
    return token_links.digests(token_links.align(_documents(spark, sf_dir), a, b))


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = vocabulary_path(RANKS_FILE), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(_documents(spark, sf_dir), path, pattern)
    return byte_bpe.digests(byte_bpe.decode(encoded, path, pattern))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (op1_warc, op2_license_rules, op3_order_minhash, op4_column_bwt, op5_suffix_trees,
                  op6_byte_cnn, op7_weak_rules, op8_word_bpe, op9_pfair_mixing, op10_setsketch,
                  op11_token_links, op12_burst_trie, op13_byte_bpe)
}

ORACLES: dict[str, str] = {"op2_license_rules": license_rules.oracle()}
