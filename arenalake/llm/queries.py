"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arenalake.llm import mixing, oracle, packing, periodic, pstable, quality, secrets, simhash, substrings, topk, toxicity, trie_tokens, vantage, whitening
from arenalake.llm.common import table

#: A public vocabulary of 32,000 pieces.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_tokens", *[f"p_{d}" for d in mixing.TARGETS], "rate", "on_target")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.embedding_components(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_tokens.token_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).select(*cols)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"), plant=True).drop("collapsed")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix_domains, op2_substring_dedup, op3_toxicity, op4_quality, op5_best_fit_packing,
        op6_embedding_dedup, op7_token_counts, op8_exact_top_k, op9_secret_scan, op10_simhash_dedup,
        op11_vantage_search, op12_periodic_runs, op13_whitening,
    )
}
#: The others are beyond SQL (hashes, models, packing); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": oracle.SUBSTRINGS, "op8_exact_top_k": oracle.TOP_K, "op9_secret_scan": oracle.SECRETS}
