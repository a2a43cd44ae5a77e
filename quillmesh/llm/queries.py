"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import language_id, line_dedup, minhash_forest, mixing, quality_rules, rp_forest, site_style_tree, suffix_dedup, toxicity
from quillmesh.llm.bpe import bpe_encode_decode
from quillmesh.llm.common import held_out, table


def tokenizer_spec(path: str | None = None) -> str:
    """JSON text of a tokenizer file, by default the production one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style_tree.extract(table(spark, sf_dir, "pages"))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents")).drop("group", "t")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode_decode(table(spark, sf_dir, "documents"), tokenizer_spec())


def op4_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.classify(documents, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = language_id.predict(documents, language_id.train(documents))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of all sources, which op9's rows carry."""
    sizes = table(spark, sf_dir, "documents").select(mixing.source_key(F.col("source")).alias("key"), "source", mixing.word_count(F.col("text")).alias("size"))
    goal = mixing.targets(sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    return goal.select(F.when(F.col("key") != "n", F.expr("substring(key, 2)")).alias("source"), "source_size", F.round("target", 6).alias("target"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_style_tree": op1_site_style_tree,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_bpe": op3_bpe,
    "op4_rp_forest": op4_rp_forest,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "mixing_targets": mixing_targets,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_forest": minhash_forest.oracle_sql(),
    "op4_rp_forest": rp_forest.oracle_sql(),
    "op6_quality_rules": quality_rules.oracle_sql(),
    "op8_suffix_dedup": suffix_dedup.oracle_sql(),
    "op10_line_dedup": line_dedup.oracle_sql(),
    "mixing_targets": mixing.targets_sql(),
}
