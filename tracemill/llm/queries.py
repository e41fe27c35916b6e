"""The queries opN_<name> of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, license_rules, line_dedup, merkle, mixing, pii, pivot_search, quality_qda, quality_rules, resampling, simhash, toxicity, url_filter
from tracemill.llm.common import crc_bucket, table


def multi_vocabulary() -> tuple[str, str]:
    """Place of the public rank file, and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows outside fold 1 of 3."""
    labels = table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 3) != 1)
    out = toxicity.score(table(spark, sf_dir, "documents"), labels, least=0.7)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "n_toxic", "spans")


def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels outside fold 0 of 5."""
    return table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0)


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_qda.classify(table(spark, sf_dir, "documents"), training_labels(spark, sf_dir), least=0.3)
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.digests(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *multi_vocabulary())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn towards the benchmark's words."""
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof, and whether a copy of it, partly without newlines, still gives the root."""
    return merkle.checked(table(spark, sf_dir, "documents"), merkle.without_newlines())


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxic_crf, op2_pivot_search, op3_byte_bpe, op4_quality_qda, op5_line_dedup, op6_pii, op7_license_rules, op8_source_mix, op9_quality_rules, op10_simhash, op11_resampling, op12_merkle_manifest, op13_url_filter, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_pivot_search": pivot_search.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op11_resampling": resampling.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
