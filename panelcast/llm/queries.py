"""The registered queries of the subpackage: each applies its operator with
production parameters to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common, conversation_repair, decontam, digest, line_windows, minhash, packing, pattern_packing, periodic_runs, quality, secret_scan, token_counts, token_files, toxicity


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_pairs(common.table(spark, sf_dir, "documents"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source counts as an owner; its texts of one language as a repository."""
    docs = common.table(spark, sf_dir, "documents")
    return secret_scan.digest_columns(secret_scan.scan_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.table(spark, sf_dir, "documents"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.dedup_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "removed")


def op6_minhash_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"), percent=85)


def op7_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    scores = toxicity.toxicity_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), chain)
    return scores.select("doc_id", "p_low_quality", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).alias("toxic"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch_path(spark, "token-files")
    manifest = token_files.write_token_files(common.table(spark, sf_dir, "documents"), folder)
    return token_files.read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_columns(periodic_runs.periodic_runs(common.table(spark, sf_dir, "documents"), plant=True))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(common.table(spark, sf_dir, "conversations"))


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pattern_packing.pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_packing": op1_hilbert_packing,
    "op2_quartile_digest": op2_quartile_digest,
    "op3_secret_ownership": op3_secret_ownership,
    "op4_token_counts": op4_token_counts,
    "op5_line_windows": op5_line_windows,
    "op6_minhash_stars": op6_minhash_stars,
    "op7_benchmark_automaton": op7_benchmark_automaton,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_token_files": op9_token_files,
    "op10_fourier_quality": op10_fourier_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_pattern_packing": op13_pattern_packing,
}
