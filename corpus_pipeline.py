"""The corpus pipeline over ``documents``: five stages, each written as Parquet and
read again as the next one's documents.

1. quality: documents that the classifier rejects go;
2. lines: later occurrences of repeated three-line windows are cut out of the
   texts; a document of which nothing is left goes;
3. near_duplicates: one document of each group of near copies (five-word shingles, a
   similarity of 0.8 or more) stays;
4. decontamination: documents that hold a passage of a test item go;
5. packing: what is left is packed along the curve; the stage returns the pieces.

All but the last return the columns of ``documents``. Null texts pass through as
empty ones; rows that repeat an id stand or fall together where a stage decides by
id, but of rows that repeat id and text near_duplicates keeps one, the one whose
other columns are least. No SQL can express the classifier or the packing, so ``ORACLE_SQL`` is None and
the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common, decontam, line_windows, minhash, packing, quality


def _with_ids(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept (doc_id)``; a null id matches a null id."""
    ids = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(docs, common.table(spark, sf_dir, "labels"))
    return _with_ids(docs, scores.filter("predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_windows.dedup_lines(docs)
    left = cut.filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = _with_ids(docs, minhash.near_duplicates(docs, percent=80).filter("kept"))
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return left
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = left.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *others)).alias("least"))
    return one.select(*[F.col(f"least.{c}").alias(c) if c in others else c for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return _with_ids(docs, found.filter("n_hit = 0"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written into the shared folder and reread."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
