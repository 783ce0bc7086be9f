"""Corpus preparation: quality, repeated lines, near copies, test-set leaks, packing.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns the
documents that stay, with the columns of `docs`; the last returns the packed pieces.

  quality     documents that the line-level field scores below 0.5 go
  lines       repeated lines go; a document of which no line is left goes, unless it had none
  near_copies of each class of near copies the document with the smallest id stays
  leaks       documents with a test-set window of ten words go
  packing     what is left becomes sequences of at most 2048 tokens
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import decontamination, jaccard_join, line_dedup, packing, quality_crf
from patronlens.llm.common import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels are joined by id from the `labels` table; the score itself sees texts only."""
    labels = quality_crf.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    field = quality_crf.fit(docs, labels)
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    scored = quality_crf.score(docs.select(*columns, F.col("text").alias("_t")), field, [f"_c{i}" for i in range(len(columns))], "_t")
    return scored.where("score >= 0.5").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    emptied = (out["n_removed"] > 0) & (F.trim(F.regexp_replace(out["text"], r"\s+", " ")) == "")
    kept = out.where(~emptied).toDF(*[f"_c{i}" for i in range(len(out.columns))])
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat id and text are one document and leave one row."""
    return jaccard_join.representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, ["doc_id"])


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("packing", pack)]

#: The field is fitted numerically and packing follows the tasks, so SQL cannot give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of the folder, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}-{uuid.uuid4().hex[:8]}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
