"""Corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galvanite.llm import decontam, near_dup, packing, secrets, toxicity
from galvanite.llm.shared import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier marks; it learns from the labelled rows of the whole table."""
    weights = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(docs["text"], weights) < 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages."""
    judged = decontam.judge_documents(docs, table(spark, sf_dir, "benchmark"))
    gone = judged.where("contaminated").select("id0", "h").distinct()
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(decontam.NO_ID)) == gone["id0"]) & (F.xxhash64(docs["text"]) == gone["h"])
    return docs.join(gone, on, "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret becomes a mark; n_chars follows the text."""
    out = docs.withColumn("text", secrets.redact_column(docs["text"]))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack_documents(docs, memo_words=200_000)  # workers still hold what earlier stages remember


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Training, sketches and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
