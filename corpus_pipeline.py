"""Corpus pipeline: quality rules, near duplicates, repeated passages, benchmark items, tokens.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; `run` writes
each stage's result as Parquet in the shared folder and rereads it, so a lost executor costs one stage.
All stages but the last return the columns of `documents` (extra columns pass through).

Defined results: null or blank texts fail the first stage; an empty table stays empty; rows that share
a doc_id share the decisions taken on it; rows with a null doc_id are never dropped as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxgrid.llm import bpe, decontam, neardup, quality, substring
from rxgrid.llm.common import stored, table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality.apply_policy(quality.ledger(docs.withColumn("_row", F.struct(*docs.columns))))
    return judged.filter("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest id."""
    return neardup.dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words of every 20-word window that starts earlier in the corpus; n_chars follows."""
    out = substring.dedup(docs).drop("n_words", "n_removed")
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text that is left."""
    out = bpe.encode(docs, bpe_path())
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("bpe", bpe_tokens),
]

#: SQL has no BPE: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
