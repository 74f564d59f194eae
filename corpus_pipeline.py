"""Corpus pipeline: five stages over documents, each written as Parquet before the next reads it.

Null and empty texts pass as their operators define it: they are scored, near copies of each other (one of them stays), have no secret, weigh
nothing in the mix, and have no ids. Very long texts are read whole by all stages; of near copies that tie, and of repeated rows, the
stages keep what their operators say (rows that share an id stay or go together). Tables without rows give tables without rows; columns beyond those of documents pass through
all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagequarry.llm import bpe, mixing, near, quality_mil, secrets
from pagequarry.llm._common import materialised, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"))
    return quality_mil.score(docs, model, out="_score").where(F.col("_score") >= quality_mil.THRESHOLD).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are alike from 0.8: the one with the least id.

    Rows that share an id stay or go together; rows without an id stay, since none can be named in their place.
    """
    found = near.near_duplicates(docs)
    stays = found.where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("_stays")), "left_semi")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked weights of source, language and topic."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as little-endian unsigned 32-bit integers."""
    coded = bpe.encode(docs.select("doc_id", "text"))
    return coded.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing_to_targets),
    ("byte-level BPE encoding", encoding),
]

#: No SQL: trained models and the tokenizer are not expressible; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
