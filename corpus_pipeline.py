"""From raw documents to token ids: quality, near-duplicates, decontamination, personal data, SentencePiece ids.

Each stage works on all that the stage before it kept. Stages read and return the columns of ``documents``
(doc_id, text, lang, source, n_chars); the last one returns doc_id, n_tokens and ids. ``run`` writes each
stage's result as Parquet in the shared folder and reads it again, so no stage computes another one's twice
and a lost executor costs tasks, not stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm import decontaminate, near_dup, pii, quality, sp_backend
from knotwork.llm.common import Workspace, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("_good").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.without_near_duplicates(docs.select(*COLUMNS), Workspace(spark, "near-dup"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), Workspace(spark, "decontaminate"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars follows the text."""
    masked = pii.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return sp_backend.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids")


#: The last two stages and near-duplicates are beyond SQL; see tests/llm for brute-force versions.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_dup", distinct),
    ("decontaminate", clean),
    ("pii", private),
    ("sentencepiece", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, ws = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
