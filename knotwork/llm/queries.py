"""The queries of this subpackage, one per operator, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, histogram_shards, near_dup, perspectives, pii, posting_lists, quality, sp_backend, token_files, warc
from .common import Workspace, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        F.col("_good").cast("int").alias("predicted"),
    )


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every participant's perspective; the mask as text."""
    got = perspectives.perspectives(table(spark, sf_dir, "conversations"))
    return got.withColumn("mask", F.expr("array_join(transform(mask, s -> concat(s[0], ':', s[1])), ',')"))


def op3_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    return posting_lists.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, Workspace(spark, "op3"))


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal bytes."""
    got = histogram_shards.shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 8, Workspace(spark, "op4"))
    return got.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, then read back through the capture index."""
    ws, pages = Workspace(spark, "op5"), table(spark, sf_dir, "pages")
    warc.index(warc.write(pages, ws), ws)
    return warc.fetch(pages.select("url", "page_id"), ws)


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all documents."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op6"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that all documents hold."""
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op7"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    ws = Workspace(spark, "op9")
    manifest = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, ws)
    return token_files.read(spark, ws, manifest)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in SentencePiece ids, with parity and round trip checked."""
    return sp_backend.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_perspectives": op2_perspectives,
        "op3_posting_lists": op3_posting_lists,
        "op4_histogram_shards": op4_histogram_shards,
        "op5_warc": op5_warc,
        "op6_near_dup": op6_near_dup,
        "op7_decontaminate": op7_decontaminate,
        "op8_pii": op8_pii,
        "op9_token_files": op9_token_files,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_perspectives": perspectives.oracle()}
