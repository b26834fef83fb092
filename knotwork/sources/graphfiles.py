"""Graphs as Parquet files, one folder per graph, with a table of headers beside them.

The counterpart of a canonical binary file: rows lie in canonical order, and the header has the content hash, which is that of
any equal graph. Headers are a table of their own, so listing graphs and imports reads no triple.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import base64_url, graph_id
from ..model import COLUMNS, OWL, conform
from ..operators.aggregates import graph_hash
from ..operators.graphs import reach
from ..operators.patterns import canonical_key


def file_name(ng: Column) -> Column:
    """The UUID of a graph named by one, else the IRI as URL-safe Base64."""
    return F.when(F.lower(ng).startswith("urn:uuid:"), graph_id(ng)).otherwise(base64_url(ng))


def write(t: DataFrame, path: str) -> None:
    """All graphs of ``t``."""
    t = conform(t).select(*COLUMNS, file_name(F.col("ng")).alias("file"))
    t.repartition("file").sortWithinPartitions("file", "s", *canonical_key()).write.mode("error").partitionBy("file").parquet(f"{path}/triples")
    imports = t.where(F.col("p") == f"{OWL}imports").groupBy("ng").agg(F.array_sort(F.collect_set("o")).alias("imports"))
    headers = graph_hash(t).join(t.groupBy("ng").agg(F.count(F.lit(1)).alias("n_triples"), F.first("file").alias("file")), "ng").join(imports, "ng", "left")
    headers.write.mode("error").parquet(f"{path}/headers")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """ng, hash, n_triples, file, imports."""
    return spark.read.parquet(f"{path}/headers")


def read(spark: SparkSession, path: str, *graphs: str) -> DataFrame:
    """The triples of a folder, or of some of its graphs: only their folders are read."""
    t = spark.read.parquet(f"{path}/triples")
    if graphs:
        names = [r[0] for r in spark.createDataFrame([(g,) for g in graphs], "ng string").select(file_name(F.col("ng"))).collect()]
        t = t.where(F.col("file").isin(names))
    return t.select(*COLUMNS)


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Graphs whose triples aren't those that the header's hash states: ng."""
    now = graph_hash(read(spark, path)).withColumnRenamed("hash", "now")
    return headers(spark, path).join(now, "ng", "full_outer").where("not (hash <=> now)").select("ng")


def read_closure(spark: SparkSession, path: str, *graphs: str) -> DataFrame:
    """The triples of some graphs and of all that they import, directly or not. Headers say which; other graphs' rows aren't kept."""
    edges = headers(spark, path).select(F.col("ng").alias("a"), F.explode("imports").alias("b"))
    wanted = reach(edges, spark.createDataFrame([(g,) for g in graphs], "node string"))
    return read(spark, path).join(wanted.select(F.col("node").alias("ng")), "ng", "left_semi").select(*COLUMNS)
