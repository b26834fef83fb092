"""Orders of nodes, literals and rows, as sort keys and as ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import order_bytes
from ..model import TYPE, XSD
from .graphs import checkpointed
from .patterns import nodes


def ranked(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``keys``, which should tell all rows apart.

    Rows are sorted by ranges; only the ranges' sizes are added up. No task sees more than its range."""
    parts = checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row per partition
    base = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return parts.join(F.broadcast(base), "_part").select(*df.columns, (F.col("_base") + F.col("_at") - F.col("_first")).alias(name))


def literal_key(o: Column, dtype: Column) -> list[Column]:
    """The canonical order of literals: datatype, then raw bytes; whole numbers by their big-endian bytes, so negatives come last."""
    whole = dtype.isin(*(XSD + k for k in ("integer", "long", "int", "short", "byte")))
    return [F.coalesce(dtype, F.lit("")), F.when(whole, order_bytes(o.try_cast("bigint"))), F.hex(o.cast("binary"))]


def node_key(node: Column) -> list[Column]:
    """The order of predicates and nodes: rdf:type first, then the graph's IRI, then string fragments before UUIDs, each by value."""
    fragment = F.substring_index(node, "#", -1)
    uuid = fragment.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    return [node != TYPE, F.substring_index(node, "#", 1), uuid, fragment]


def sorted_nodes(t: DataFrame, ng: str) -> DataFrame:
    """(node, rank): a graph's own subjects in order."""
    own = t.where(F.col("ng") == ng).select(F.col("s").alias("node")).distinct()
    return ranked(own, node_key(F.col("node")))


def file_order(t: DataFrame) -> DataFrame:
    """(node, is_blank, uses, rank): the order in which a writer puts nodes: IRI nodes by value, then blank ones by how often
    they are referred to, then by value."""
    uses = t.where("o_kind = 'node'").groupBy(F.col("o").alias("node")).agg(F.count(F.lit(1)).alias("uses"))
    own = nodes(t).join(t.select(F.col("s").alias("node")).distinct(), "node", "left_semi").join(uses, "node", "left").select("node", "is_blank", F.coalesce("uses", F.lit(0)).alias("uses"))
    return ranked(own, [F.col("is_blank"), F.when(F.col("is_blank"), F.col("uses")), F.col("node")])


def id_groups(df: DataFrame, ids: str) -> list[Column]:
    """The order of search hits by their ids (an array): single ids ascending, then those with several, then those without."""
    n = F.size(ids)
    return [F.when(n == 1, 0).when(n > 1, 1).otherwise(2), F.array_join(F.array_sort(ids), "\u0001")]


def priority(kind: Column, *first: str) -> Column:
    """A rank by kind: those of ``first`` in their order, then all others."""
    out = F.lit(len(first))
    for i, k in reversed(list(enumerate(first))):
        out = F.when(kind == k, i).otherwise(out)
    return out
