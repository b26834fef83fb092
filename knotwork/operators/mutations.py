"""Changes as functions from a triple table to the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIRST, KEY, TYPE, conform
from .graphs import reach_from


def add(t: DataFrame, rows: DataFrame, strict: bool = False) -> DataFrame:
    """``t`` with ``rows``; those it holds stay single, or with ``strict`` raise at run time."""
    if not strict:
        return conform(t).unionByName(rows, allowMissingColumns=True).dropDuplicates(KEY)
    t = conform(t)
    n = t.unionByName(rows, allowMissingColumns=True).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(c) for c in t.columns if c not in KEY))
    return n.where(F.coalesce(F.expr("assert_true(_n = 1, 'duplicate triple')").isNull(), F.lit(True))).select(*t.columns)


def new_graphs(graphs: DataFrame, names: DataFrame) -> DataFrame:
    """``graphs`` with a graph for each of ``names`` (ng); an empty or null name gets that of a random UUID. One that exists raises at run time."""
    named = names.select(F.when(F.coalesce("ng", F.lit("")) == "", F.concat(F.lit("urn:uuid:"), F.uuid())).otherwise(F.col("ng")).alias("ng"))
    both = graphs.select("ng", F.lit(False).alias("_new")).union(named.select("ng", F.lit(True))).groupBy("ng").agg(F.count(F.lit(1)).alias("_n"), F.max("_new").alias("_new"))
    made = both.where("_new").where(F.expr("assert_true(_n = 1, 'the graph exists') is null")).select("ng", F.lit(False).alias("is_referenced"), F.lit(False).alias("deleted"))
    return graphs.unionByName(made, allowMissingColumns=True)


def new_nodes(t: DataFrame, rows: DataFrame) -> DataFrame:
    """``t`` with nodes of ``rows`` (ng, fragment, types): a triple for each type. A node that exists raises at run time."""
    node = F.concat("ng", F.lit("#"), "fragment")
    made = rows.select("ng", node.alias("s"), F.explode("types").alias("o")).distinct()
    held = t.select("s").distinct().withColumn("_held", F.lit(True))
    made = made.join(held, "s", "left").where(F.expr("assert_true(_held is null, 'the node exists') is null"))
    return conform(t).unionByName(made.select("ng", F.lit("iri").alias("s_kind"), "s", F.lit(TYPE).alias("p"), F.lit("node").alias("o_kind"), "o"), allowMissingColumns=True)


def delete_node(t: DataFrame, n: str) -> DataFrame:
    """Without every triple that has the node in any place."""
    return t.where(~((F.col("s") == n) | (F.col("p") == n) | ((F.col("o_kind") == "node") & (F.col("o") == n))))


def delete_triples(t: DataFrame, n: str) -> DataFrame:
    """Without the node's own triples, list members excepted."""
    return t.where(~((F.col("s") == n) & (F.col("p") != FIRST)))


def delete_where(t: DataFrame, n: str, condition: Column) -> DataFrame:
    """Without those of the node's own triples that meet a condition."""
    return t.where(~((F.col("s") == n) & F.coalesce(condition, F.lit(False))))


def rename(t: DataFrame, names: DataFrame, strict: bool = False) -> DataFrame:
    """Nodes of ``names`` (old, new, ng or null to stay) renamed in every place and moved to another graph.

    References follow, in all graphs. A new name that exists keeps both nodes' triples, each once; with ``strict`` it raises at run time."""
    t = conform(t)
    if strict:
        taken = t.select(F.col("s").alias("new")).distinct().withColumn("_taken", F.lit(True))
        names = names.join(taken, "new", "left").where(F.expr("assert_true(_taken is null or new = old, 'the name is taken') is null")).select("old", "new", "ng")
    of = lambda c: names.select(F.col("old").alias(c), F.col("new").alias("_to"), F.col("ng").alias("_ng"))
    out = t.join(of("s"), "s", "left").withColumn("ng", F.coalesce("_ng", "ng")).withColumn("s", F.coalesce("_to", "s")).drop("_to", "_ng")
    out = out.join(of("p").drop("_ng"), "p", "left").withColumn("p", F.coalesce("_to", "p")).drop("_to")
    named = out.join(of("_o").drop("_ng"), (F.col("o") == F.col("_o")) & (F.col("o_kind") == "node"), "left")
    return named.withColumn("o", F.coalesce("_to", "o")).select(*t.columns).dropDuplicates(KEY)


def empty_graph(t: DataFrame, ng: str) -> DataFrame:
    """Without a graph's nodes, except those that other graphs refer to, which lose their own triples only."""
    return t.where(F.col("ng") != ng)


def dangling_after_empty(t: DataFrame, ng: str) -> DataFrame:
    """The graph's nodes that stay because other graphs refer to them."""
    own = t.where(F.col("ng") == ng).select(F.col("s").alias("node")).distinct()
    refs = t.where((F.col("ng") != ng) & (F.col("o_kind") == "node")).select(F.col("o").alias("node"))
    return own.join(refs, "node", "left_semi")


def delete_graph(graphs: DataFrame, imports: DataFrame, ng: str) -> DataFrame:
    """``graphs`` with one marked referenced and deleted, unless another imports it."""
    used = imports.where(F.col("imported") == ng).select(F.col("imported").alias("ng")).distinct().withColumn("_used", F.lit(True))
    gone = (F.col("ng") == ng) & F.col("_used").isNull()
    out = graphs.join(used, "ng", "left").withColumn("is_referenced", F.col("is_referenced") | gone).withColumn("deleted", F.col("deleted") | gone)
    return out.select(*graphs.columns)


def add_imports(imports: DataFrame, new: DataFrame) -> DataFrame:
    """Import edges with new ones; raises on a cycle. ``imports`` has none, so one has to lead through a new edge."""
    new = new.select(*imports.columns)
    out = imports.union(new).distinct()
    reached = reach_from(out.select(F.col("importer").alias("a"), F.col("imported").alias("b")), new.select(F.col("imported").alias("node")))
    if not reached.join(new, (F.col("start") == F.col("imported")) & (F.col("node") == F.col("importer")), "left_semi").isEmpty():
        raise ValueError("an import cycle")
    return out


def copied(t: DataFrame, nodes: DataFrame, ng: str) -> DataFrame:
    """``t`` with the triples of ``nodes`` (node) in a second graph too, under the names they have; what that graph holds stays single."""
    own = conform(t).join(nodes.select(F.col("node").alias("s")), "s", "left_semi").withColumn("ng", F.lit(ng))
    return conform(t).unionByName(own).dropDuplicates(KEY)
