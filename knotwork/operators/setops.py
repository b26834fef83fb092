"""Union, difference, equality, patch and merge of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY, conform, same


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples of either, each once."""
    return conform(a).unionByName(conform(b)).dropDuplicates(KEY)


def duplicates(t: DataFrame) -> DataFrame:
    """Triples that a graph holds more than once, with their count."""
    return conform(t).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples of only one side with flag -1 (removed) or 1 (added); members of lists compare by their place.

    One aggregate over both sides, which needs a single exchange; partial sums cancel on the map side."""
    side = lambda t, v: conform(t).select(*KEY, F.lit(v).alias("flag")).distinct()
    both = side(a, -1).union(side(b, 1)).groupBy(*KEY).agg(F.sum("flag").cast("int").alias("flag")).where("flag <> 0")
    return both.select("flag", *KEY)


def patch(a: DataFrame, changes: DataFrame) -> DataFrame:
    """``a`` with a difference applied: patch(a, diff(a, b)) is b."""
    gone = changes.where("flag = -1").select(*KEY)
    rest = conform(a).alias("a").join(gone.alias("g"), same("a", "g"), "left_anti").select("a.*")
    added = changes.where("flag = 1").drop("flag").withColumn("s_kind", F.when(F.col("s").startswith("_:"), "blank").otherwise("iri"))
    return rest.unionByName(added, allowMissingColumns=True)


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per graph of either side: whether both hold the same triples."""
    changed = diff(a, b).select("ng").distinct().withColumn("_changed", F.lit(True))
    every = a.select("ng").union(b.select("ng")).distinct()
    return every.join(changed, "ng", "left").select("ng", F.col("_changed").isNull().alias("equal"))


def import_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Import edges with flag -1, 0 or 1."""
    one = a.distinct().withColumn("_a", F.lit(1))
    two = b.distinct().withColumn("_b", F.lit(1))
    both = one.join(two, ["importer", "imported"], "full_outer")
    return both.select("importer", "imported", (F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).alias("flag"))


def node_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Subjects with the counts of their triples on either side and the change."""
    n = F.count(F.lit(1))
    both = a.groupBy("s").agg(n.alias("before")).join(b.groupBy("s").agg(n.alias("after")), "s", "full_outer")
    both = both.select("s", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("delta", F.col("after") - F.col("before"))


def merge_actions(source: DataFrame, target: DataFrame) -> DataFrame:
    """What merging does with each graph of ``source``: ng, action.

    Both have ng, is_referenced, hash (of the content), commit, base (the commit they came from) and modified."""
    s = source.select("ng", *(F.col(c).alias(f"s_{c}") for c in ("is_referenced", "hash", "commit", "base", "modified")))
    t = target.select("ng", *(F.col(c).alias(f"t_{c}") for c in ("is_referenced", "hash", "commit", "base", "modified")))
    both = s.join(t, "ng", "left")
    same = F.col("s_commit").eqNullSafe(F.col("t_commit")) & F.col("s_commit").isNotNull()
    action = (
        F.when(F.col("t_is_referenced").isNull(), F.when(F.col("s_is_referenced"), "redirect").otherwise("move"))
        .when(F.col("s_is_referenced"), "union")
        .when(F.col("t_is_referenced"), "promote")
        .when(F.col("s_hash") == F.col("t_hash"), "keep")
        .when(same & F.col("s_modified") & F.col("t_modified"), "union")
        .when(same, F.when(F.col("s_modified"), "replace").otherwise("keep"))
        .when(F.col("t_base") == F.col("s_commit"), "keep")
        .when(F.col("s_base") == F.col("t_commit"), "replace")
        .otherwise("union")
    )
    return both.select("ng", action.alias("action"))


def merge(source: DataFrame, target: DataFrame, actions: DataFrame) -> DataFrame:
    """Target triples after the merge of ``source`` under ``actions``."""
    replaced = actions.where("action = 'replace'").select("ng")
    taken = actions.where("action in ('move', 'union', 'promote', 'replace')").select("ng")
    return union(target.join(replaced, "ng", "left_anti"), source.join(taken, "ng", "left_semi"))


def missing(source: DataFrame, target: DataFrame, key: str = "hash") -> DataFrame:
    """Content-addressed rows of ``source`` that ``target`` lacks: what replication copies."""
    return source.join(target.select(key), key, "left_anti")


def moved_stubs(source: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` graphs (ng, is_referenced, n_nodes) with the referenced ones of ``source`` that it lacks; empty ones are dropped."""
    stubs = source.where("is_referenced and n_nodes > 0").join(target.select("ng"), "ng", "left_anti")
    return target.where("not is_referenced or n_nodes > 0").unionByName(stubs.select(*target.columns))
