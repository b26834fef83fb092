"""Recursive operators: closure, ancestors, components, cycles.

Every fixpoint cuts its lineage with checkpoint() each round, joins only what the last round added, and stops
when nothing new appears.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir; where none is set (one machine) to a temporary one.

    A checkpoint keeps its plan's estimated size, a product over all joins so far: it gets longer by a factor each
    round until it takes minutes to multiply, or overflows. Made from its rows, the frame starts without one."""
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="knotwork-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    spark, done = df.sparkSession, df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def closure(edges: DataFrame) -> DataFrame:
    """(a, b, depth): every b that can be reached from a over ``edges`` (a, b), with the least number of hops."""
    step = edges.select("a", "b").distinct()
    known = checkpointed(step.withColumn("depth", F.lit(1)))
    new, depth = known, 1
    while not new.isEmpty():
        depth += 1
        hop = new.select("a", F.col("b").alias("via")).join(step.select(F.col("a").alias("via"), "b"), "via").select("a", "b").distinct()
        new = checkpointed(hop.join(known.select("a", "b"), ["a", "b"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.union(new)
    return known


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth): what ``start`` (node) can reach, itself at depth 0. Moves only the frontier."""
    step = edges.select("a", "b").distinct()
    known = checkpointed(start.select("node").distinct().withColumn("depth", F.lit(0)))
    new, depth = known, 0
    while not new.isEmpty():
        depth += 1
        hop = new.join(step, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new = checkpointed(hop.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        known = known.union(new)
    return known


def reach_from(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, node): what each of ``start`` (node) can reach, itself included. For few starts: moves only their frontiers."""
    step = edges.select("a", "b").distinct()
    known = checkpointed(start.select(F.col("node").alias("start"), "node").distinct())
    new = known
    while not new.isEmpty():
        hop = new.join(step, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        new = checkpointed(hop.join(known, ["start", "node"], "left_anti"))
        known = known.union(new)
    return known


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle: peels nodes without an edge in or out until none is left to peel, then keeps those that reach themselves."""
    now = checkpointed(edges.select("a", "b").distinct())
    while True:
        heads, tails = now.select(F.col("b").alias("a")).distinct(), now.select(F.col("a").alias("b")).distinct()
        rest = checkpointed(now.join(heads, "a", "left_semi").join(tails, "b", "left_semi").select("a", "b"))
        if rest.count() == now.count():
            break
        now = rest
    return closure(now).where("a = b").select(F.col("a").alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of undirected ``edges`` (a, b); named by their least node.

    Alternates linking every node's neighbours to the least one with pointer jumping, so long paths halve each round."""
    e = edges.select("a", "b").where("a is not null and b is not null")
    both = checkpointed(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        low = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("c", "m").alias("c"))
        jump = low.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        new = checkpointed(low.join(jump, "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("c")))
        if new.join(label.withColumnRenamed("c", "was"), "node").where("c <> was").isEmpty():
            return new.withColumnRenamed("c", "component")
        label = new


def common_ancestor(parents: DataFrame, x: object, y: object) -> DataFrame:
    """The nearest common ancestor of two commits over ``parents`` (a: commit, b: parent); one row or none.

    Distance is the sum of the hops from both; ties go to the least commit."""
    spark: SparkSession = parents.sparkSession
    one = lambda v: parents.where(F.lit(False)).select(F.col("a").alias("node")).union(spark.range(1).select(F.lit(v).alias("node")))
    both = reach(parents, one(x)).withColumnRenamed("depth", "d1").join(reach(parents, one(y)).withColumnRenamed("depth", "d2"), "node")
    return both.select("node", (F.col("d1") + F.col("d2")).alias("hops")).orderBy("hops", "node").limit(1)


def ancestry(parents: DataFrame, x: object, y: object) -> DataFrame:
    """How commit x stands to y: same, newer (y is its ancestor), older or diverged."""
    spark: SparkSession = parents.sparkSession
    one = lambda v: spark.range(1).select(F.lit(v).alias("node"))
    up = lambda v, w: reach(parents, one(v)).where(F.col("node") == w).agg((F.count(F.lit(1)) > 0).alias("is"))
    both = up(x, y).withColumnRenamed("is", "newer").crossJoin(up(y, x).withColumnRenamed("is", "older"))  # one row each
    return both.select(F.when(F.lit(x) == F.lit(y), "same").when(F.col("newer"), "newer").when(F.col("older"), "older").otherwise("diverged").alias("relation"))


def timeline(commits: DataFrame, ts: str, lane: str) -> DataFrame:
    """``commits`` (node, and columns named by ``ts`` and ``lane``) on a grid: row by time, newest first, ties by node; col is the lane."""
    from .order import ranked

    return ranked(commits, [F.desc(ts), F.col("node")], "row").withColumn("col", F.col(lane))


def walk_order(edges: DataFrame, root: object) -> DataFrame:
    """(path, node, depth): the tree of first visits from ``root``, each node under the neighbour of least depth, then least name;
    ordered by path, that is a depth-first listing in which every node comes once."""
    spark = edges.sparkSession
    depth = reach(edges, edges.where(F.lit(False)).select(F.col("a").alias("node")).union(spark.range(1).select(F.lit(root).alias("node"))))
    up = edges.join(depth.select(F.col("node").alias("a"), F.col("depth").alias("d_a")), "a").join(depth.select(F.col("node").alias("b"), F.col("depth").alias("d_b")), "b").where("d_b = d_a + 1")
    tree = checkpointed(up.groupBy(F.col("b").alias("node"), F.col("d_b").alias("depth")).agg(F.min("a").alias("under")))
    out = level = checkpointed(depth.where("depth = 0").select(F.array(F.col("node").cast("string")).alias("path"), "node", "depth"))
    while True:
        here = level.select(F.col("node").alias("under"), F.col("path").alias("_p"))
        level = checkpointed(tree.join(here, "under").select(F.concat("_p", F.array(F.col("node").cast("string"))).alias("path"), "node", "depth"))
        if level.isEmpty():
            return out
        out = out.union(level)


def part_groups(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, member): what each of ``roots`` (node) has below it over part edges (a: whole, b: part), itself included."""
    return reach_from(edges, roots).toDF("root", "member")


def group_ids(groups: DataFrame) -> DataFrame:
    """(root, group_id, n): a name-based UUID of each group's members, so that equal groups have equal ids."""
    from ..functions.scalars import graph_id
    from .aggregates import digest, tree_hash

    h = tree_hash(groups.select("root", digest(F.col("member").cast("string")).alias("d")).distinct(), "root")
    n = groups.groupBy("root").agg(F.count_distinct("member").alias("n"))
    return h.join(n, "root").select("root", graph_id(F.col("hash")).alias("group_id"), "n")


def partitioned(t: DataFrame, groups: DataFrame, shared: str) -> tuple[DataFrame, DataFrame]:
    """``t`` cut into graphs, and their imports (importer, imported).

    ``groups`` (grp, node) says which nodes belong together; a node of several groups goes to the graph ``shared``. Nodes of no group
    are pulled to the one that refers to them, or to ``shared`` if several do, round by round until none is left to pull; what no group
    reaches stays in ``shared``. Groups import one another where they refer to one another; where that would be a circle, its nodes'
    groups import ``shared`` instead, and what they refer to in the circle moves there."""
    one = lambda df: df.groupBy("node").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).select("node", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(shared)).alias("grp"))
    nodes = t.select(F.col("s").alias("node")).distinct()
    refs = checkpointed(t.where("o_kind = 'node'").select(F.col("s").alias("a"), F.col("o").alias("b")).join(nodes.withColumnRenamed("node", "b"), "b", "left_semi").distinct())
    known = checkpointed(one(groups).join(nodes, "node", "left_semi"))
    new = known
    while not new.isEmpty():
        pulled = new.join(refs, F.col("node") == F.col("a")).select("grp", F.col("b").alias("node"))
        new = checkpointed(one(pulled.join(known.select("node"), "node", "left_anti")))
        known = known.union(new)
    place = checkpointed(nodes.join(known, "node", "left").select("node", F.coalesce("grp", F.lit(shared)).alias("grp")))
    across = lambda p: refs.join(p.select(F.col("node").alias("a"), F.col("grp").alias("from")), "a").join(p.select(F.col("node").alias("b"), F.col("grp").alias("to")), "b").where("`from` <> to")
    links = across(place)
    ring = cyclic(links.select(F.col("from").alias("a"), F.col("to").alias("b")).distinct())
    # what is referred to within a circle, and all that it leads to, is shared: then nothing shared refers out of it
    moved = links.join(ring.select(F.col("node").alias("to")), "to", "left_semi").select(F.col("b").alias("node")).union(place.where(F.col("grp") == shared).select("node"))
    moved = reach(refs, moved).select("node").withColumn("_m", F.lit(True))
    place = checkpointed(place.join(moved, "node", "left").select("node", F.when(F.col("_m"), F.lit(shared)).otherwise(F.col("grp")).alias("grp")))
    out = t.join(place.select(F.col("node").alias("s"), F.col("grp").alias("_g")), "s").withColumn("ng", F.col("_g")).select(*t.columns)
    return out, across(place).select(F.col("from").alias("importer"), F.col("to").alias("imported")).distinct()


def eligible_roots(t: DataFrame, roots: DataFrame, needs: str, only: str) -> DataFrame:
    """``roots`` (node) that a node of type ``needs`` is below, and that have more below them than nodes of type ``only``."""
    from ..model import TYPE

    below = reach_from(t.where("o_kind = 'node'").select(F.col("s").alias("a"), F.col("o").alias("b")), roots).where("start <> node")
    typed = below.join(t.where(F.col("p") == TYPE).select(F.col("s").alias("node"), F.col("o").alias("cls")), "node")
    per = typed.groupBy("start").agg(F.max(F.col("cls") == needs).alias("has"), F.max(F.col("cls") != only).alias("more"))
    return per.where("has and more").select(F.col("start").alias("node"))
