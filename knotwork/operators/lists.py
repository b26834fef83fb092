"""Ordered collections: rows of rdf:first with member_idx, arrays, and rdf:first/rest chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIRST, NIL, REST
from .graphs import checkpointed


def build(df: DataFrame, owner: str, members: str) -> DataFrame:
    """One row per member of each row's array: node, member_idx, o; an empty array is rdf:nil without members."""
    size = F.size(members)
    held = df.select(F.when(size > 0, F.col(owner)).otherwise(F.lit(NIL)).alias("node"), F.posexplode(members).alias("member_idx", "o"))
    return held


def members(t: DataFrame) -> DataFrame:
    """Per list node: its members in order, and how many."""
    own = t.where(F.col("p") == FIRST)
    ordered = F.array_sort(F.collect_list(F.struct("member_idx", "o")))
    return own.groupBy("ng", "s").agg(ordered.alias("m")).select("ng", F.col("s").alias("node"), F.transform("m", lambda x: x["o"]).alias("members"), F.size("m").alias("n"))


def member_at(t: DataFrame, i: int) -> DataFrame:
    """The i-th member (from 0) of each list that has one; a filter, without building the lists."""
    return t.where((F.col("p") == FIRST) & (F.col("member_idx") == i)).select("ng", F.col("s").alias("node"), "o")


def set_members(t: DataFrame, new: DataFrame) -> DataFrame:
    """Lists of ``new`` (ng, s, o, member_idx and so on) with their members replaced."""
    nodes = new.select("ng", "s").distinct().withColumn("_new", F.lit(True))
    rest = t.join(nodes, ["ng", "s"], "left").where(F.col("_new").isNull() | (F.col("p") != FIRST)).select(*t.columns)
    return rest.unionByName(new, allowMissingColumns=True)


def _rests(t: DataFrame) -> DataFrame:
    """(ng, cell, nxt): the rest of each cell; one with several rests follows the least."""
    return t.where(F.col("p") == REST).groupBy("ng", F.col("s").alias("cell")).agg(F.min("o").alias("nxt"))


def _levels(links: DataFrame) -> list[DataFrame]:
    """(ng, cell, nxt): level i leads over ``links`` from a cell to the one 2 ** i on; cells whose chain ends before have no row.

    A chain that ends has a cell with just 2 ** i links ahead for each i up to its length. So a level of as many cells as the one before
    has only cells of endless chains, and is the last one: rounds follow the longest chain that ends, not the number of cells."""
    levels, n = [checkpointed(links)], -1
    while (size := levels[-1].count()) not in (0, n):
        n = size
        far = levels[-1].select("ng", F.col("cell").alias("nxt"), F.col("nxt").alias("nn"))
        levels.append(checkpointed(levels[-1].join(far, ["ng", "nxt"]).select("ng", "cell", F.col("nn").alias("nxt"))))
    return levels


def endless(t: DataFrame) -> DataFrame:
    """(ng, cell): cells of chains that never end, because they run into a circle."""
    return _levels(_rests(t).where(F.col("nxt") != NIL))[-1].select("ng", "cell")


def collapse(t: DataFrame) -> DataFrame:
    """Chains of rdf:first/rest as list rows: node (the head), member_idx, o, o_kind, o_dtype.

    By pointer doubling, so a chain of n cells takes log2(n) joins. Heads are cells that no rest points to; a shared tail belongs
    to each of its heads. A cell whose rest is no cell ends its chain. Chains that run into a circle are no lists and give no row:
    ``endless`` has their cells."""
    rests = checkpointed(_rests(t))
    links = rests.where(F.col("nxt") != NIL).join(rests.select("ng", F.col("cell").alias("nxt")), ["ng", "nxt"], "left_semi")
    levels = _levels(links.select("ng", "cell", "nxt"))
    first = t.where(F.col("p") == FIRST).select("ng", F.col("s").alias("cell"), "o", "o_kind", "o_dtype")
    pointed = t.where(F.col("p") == REST).select("ng", F.col("o").alias("cell"))
    heads = rests.select("ng", "cell").join(pointed, ["ng", "cell"], "left_anti").join(levels[-1], ["ng", "cell"], "left_anti")
    # the covered stretch doubles with every level; nothing of what ends is in the last one
    held = heads.select("ng", F.col("cell").alias("head"), "cell", F.lit(0).alias("idx"))
    for i, level in enumerate(levels[:-1]):
        to = level.select("ng", "cell", F.col("nxt").alias("far"))
        more = held.join(to, ["ng", "cell"]).select("ng", "head", F.col("far").alias("cell"), (F.col("idx") + (1 << i)).alias("idx"))
        held = checkpointed(held.union(more))
    return held.join(first, ["ng", "cell"]).select("ng", F.col("head").alias("node"), F.col("idx").alias("member_idx"), "o", "o_kind", "o_dtype")


def homogeneous(m: DataFrame) -> DataFrame:
    """Collapsed lists by kind: litcoll where all members are literals of one datatype, else coll."""
    one = (F.count_distinct(F.coalesce("o_dtype", F.lit(""))) == 1) & (F.count(F.when(F.col("o_kind") != "lit", 1)) == 0)
    return m.groupBy("ng", "node").agg(F.when(one, "litcoll").otherwise("coll").alias("kind"), F.count(F.lit(1)).alias("n"))


def inline_nodes(t: DataFrame) -> DataFrame:
    """Blank nodes used exactly once, which a writer puts where they are used. A cell of a list has to have nothing but first and rest."""
    cells = t.where(F.col("p").isin(FIRST, REST)).select(F.col("s").alias("node"))
    more = t.where(~F.col("p").isin(FIRST, REST)).select(F.col("s").alias("node"))
    return _used_once(t).join(cells.join(more, "node", "left_semi"), "node", "left_anti")


def _used_once(t: DataFrame) -> DataFrame:
    return t.where("o_kind in ('node', 'coll') and o like '_:%'").groupBy("o").agg(F.count(F.lit(1)).alias("uses")).where("uses = 1").select(F.col("o").alias("node"))


def rendered(members: Column) -> Column:
    """``( a b c )``; ``()`` without members."""
    return F.when(F.size(members) == 0, "()").otherwise(F.concat(F.lit("( "), F.array_join(members, " "), F.lit(" )")))


def as_list(t: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node) with whether each is a list, and how many members it has."""
    own = t.where(F.col("p") == FIRST).groupBy(F.col("s").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(own, "node", "left").select("node", (F.col("n").isNotNull() | (F.col("node") == NIL)).alias("is_list"), F.coalesce("n", F.lit(0)).alias("n"))


def literal_arrays(m: DataFrame) -> DataFrame:
    """Collapsed lists whose members are all literals of one datatype, as arrays: ng, node, o_dtype, o_members. Others give no row."""
    per = m.groupBy("ng", "node").agg(
        F.min(F.coalesce("o_dtype", F.lit(""))).alias("low"), F.max(F.coalesce("o_dtype", F.lit(""))).alias("high"), F.count(F.when(F.col("o_kind") != "lit", 1)).alias("other"),
        F.transform(F.array_sort(F.collect_list(F.struct("member_idx", "o"))), lambda x: x["o"]).alias("o_members"),
    )
    return per.where("other = 0 and low = high").select("ng", "node", F.nullif("low", F.lit("")).alias("o_dtype"), "o_members")


def member(arrays: Column, i: int) -> Column:
    """The i-th member (from 0) of an array of members; null beyond its end."""
    return F.get(arrays, i)


def nested(m: DataFrame, most: int = 8) -> DataFrame:
    """Lists of lists taken apart: ng, node (of the outermost list), path (places from the outside in), o, o_kind. A join per level, ``most``
    levels at most; members that are lists beyond that stay names."""
    inner = m.select("ng", F.col("node").alias("o"), F.col("member_idx").alias("_i"), F.col("o").alias("_o"), F.col("o_kind").alias("_k"))
    outer = m.join(m.where("o_kind = 'node'").select("ng", F.col("o").alias("node")).distinct(), ["ng", "node"], "left_anti")
    open_ = outer.select("ng", "node", F.array("member_idx").alias("path"), "o", "o_kind")
    out = None
    for _ in range(most - 1):
        both = checkpointed(open_.join(inner, ["ng", "o"], "left"))
        done = both.where("_i is null").select("ng", "node", "path", "o", "o_kind")
        out = done if out is None else out.unionByName(done)
        open_ = both.where("_i is not null").select("ng", "node", F.concat("path", F.array("_i")).alias("path"), F.col("_o").alias("o"), F.col("_k").alias("o_kind"))
        if open_.isEmpty():
            return out
    return out.unionByName(open_)
