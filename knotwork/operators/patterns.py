"""Triple patterns, node scans and joins over nodes.

Each function takes and returns DataFrames; every filter is on plain columns, so it reaches the scan of a table of triples. Triples
that are lowered from other tables have no such scan: there, name the predicates when lowering, and only their columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import FIRST, TYPE

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def match(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, o_kind: str | None = None) -> DataFrame:
    """Triples of a pattern; None matches anything."""
    for c, v in (("s", s), ("p", p), ("o", o), ("o_kind", o_kind)):
        if v is not None:
            t = t.where(F.col(c) == v)
    return t


def touching(t: DataFrame, n: str) -> DataFrame:
    """Triples in which a node is subject, predicate or object, each once, with its role."""
    as_o = (F.col("o_kind") == "node") & (F.col("o") == n)
    role = F.when(F.col("s") == n, "subject").when(as_o, "object").otherwise("predicate")
    return t.where((F.col("s") == n) | (F.col("p") == n) | as_o).withColumn("role", role)


def objects(t: DataFrame, s: str, p: str) -> DataFrame:
    return match(t, s, p).select("o_kind", "o", "o_dtype", "o_lang")


def has_triples(t: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (s, p, o) with whether each is a triple of ``t``; strict on all three."""
    held = t.select("s", "p", "o", F.lit(True).alias("_held")).distinct()
    return wanted.join(held, ["s", "p", "o"], "left").withColumn("held", F.coalesce("_held", F.lit(False))).drop("_held")


def canonical_key() -> list[Column]:
    """The order of a node's triples: list members first and in their order, then object kind, predicate, object."""
    rank = F.when(F.col("o_kind") == "node", 0).when(F.col("o_kind") == "lit", 1).when(F.col("o_kind") == "litcoll", 2).otherwise(3)
    first = F.col("p") == FIRST
    return [first.desc(), F.when(first, F.col("member_idx")), rank, F.col("p"), F.col("o_dtype"), F.col("o")]


def positions(t: DataFrame) -> DataFrame:
    """Each subject's triples with their place (from 0) in canonical order."""
    w = Window.partitionBy("ng", "s").orderBy(*canonical_key())
    return t.withColumn("pos", F.row_number().over(w) - 1)


def rendered(t: DataFrame) -> DataFrame:
    """Per subject: its objects in canonical order, joined (ng, s, os). A subject's triples are one row, as in any text of it."""
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate((F.col("p") != FIRST, F.when(F.col("p") == FIRST, F.col("member_idx")), *canonical_key()[2:]))))
    own = t.groupBy("ng", "s").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("o").alias("o")))).alias("t"))
    return own.select("ng", "s", F.array_join(F.transform("t", lambda x: x["o"]), "|").alias("os"))


def nodes(t: DataFrame) -> DataFrame:
    """Distinct nodes in subject or object place: node, is_blank."""
    blank = lambda kind: kind == "blank"
    subjects = t.select(F.col("s").alias("node"), blank(F.col("s_kind")).alias("is_blank"))
    as_object = t.where("o_kind in ('node', 'coll')").select(F.col("o").alias("node"), F.col("o").startswith("_:").alias("is_blank"))
    return subjects.union(as_object).distinct()


def iri_nodes(t: DataFrame) -> DataFrame:
    return nodes(t).where(~F.col("is_blank"))


def blank_nodes(t: DataFrame) -> DataFrame:
    return nodes(t).where("is_blank")


def list_nodes(t: DataFrame) -> DataFrame:
    """Nodes that are ordered collections."""
    return match(t, p=FIRST).select(F.col("s").alias("node")).distinct()


def undefined(t: DataFrame) -> DataFrame:
    """Nodes that are referred to but have no triple of their own."""
    return nodes(t).select("node").join(t.select(F.col("s").alias("node")), "node", "left_anti")


def by_fragment(t: DataFrame, fragment: str) -> DataFrame:
    """Nodes with a fragment; UUIDs compare without regard to case."""
    f = F.substring_index("node", "#", -1)
    return nodes(t).where((f == fragment) | (f.rlike(UUID) & (F.lower(f) == fragment.lower())))


def graphs(t: DataFrame) -> DataFrame:
    """ng and is_referenced: graphs that only appear as the base of other graphs' nodes are referenced ones."""
    local = t.select("ng", F.lit(False).alias("is_referenced")).distinct()
    base = F.substring_index("o", "#", 1)
    named = t.where((F.col("o_kind") == "node") & F.col("o").contains("#")).select(base.alias("ng"), F.lit(True).alias("is_referenced")).distinct()
    return local.union(named.join(local, "ng", "left_anti"))


def flags(t: DataFrame) -> DataFrame:
    """Per node: is_iri, is_blank, is_uuid, is_list."""
    f = F.substring_index("node", "#", -1)
    lists = list_nodes(t).withColumn("is_list", F.lit(True))
    out = nodes(t).join(lists, "node", "left")
    return out.select("node", (~F.col("is_blank")).alias("is_iri"), "is_blank", f.rlike(UUID).alias("is_uuid"), F.coalesce("is_list", F.lit(False)).alias("is_list"))


def belongs(wanted: DataFrame, t: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (node) whose node has a triple in ``t``."""
    return wanted.join(t.select(F.col("s").alias("node")), "node", "left_semi")


def of_type(t: DataFrame, cls: str) -> DataFrame:
    return match(t, p=TYPE, o=cls).select("ng", F.col("s").alias("node"))


def subjects_with(t: DataFrame, p: str, o: str) -> DataFrame:
    return match(t, p=p, o=o).select("ng", F.col("s").alias("node"))


def predicates_of_value(t: DataFrame, value: str) -> DataFrame:
    return t.where((F.col("o_kind") == "lit") & (F.col("o") == value)).select("p", "s")


def path(t: DataFrame, start: DataFrame, *predicates: str) -> DataFrame:
    """From ``start`` (node) along predicates: (node, end). One equi-join a hop; unused columns never move."""
    out = start.select("node", F.col("node").alias("end"))
    for p in predicates:
        hop = match(t, p=p).select(F.col("s").alias("end"), F.col("o").alias("_next"))
        out = out.join(hop, "end").select("node", F.col("_next").alias("end"))
    return out


def star(t: DataFrame, *predicates: str) -> DataFrame:
    """One row per subject with a column per predicate: a single aggregate instead of a join per predicate."""
    name = lambda p: p.rpartition("#")[2]
    own = t.where(F.col("p").isin(*predicates))
    return own.groupBy("s").agg(*(F.max(F.when(F.col("p") == p, F.col("o"))).alias(name(p)) for p in predicates))
