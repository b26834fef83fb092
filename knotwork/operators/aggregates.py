"""Counts and digests of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIRST, conform
from .graphs import closure
from .patterns import graphs


def graph_info(t: DataFrame) -> DataFrame:
    """Per graph: distinct subjects by kind, triples by object kind, list members, predicates."""
    of = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    return t.groupBy("ng").agg(
        F.count_distinct(F.when(F.col("s_kind") == "iri", F.col("s"))).alias("iri_subjects"),
        F.count_distinct(F.when(F.col("s_kind") == "blank", F.col("s"))).alias("blank_subjects"),
        F.count_distinct("p").alias("predicates"),
        F.count(F.lit(1)).alias("triples"), of("o_kind", "node").alias("node_objects"), of("o_kind", "lit").alias("literals"),
        of("p", FIRST).alias("members"),
    )


def stage_info(t: DataFrame) -> DataFrame:
    """One row: local graphs, referenced graphs, triples."""
    g = graphs(t).agg(F.count(F.when(~F.col("is_referenced"), 1)).alias("local_graphs"), F.count(F.when(F.col("is_referenced"), 1)).alias("referenced_graphs"))
    return g.crossJoin(t.agg(F.count(F.lit(1)).alias("triples")))  # one row each


def node_counts(t: DataFrame) -> DataFrame:
    """Per node: triples as subject by object kind, and references to it."""
    kinds = {"node": "as_subject_nodes", "lit": "as_subject_literals"}
    own = [F.when(F.col("o_kind") == k, 1).otherwise(0).alias(c) for k, c in kinds.items()]
    rows = t.select(F.col("s").alias("node"), *own, F.lit(0).alias("as_object"))
    refs = t.where("o_kind = 'node'").select(F.col("o").alias("node"), *(F.lit(0).alias(c) for c in kinds.values()), F.lit(1).alias("as_object"))
    return rows.union(refs).groupBy("node").agg(*(F.sum(c).alias(c) for c in (*kinds.values(), "as_object")))


def predicate_usage(t: DataFrame, owner: str | None = None) -> DataFrame:
    """Per predicate: distinct subjects and triples; only of predicates in the graph ``owner``, if given."""
    if owner is not None:
        t = t.where(F.col("p").startswith(f"{owner}#"))
    return t.groupBy("p").agg(F.count_distinct("s").alias("subjects"), F.count(F.lit(1)).alias("uses"))


def import_counts(imports: DataFrame) -> DataFrame:
    """Per graph of ``imports`` (a, b): graph, direct_imports, all_imports (of the closure), imported_by."""
    n = F.count_distinct
    every = closure(imports)
    out = imports.select(F.col("a").alias("graph")).union(imports.select("b")).distinct()
    for by, what, name in ((imports, "a", "direct_imports"), (every, "a", "all_imports"), (imports, "b", "imported_by")):
        out = out.join(by.groupBy(F.col(what).alias("graph")).agg(n("b" if what == "a" else "a").alias(name)), "graph", "left")
    return out.select("graph", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("direct_imports", "all_imports", "imported_by")))


def values_of(t: DataFrame, p: str) -> DataFrame:
    """Per graph: the sorted distinct values of a predicate, joined."""
    return t.where(F.col("p") == p).groupBy("ng").agg(F.concat_ws("|", F.sort_array(F.collect_set("o"))).alias("vals"))


def facet(df: DataFrame, field: str, top: int) -> DataFrame:
    """The most common values of a field; ties by value."""
    n = F.count(F.lit(1)).alias("n")
    return df.groupBy(field).agg(n).orderBy(F.desc("n"), field).limit(top)


def framed(c: Column) -> Column:
    """A value with its length before it, so that no value's end can be taken for another's start; null has none."""
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def line() -> Column:
    """A triple in canonical form: all that ``KEY`` has but the graph."""
    members = F.array_join(F.transform("o_members", framed), "")
    return F.concat(*(framed(F.col(c)) for c in ("s", "p", "o_kind", "o", "o_dtype", "o_lang")), framed(members), framed(F.col("member_idx").cast("string")))


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def tree_hash(d: DataFrame, *by: str, name: str = "hash") -> DataFrame:
    """One hash for the digests (column d, hex) of each group, whatever their order.

    Digests are sorted and hashed by their first four digits, those hashes by the first two, then all: a task holds a 65,536th
    of a group's digests at a time, never all of them."""
    over = lambda at, h: digest(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("k"), F.col(h).alias("h")))), lambda x: x["h"]), ""))
    fours = d.groupBy(*by, F.substring("d", 1, 4).alias("four")).agg(over("d", "d").alias("h"))
    twos = fours.groupBy(*by, F.substring("four", 1, 2).alias("two")).agg(over("four", "h").alias("h"))
    return twos.groupBy(*by).agg(over("two", "h").alias(name))


def tree_sql(d: str, *by: str, name: str = "hash") -> str:
    """``tree_hash`` in DuckDB's SQL, over a relation with the columns ``by`` and d."""
    g, last = "".join(f"{c}, " for c in by), f" GROUP BY {', '.join(by)}" if by else ""
    fours = f"SELECT {g}d[1:4] AS four, sha256(string_agg(d, '' ORDER BY d)) AS h FROM {d} GROUP BY {g}d[1:4]"
    twos = f"SELECT {g}four[1:2] AS two, sha256(string_agg(h, '' ORDER BY four)) AS h FROM ({fours}) GROUP BY {g}four[1:2]"
    return f"SELECT {g}sha256(string_agg(h, '' ORDER BY two)) AS {name} FROM ({twos}){last}"


def framed_sql(c: str) -> str:
    """``framed`` in DuckDB's SQL."""
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def graph_hash(t: DataFrame) -> DataFrame:
    """A content hash per graph, whatever the order of its rows."""
    return tree_hash(conform(t).select("ng", digest(line()).alias("d")).distinct(), "ng")
