"""Search documents, and queries over them: match, term, boolean, query strings, facets, paging.

Match sets are those of the analysed terms; hits are ordered by fields, not by a relevance score.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import natural_key
from ..model import OWL, RDFS, TYPE


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def match(df: DataFrame, field: str, text: str) -> DataFrame:
    """Rows whose field has any of the text's terms."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return df.where(F.arrays_overlap(tokens(F.col(field)), F.array(*map(F.lit, words)))) if words else df.where(F.lit(False))


def has_term(field: str, term: str) -> Column:
    """Whether a field has one exact term."""
    return F.array_contains(tokens(F.col(field)), term)


def condition(query: str, default: str, keywords: tuple[str, ...] = ()) -> Column:
    """A query string as a condition: ``field:value`` or bare terms; ``+`` requires, ``-`` excludes, others are alternatives
    where nothing is required. Fields in ``keywords`` compare whole."""
    must, may = F.lit(True), None
    required = False
    for sign, field, quoted, word in re.findall(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|(\S+))', query):
        field, value = field or default, (quoted or word).lower()
        if field in keywords:
            one = F.lower(F.col(field)) == value
        elif quoted:
            one = F.contains(F.concat(F.lit(" "), F.array_join(tokens(F.col(field)), " "), F.lit(" ")), F.lit(f" {' '.join(re.split(r'[\\W_]+', value))} "))
        else:
            one = has_term(field, value)
        one = F.coalesce(one, F.lit(False))
        if sign == "-":
            must = must & ~one
        elif sign == "+":
            must, required = must & one, True
        else:
            may = one if may is None else may | one
    return must if may is None or required else must & may


def page(df: DataFrame, order: list[str], start: int = 0, size: int = 10) -> DataFrame:
    """A page of hits; ``-field`` sorts downwards. A top-k, never a full sort."""
    keys = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]
    return df.orderBy(*keys).offset(start).limit(size)


def document_type(t: DataFrame, slots: DataFrame) -> DataFrame:
    """Per graph: doc_type by how many recognised nodes each slot has (``slots``: cls, slot 0 or 1, doc_type).

    One node in slot 0 gives its type, several give "-"; slot 1 counts only where slot 0 is empty."""
    own = t.where(F.col("p") == TYPE).join(slots, F.col("o") == F.col("cls")).select("ng", "s", "slot", "doc_type")
    n = lambda k: F.count_distinct(F.when(F.col("slot") == k, F.col("s")))
    kind = lambda k: F.min(F.when(F.col("slot") == k, F.col("doc_type")))
    per = own.groupBy("ng").agg(n(0).alias("n0"), kind(0).alias("t0"), n(1).alias("n1"), kind(1).alias("t1"))
    found = t.select("ng").distinct().join(per, "ng", "left")
    return found.select("ng", F.when(F.col("n0") == 1, F.col("t0")).when(F.col("n0") > 1, "-").when(F.col("n1") == 1, F.col("t1")).otherwise("-").alias("doc_type"))


def documents(t: DataFrame, labels: tuple[str, ...] = (f"{RDFS}label",), ids: tuple[str, ...] = ()) -> DataFrame:
    """One search document per graph: label, id and literal (sorted, distinct, joined), node_count. One aggregate."""
    of = lambda c: F.concat_ws("|", F.sort_array(F.collect_set(c)))
    lit = F.col("o_kind") == "lit"
    return t.groupBy(F.col("ng").alias("graph_uri")).agg(
        of(F.when(F.col("p").isin(*labels), F.col("o"))).alias("label"),
        of(F.when(F.col("p").isin(*ids), F.col("o"))).alias("id"),
        F.count(F.when(lit, 1)).alias("literals"), F.count_distinct("s").alias("node_count"),
    )


def id_conflicts(df: DataFrame, *key: str) -> DataFrame:
    """Keys that several graphs use: key columns, n_graphs."""
    return df.groupBy(*key).agg(F.count_distinct("graph").alias("n_graphs")).where("n_graphs > 1")


def field_names(df: DataFrame, fields: str, hits: int = 1000) -> DataFrame:
    """Names of the fields that the first hits have."""
    return df.limit(hits).select(F.explode(F.map_keys(fields)).alias("field")).distinct()


def refreshed(documents_: DataFrame, t: DataFrame, changed: DataFrame, labels: tuple[str, ...] = (f"{RDFS}label",), ids: tuple[str, ...] = ()) -> DataFrame:
    """Search documents after a commit: those of ``changed`` graphs (ng) are derived anew from ``t``, all others stay."""
    new = documents(t.join(changed, "ng", "left_semi"), labels, ids)
    return documents_.join(changed.select(F.col("ng").alias("graph_uri")), "graph_uri", "left_anti").unionByName(new)


def id_values(t: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """Per graph and id property: its distinct values, ascending (ng, p, vals)."""
    own = t.where(F.col("p").isin(*ids)).select("ng", "p", "o").distinct()
    return own.groupBy("ng", "p").agg(F.sort_array(F.collect_list("o")).alias("vals"))


def full_documents(t: DataFrame, main: DataFrame, labels: tuple[str, ...], comments: tuple[str, ...], ids: tuple[str, ...], owner: str) -> DataFrame:
    """One search document per graph, as a map of field names to values: graph_uri, main_type, fields.

    ``main`` (cls, main_type) says which types make a graph's main node: one such node gives its type, several or none give "-".
    Labels, comments and ids are those of all its nodes; ``owner`` is the predicate from an id's node to who issued it, in any graph."""
    own = t.where(F.col("p") == TYPE).join(main, F.col("o") == F.col("cls")).groupBy("ng").agg(F.count_distinct("s").alias("n"), F.min("s").alias("node"), F.min("main_type").alias("kind"))
    names = t.where(F.col("p").isin(*labels)).select(F.col("s").alias("o"), F.col("o").alias("v")).distinct()
    owners = t.where(F.col("p") == owner).select("ng", "o").join(names, "o").select("ng", F.lit("id.idOwner").alias("field"), "v")
    of = lambda ps, field: t.where(F.col("p").isin(*ps)).select("ng", F.lit(field).alias("field"), F.col("o").alias("v"))
    ids_ = of(ids, "id")
    rows = [
        of(labels, "label"), of(labels, "label.phrase"), of(comments, "comment"), ids_, ids_.withColumn("field", F.lit("id.key")), ids_.select("ng", F.lit("id.sort"), natural_key(F.col("v"))), owners,
        of((f"{OWL}imports",), "directImport"), t.where("o_kind = 'lit'").select("ng", F.lit("literal"), "o"),
        t.groupBy("ng").agg(F.count_distinct("s").cast("string").alias("v")).select("ng", F.lit("nodeCount"), "v"),
        own.where("n = 1").select("ng", F.lit("mainNode"), "node"),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.union(r)
    values = every.distinct().groupBy("ng", "field").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    docs = values.groupBy("ng").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "vs")))).alias("fields"))
    return docs.join(own, "ng", "left").select(F.col("ng").alias("graph_uri"), F.when(F.col("n") == 1, F.col("kind")).otherwise("-").alias("main_type"), "fields")
