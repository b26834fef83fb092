"""The triple table and the lowering of relational tables into it.

Every graph lives in one wide table (``SCHEMA``); objects carry a kind (node, lit, litcoll, coll) and are never
compared across kinds. The lowering is declared once (``TABLES``) and read twice: as a DataFrame (one scan
per table, its columns inlined as rows) and as DuckDB SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EX, SCHEMA_NS = "http://ex.org/", "http://ex.org/schema#"
RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
OWL, XSD = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
TYPE, FIRST, REST, NIL = f"{RDF}type", f"{RDF}first", f"{RDF}rest", f"{RDF}nil"

SCHEMA = (
    "ng string, s_kind string, s string, p string, o_kind string, o string, o_dtype string, o_lang string, "
    "o_members array<string>, member_idx int"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: What makes a triple: two that agree in all of these are one. Members of a list differ by their place in it.
KEY = ["ng", "s", "p", "o_kind", "o", "o_dtype", "o_lang", "o_members", "member_idx"]


@dataclass(frozen=True)
class Table:
    key: str
    cls: str
    #: column -> name of a table (a node of it) or an XSD type
    columns: dict[str, str]


TABLES = {
    "region": Table("r_regionkey", "Region", {"r_name": "string"}),
    "nation": Table("n_nationkey", "Nation", {"n_name": "string", "n_regionkey": "region"}),
    "customer": Table("c_custkey", "Customer", {"c_name": "string", "c_nationkey": "nation", "c_acctbal": "double", "c_mktsegment": "string"}),
    "supplier": Table("s_suppkey", "Supplier", {"s_name": "string", "s_nationkey": "nation", "s_acctbal": "double"}),
    "part": Table("p_partkey", "Part", {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "double"}),
    "orders": Table("o_orderkey", "Order", {"o_custkey": "customer", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(name: str, key: Column) -> Column:
    return F.concat(F.lit(f"{EX}{name}#"), key.cast("string"))


def _text(column: Column, kind: str) -> Column:
    return F.format_string("%.2f", column) if kind == "double" else column.cast("string")


def conform(t: DataFrame) -> DataFrame:
    """``t`` with the columns of ``SCHEMA`` that it lacks, as nulls."""
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    return t.select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS if c not in t.columns))


def same(a: str, b: str, columns: list[str] = KEY) -> Column:
    """Whether rows of two aliased frames agree in all columns, nulls included; joins can hash it."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def lower_frame(df: DataFrame, name: str, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """The triples of a table's rows; nulls give none. Of ``predicates`` (IRIs) alone, if given: then only their columns are read."""
    t, none = TABLES[name], F.lit(None).cast("string")
    rows = {TYPE: F.struct(F.lit(TYPE).alias("p"), F.lit("node").alias("o_kind"), F.lit(SCHEMA_NS + t.cls).alias("o"), none.alias("o_dtype"))}
    for c, kind in t.columns.items():
        if predicates is None or SCHEMA_NS + c in predicates:
            o = node(kind, F.col(c)) if kind in TABLES else _text(F.col(c), kind)
            rows[SCHEMA_NS + c] = F.struct(F.lit(SCHEMA_NS + c).alias("p"), F.lit("node" if kind in TABLES else "lit").alias("o_kind"), o.alias("o"), (none if kind in TABLES else F.lit(XSD + kind)).alias("o_dtype"))
    rows = [r for p, r in rows.items() if predicates is None or p in predicates]
    s = node(name, F.col(t.key)).alias("s")
    if len(rows) == 1:  # no generator: filters and pruning pass through
        out = df.select(s, rows[0].alias("r")).select("s", "r.*")
    elif rows:
        out = df.select(s, F.inline(F.array(*rows)))
    else:
        out = df.select(s, F.lit("").alias("p"), none.alias("o_kind"), none.alias("o"), none.alias("o_dtype")).where(F.lit(False))
    return out.where("o is not null").select(
        F.lit(EX + name).alias("ng"), F.lit("iri").alias("s_kind"), "s", "p", "o_kind", "o", "o_dtype",
        none.alias("o_lang"), F.lit(None).cast("array<string>").alias("o_members"), F.lit(None).cast("int").alias("member_idx"),
    )


def lower(spark: SparkSession, sf_dir: str, *names: str, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """The triples of several tables, one graph per table; of ``predicates`` alone, if given."""
    parts = [lower_frame(table(spark, sf_dir, n), n, predicates) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sql(*names: str) -> str:
    """The same triples as a DuckDB table expression ``triples AS (...)``."""
    parts = []
    for n in names:
        t = TABLES[n]
        s = f"'{EX}{n}#' || {t.key}"
        head = f"SELECT '{EX}{n}' AS ng, 'iri' AS s_kind, {s} AS s, "
        parts.append(f"{head}'{TYPE}' AS p, 'node' AS o_kind, '{SCHEMA_NS}{t.cls}' AS o, CAST(NULL AS VARCHAR) AS o_dtype FROM {n}")
        for c, kind in t.columns.items():
            if kind in TABLES:
                o, k, d = f"'{EX}{kind}#' || {c}", "node", "NULL"
            else:
                o, k, d = (f"printf('%.2f', {c})" if kind == "double" else f"CAST({c} AS VARCHAR)"), "lit", f"'{XSD}{kind}'"
            parts.append(f"{head}'{SCHEMA_NS}{c}', '{k}', {o}, {d} FROM {n} WHERE {c} IS NOT NULL")
    return "triples AS (" + " UNION ALL ".join(parts) + ")"
