"""Ontology and validation queries: the data is lowered tables, the ontology a small one over their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import EX, OWL, RDF, RDFS, SCHEMA_NS, TYPE, XSD, lower, sql
from ..operators import validate as D
from ..operators import vocab as V
from .registry import query

N = SCHEMA_NS
#: (subject, predicate, object) of the ontology. Place and Party are above the tables' classes.
ONTOLOGY = [
    *((c, "type", f"{RDFS}Class") for c in ("Region", "Nation", "Customer", "Supplier", "Party", "Place", "Thing")),
    ("Nation", "sub", "Place"), ("Region", "sub", "Place"), ("Customer", "sub", "Party"), ("Supplier", "sub", "Party"), ("Place", "sub", "Thing"), ("Party", "sub", "Thing"),
    *((p, "type", f"{RDF}Property") for p in ("home", "c_nationkey", "s_nationkey", "n_regionkey", "name", "n_name", "r_name", "c_name", "c_acctbal")),
    ("c_nationkey", "subp", "home"), ("s_nationkey", "subp", "home"), ("n_name", "subp", "name"), ("r_name", "subp", "name"), ("c_name", "subp", "name"),
    ("home", "type", f"{OWL}FunctionalProperty"), ("name", "type", f"{OWL}InverseFunctionalProperty"), ("home", "domain", "Party"), ("home", "range", "Place"), ("name", "range", f"{XSD}string"),
    ("n_regionkey", "domain", "Nation"), ("n_regionkey", "range", "Nation"), ("c_acctbal", "range", f"{XSD}integer"), ("home", "inverse", "homeOf"), ("homeOf", "type", f"{RDF}Property"),
]
_P = {"type": TYPE, "sub": V.SUB_CLASS, "subp": V.SUB_PROPERTY, "domain": V.DOMAIN, "range": V.RANGE, "inverse": V.INVERSE}
_FULL = [(N + s, _P[p], o if ":" in o else N + o) for s, p, o in ONTOLOGY]
_ONT = "ont AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in _FULL) + ") v(s, p, o))"
_KINDS = f"""{_ONT}, edges AS (SELECT s AS a, o AS b FROM ont WHERE p IN ('{V.SUB_CLASS}', '{V.SUB_PROPERTY}')), clo AS (SELECT a AS sub, a AS kind, 0 AS depth FROM (SELECT a FROM edges UNION SELECT b FROM edges)
UNION SELECT clo.sub, edges.b, clo.depth + 1 FROM clo JOIN edges ON clo.kind = edges.a), kinds AS (SELECT sub, kind, CAST(min(depth) AS INT) AS depth FROM clo GROUP BY sub, kind),
el AS (SELECT s AS element, bool_or(p = '{TYPE}' AND o = '{RDFS}Class') AS is_class, bool_or(p = '{TYPE}' AND o <> '{RDFS}Class') AS is_property FROM ont GROUP BY s)"""
DATA = ("customer", "supplier", "nation", "region")


def ontology(spark):
    return spark.createDataFrame([(EX + "ont", *x) for x in _FULL], "ng string, s string, p string, o string")


def _all(spark):
    o = ontology(spark)
    return V.elements(o), V.kinds(o)


@query("o01_elements", f"WITH {_ONT} SELECT s AS element, bool_or(p = '{TYPE}' AND o = '{RDFS}Class') AS is_class, bool_or(p = '{TYPE}' AND o <> '{RDFS}Class') AS is_property, min(CASE WHEN p = '{V.DOMAIN}' THEN o END) AS domain, min(CASE WHEN p = '{V.RANGE}' THEN o END) AS range FROM ont GROUP BY s")
def o01(spark, d):
    return V.elements(ontology(spark)).select("element", "is_class", "is_property", "domain", "range")


@query("o05_kinds", f"WITH RECURSIVE {_KINDS} SELECT sub, kind, depth FROM kinds")
def o05(spark, d):
    return V.kinds(ontology(spark))


@query("g12_inherited", f"""WITH RECURSIVE {_KINDS}, dr AS (SELECT s, max(CASE WHEN p = '{V.DOMAIN}' THEN o END) AS dom, max(CASE WHEN p = '{V.RANGE}' THEN o END) AS rng FROM ont GROUP BY s)
SELECT sub AS element, arg_min(dom, depth) FILTER (dom IS NOT NULL) AS domain, arg_min(rng, depth) FILTER (rng IS NOT NULL) AS range FROM kinds JOIN dr ON s = kind JOIN el ON element = kind AND is_property GROUP BY sub""")
def g12(spark, d):
    e, k = _all(spark)
    return V.inherited(e, k)


@query("o02_inverses", f"SELECT '{N}home' AS element, '{N}homeOf' AS inverse_of, '{N}Party' AS domain, '{N}Place' AS range UNION ALL SELECT '{N}homeOf', '{N}home', '{N}Place', '{N}Party'")
def o02(spark, d):
    return V.symmetric_inverse(V.elements(ontology(spark))).where("inverse_of is not null")


@query("p13_of_kind", f"WITH {sql(*DATA)} SELECT DISTINCT s AS node FROM triples WHERE p = '{TYPE}' AND o IN ('{N}Customer', '{N}Supplier', '{N}Party')")
def p13(spark, d):
    return V.of_kind(lower(spark, d, *DATA), V.kinds(ontology(spark)), f"{N}Party").select("node")


@query("p14_main_type", f"WITH {sql(*DATA)} SELECT s, o AS main_type FROM triples WHERE p = '{TYPE}'")
def p14(spark, d):
    t = lower(spark, d, *DATA)
    more = t.where(f"p = '{TYPE}' and o in ('{N}Customer', '{N}Supplier')").withColumn("o", F.lit(f"{N}Party"))
    main = ontology(spark).where(F.col("o") == f"{RDFS}Class").select(F.col("s").alias("cls"))
    return V.main_types(t.unionByName(more), V.kinds(ontology(spark)), main).select("s", "main_type")


@query("p15_in_vocabulary", f"WITH {_ONT}, {sql(*DATA)}, u AS (SELECT p AS element FROM triples UNION SELECT o FROM triples WHERE p = '{TYPE}') SELECT element, element IN (SELECT s FROM ont) AS known FROM u")
def p15(spark, d):
    return V.known(lower(spark, d, *DATA), V.elements(ontology(spark)))


@query("k04_depth_order", f"WITH RECURSIVE {_KINDS} SELECT sub, max(depth) AS level FROM kinds GROUP BY sub")
def k04(spark, d):
    return V.depth_order(V.kinds(ontology(spark)))


def _typed(spark, d):
    """Data in which some nodes have no type and some an unknown one."""
    t = lower(spark, d, "customer", "nation", "region")
    key = F.substring_index("s", "#", -1).cast("int")
    t = t.where(~((F.col("ng") == f"{EX}customer") & (F.col("p") == TYPE) & (key % 50 == 0)))
    return t.withColumn("o", F.when((F.col("ng") == f"{EX}customer") & (F.col("p") == TYPE) & (key % 60 == 1), F.lit(f"{N}Ghost")).otherwise(F.col("o")))


@query("d01_types", f"SELECT '{EX}customer#' || c_custkey AS subject, CASE WHEN c_custkey % 50 = 0 THEN 'RdfType_missing' ELSE 'RdfType_wrong' END AS rule FROM customer WHERE c_custkey % 50 = 0 OR c_custkey % 60 = 1")
def d01(spark, d):
    return D.types(_typed(spark, d), V.elements(ontology(spark))).select("subject", "rule")


def _findings(spark, d):
    e, k = _all(spark)
    return D.domain_and_range(lower(spark, d, "customer", "nation", "region"), e, V.inherited(e, k).unionByName(e.where("is_property").join(k.select(F.col("sub").alias("element")), "element", "left_anti").select("element", "domain", "range")), k)


@query("d02_domain_and_range", f"""SELECT 'predicate_unknown' AS rule, '{N}c_mktsegment' AS predicate, count(*) AS n FROM customer UNION ALL
SELECT 'range_mismatch', '{N}n_regionkey', count(*) FROM nation UNION ALL SELECT 'range_mismatch', '{N}c_acctbal', count(*) FROM customer""")
def d02(spark, d):
    return _findings(spark, d).groupBy("rule", "predicate").agg(F.count(F.lit(1)).alias("n"))


def _twice(spark, d):
    t = lower(spark, d, "customer", "nation")
    more = t.where((F.col("p") == f"{N}c_nationkey") & (F.substring_index("s", "#", -1).cast("int") % 3 == 0)).withColumn("p", F.lit(f"{N}home")).withColumn("o", F.lit(f"{EX}nation#99"))
    return t.unionByName(more)


@query("d03_functional", f"SELECT '{EX}customer#' || c_custkey AS subject, '{N}home' AS predicate FROM customer WHERE c_custkey % 3 = 0")
def d03(spark, d):
    return D.functional(_twice(spark, d), *_all(spark)).select("subject", "predicate")


@query("d04_inverse_functional", f"SELECT 'x' || c_mktsegment AS object, '{N}name' AS predicate FROM customer GROUP BY c_mktsegment HAVING count(*) > 1")
def d04(spark, d):
    t = lower(spark, d, "customer").where(F.col("p") == f"{N}c_mktsegment").withColumn("p", F.lit(f"{N}c_name")).withColumn("o", F.concat(F.lit("x"), "o"))
    return D.functional(t, *_all(spark), inverse=True).select("object", "predicate")


@query("d06_valid_properties", f"SELECT '{N}mine' AS property, true AS valid UNION ALL SELECT '{N}other', false")
def d06(spark, d):
    mine = spark.createDataFrame([("x", f"{N}mine", TYPE, f"{RDF}Property"), ("x", f"{N}mine", V.SUB_PROPERTY, f"{N}c_name"), ("x", f"{N}other", TYPE, f"{RDF}Property")], "ng string, s string, p string, o string")
    o = ontology(spark)
    return D.valid_properties(mine, V.kinds(o.union(mine)), V.elements(o).where("is_property").select("element"))


@query("d07_classify", f"WITH {_ONT} SELECT s AS node, CASE WHEN bool_or(o = '{RDFS}Class') THEN 'class' ELSE 'property' END AS what FROM ont WHERE p = '{TYPE}' GROUP BY s")
def d07(spark, d):
    o = ontology(spark)
    return D.classify(o, V.elements(o))


@query("d10_report", "SELECT 'error' AS level, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0 OR c_custkey % 60 = 1) AS n UNION ALL SELECT 'warning', count(*) FROM customer")
def d10(spark, d):
    found = D.report(_findings(spark, d), D.types(_typed(spark, d), V.elements(ontology(spark))))
    return D.summary(found).groupBy("level").agg(F.sum("n").alias("n"))


@query("a08_summary", f"SELECT '{EX}nation' AS ng, 'error' AS level, count(*) AS n FROM nation UNION ALL SELECT '{EX}customer', 'error', count(*) FROM customer UNION ALL SELECT '{EX}customer', 'warning', count(*) FROM customer")
def a08(spark, d):
    return D.summary(_findings(spark, d))


@query("d10_passed", "SELECT false AS passed")
def d10b(spark, d):
    return D.passed(_findings(spark, d))


@query("p22_of_unknown_type", f"WITH {_ONT}, {sql('orders')} SELECT o AS cls, count(*) AS n FROM triples WHERE p = '{TYPE}' AND o NOT IN (SELECT s FROM ont) GROUP BY o")
def p22b(spark, d):
    t = lower(spark, d, "orders").where(F.col("p") == TYPE)
    return t.join(ontology(spark).select(F.col("s").alias("o")).distinct(), "o", "left_anti").groupBy(F.col("o").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
