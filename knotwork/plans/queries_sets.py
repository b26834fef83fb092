"""Set, mutation, list and merge queries over two revisions of the orders graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import EX, NIL, RDF, SCHEMA_NS, lower_frame, sql, table
from ..operators import lists as L
from ..operators import mutations as M
from ..operators import setops as U
from ..operators.patterns import match
from .queries_patterns import lists
from .registry import query

N = SCHEMA_NS
#: Revision B: other orders, and raised prices for every seventh.
_B = "o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority"
_ORDERS = sql("orders")
_REVS = f"""WITH a AS (WITH orders AS (SELECT * FROM main.orders WHERE o_orderkey % 10 <> 0), {_ORDERS} SELECT * FROM triples),
b AS (WITH orders AS (SELECT {_B} FROM main.orders WHERE o_orderkey % 10 <> 1), {_ORDERS} SELECT * FROM triples)"""


def revisions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    b = o.where("o_orderkey % 10 <> 1").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"))
    return lower_frame(o.where("o_orderkey % 10 <> 0"), "orders"), lower_frame(b, "orders")


@query("u01_union", _REVS + " SELECT s, p, o FROM a UNION SELECT s, p, o FROM b")
def u01(spark, d):
    return U.union(*revisions(spark, d)).select("s", "p", "o")


@query("u03_equal", _REVS + " SELECT 'a_b' AS pair, ng, false AS equal FROM a GROUP BY ng UNION ALL SELECT 'a_a', ng, true FROM a GROUP BY ng")
def u03(spark, d):
    a, b = revisions(spark, d)
    return U.equal(a, b).select(F.lit("a_b").alias("pair"), "ng", "equal").union(U.equal(a, a).select(F.lit("a_a"), "ng", "equal"))


@query("u04_diff", _REVS + " SELECT -1 AS flag, s, p, o FROM (SELECT s, p, o FROM a EXCEPT SELECT s, p, o FROM b) UNION ALL SELECT 1, s, p, o FROM (SELECT s, p, o FROM b EXCEPT SELECT s, p, o FROM a)")
def u04(spark, d):
    return U.diff(*revisions(spark, d)).select("flag", "s", "p", "o")


@query("s14_patch", _REVS + " SELECT s, p, o, o_kind FROM b")
def s14(spark, d):
    a, b = revisions(spark, d)
    return U.patch(a, U.diff(a, b)).select("s", "p", "o", "o_kind")


@query("u05_import_diff", """WITH a AS (SELECT DISTINCT 'c' || o_custkey AS importer, 's' || o_orderstatus AS imported FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT DISTINCT 'c' || o_custkey AS importer, 's' || o_orderstatus AS imported FROM orders WHERE o_orderkey % 10 <> 1)
SELECT importer, imported, CAST(b.i IS NOT NULL AS INT) - CAST(a.i IS NOT NULL AS INT) AS flag FROM (SELECT *, 1 AS i FROM a) a FULL JOIN (SELECT *, 1 AS i FROM b) b USING (importer, imported)""")
def u05(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("importer"), F.concat(F.lit("s"), "o_orderstatus").alias("imported"))
    return U.import_diff(e.where("o_orderkey % 10 <> 0").drop("o_orderkey"), e.where("o_orderkey % 10 <> 1").drop("o_orderkey"))


@query("u06_node_diff", _REVS + ", x AS (SELECT s, count(*) AS n FROM a GROUP BY s), y AS (SELECT s, count(*) AS n FROM b GROUP BY s) SELECT s, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta FROM x FULL JOIN y USING (s)")
def u06(spark, d):
    return U.node_diff(*revisions(spark, d))


@query("u07_duplicates", "SELECT 'http://ex.org/c#' || c_nationkey AS s, c_mktsegment AS o, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def u07(spark, d):
    t = table(spark, d, "customer").select(F.lit("g").alias("ng"), F.concat(F.lit("http://ex.org/c#"), F.col("c_nationkey").cast("string")).alias("s"), F.lit("p").alias("p"), F.lit("lit").alias("o_kind"), F.col("c_mktsegment").alias("o"))
    return U.duplicates(t).select("s", "o", "n")


_TAGGED = "a AS (SELECT doc_id, CAST(md5(text) AS VARCHAR) AS o, lang FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, o, CASE WHEN doc_id % 4 = 0 THEN 'xx' ELSE lang END AS lang FROM a)"


def _tagged(spark, d):
    """Texts as language-tagged literals; in revision B every fourth has another language and nothing else changes."""
    t = table(spark, d, "documents").where("text is not null")
    a = t.select(F.lit(f"{EX}texts").alias("ng"), F.lit("iri").alias("s_kind"), F.concat(F.lit(f"{EX}doc#"), F.col("doc_id").cast("string")).alias("s"), F.lit(f"{N}text").alias("p"), F.lit("lit").alias("o_kind"), F.md5("text").alias("o"), F.lit(f"{RDF}langString").alias("o_dtype"), F.col("lang").alias("o_lang"))
    return a, a.withColumn("o_lang", F.when(F.substring_index("s", "#", -1).cast("bigint") % 4 == 0, "xx").otherwise(F.col("o_lang")))


@query("u04_diff_languages", f"WITH {_TAGGED} SELECT flag, doc_id, lang FROM (SELECT -1 AS flag, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 1, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
def u04b(spark, d):
    return U.diff(*_tagged(spark, d)).select("flag", F.substring_index("s", "#", -1).cast("bigint").alias("doc_id"), F.col("o_lang").alias("lang"))


_LISTED = "a AS (SELECT l_orderkey AS k, l_partkey AS o, l_linenumber AS i FROM lineitem), b AS (SELECT k, o, CASE WHEN k % 3 = 0 THEN 100 - i ELSE i END AS i FROM a)"


def _listed(spark, d):
    """Lists of parts; in revision B those of every third order run the other way."""
    a = lists(spark, d)
    return a, a.withColumn("member_idx", F.when(F.substring("s", 4, 20).cast("bigint") % 3 == 0, 100 - F.col("member_idx")).otherwise(F.col("member_idx")))


@query("u04_diff_lists", f"WITH {_LISTED} SELECT flag, k, o, i FROM (SELECT -1 AS flag, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 1, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
def u04c(spark, d):
    out = U.diff(*_listed(spark, d))
    return out.select("flag", F.substring("s", 4, 20).cast("bigint").alias("k"), F.substring_index("o", "#", -1).cast("bigint").alias("o"), F.col("member_idx").alias("i"))


@query("s14_patch_lists", f"WITH {_LISTED} SELECT DISTINCT k, o, i FROM b")
def s14b(spark, d):
    a, b = _listed(spark, d)
    return U.patch(a.distinct(), U.diff(a, b)).select(F.substring("s", 4, 20).cast("bigint").alias("k"), F.substring_index("o", "#", -1).cast("bigint").alias("o"), F.col("member_idx").alias("i"))


@query("u01_union_lists", f"WITH {_LISTED} SELECT k, o, i FROM a UNION SELECT k, o, i FROM b")
def u01b(spark, d):
    return U.union(*_listed(spark, d)).select(F.substring("s", 4, 20).cast("bigint").alias("k"), F.substring_index("o", "#", -1).cast("bigint").alias("o"), F.col("member_idx").alias("i"))


@query("u03_equal_lists", "SELECT l_orderkey % 5 AS g, bool_and(l_orderkey % 3 <> 0 OR 100 - l_linenumber = l_linenumber) AS equal FROM lineitem GROUP BY 1")
def u03b(spark, d):
    a, b = (t.withColumn("ng", (F.substring("s", 4, 20).cast("bigint") % 5).cast("string")) for t in _listed(spark, d))
    return U.equal(a, b).select(F.col("ng").cast("bigint").alias("g"), "equal")


@query("u08_missing", "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE lang <> 'en' AND text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def u08(spark, d):
    t = table(spark, d, "documents").select("lang", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return U.missing(t.where("lang <> 'en'"), t.where("lang = 'en'")).select("hash").distinct()


def _stages(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("g"), F.col("n_nationkey").cast("string")).alias("ng"))
    s = n.select("ng", F.expr("n_nationkey % 5 = 0").alias("is_referenced"), F.expr("concat('h', n_nationkey % 4)").alias("hash"), F.expr("concat('c', n_nationkey % 3)").alias("commit"), F.expr("concat('c', n_nationkey % 2)").alias("base"), F.expr("n_nationkey % 2 = 0").alias("modified"))
    t = n.where("n_nationkey % 6 <> 0").select("ng", F.expr("n_nationkey % 7 = 0").alias("is_referenced"), F.expr("concat('h', n_nationkey % 8)").alias("hash"), F.expr("concat('c', n_nationkey % 4)").alias("commit"), F.expr("concat('c', n_nationkey % 5)").alias("base"), F.expr("n_nationkey % 3 = 0").alias("modified"))
    return s, t


@query("u02_merge_actions", """WITH x AS (SELECT n_nationkey AS k, n_nationkey % 6 <> 0 AS here, k % 5 = 0 AS sr, k % 4 AS sh, k % 3 AS sc, k % 2 AS sb, k % 2 = 0 AS sm, k % 7 = 0 AS tr, k % 8 AS th, k % 4 AS tc, k % 5 AS tb, k % 3 = 0 AS tm FROM nation)
SELECT 'g' || k AS ng, CASE WHEN NOT here THEN CASE WHEN sr THEN 'redirect' ELSE 'move' END WHEN sr THEN 'union' WHEN tr THEN 'promote' WHEN sh = th THEN 'keep' WHEN sc = tc AND sm AND tm THEN 'union'
WHEN sc = tc THEN CASE WHEN sm THEN 'replace' ELSE 'keep' END WHEN tb = sc THEN 'keep' WHEN sb = tc THEN 'replace' ELSE 'union' END AS action FROM x""")
def u02(spark, d):
    return U.merge_actions(*_stages(spark, d))


@query("u10_merge", _REVS + " SELECT s, p, o FROM a UNION SELECT s, p, o FROM b")
def u10(spark, d):
    a, b = revisions(spark, d)
    act = a.select("ng").distinct().withColumn("action", F.lit("union"))
    return U.merge(a, b, act).select("s", "p", "o")


@query("m03_add", _REVS + " SELECT count(*) AS n FROM (SELECT s, p, o FROM a UNION SELECT s, p, o FROM b)")
def m03(spark, d):
    a, b = revisions(spark, d)
    return M.add(a, b).agg(F.count(F.lit(1)).alias("n"))


_CN = f"WITH {sql('customer', 'nation')}"


def _cn(spark, d):
    from ..model import lower

    return lower(spark, d, "customer", "nation")


@query("m04_delete_node", f"{_CN} SELECT s, p, o FROM triples WHERE NOT (s = '{EX}nation#3' OR p = '{EX}nation#3' OR (o_kind = 'node' AND o = '{EX}nation#3'))")
def m04(spark, d):
    return M.delete_node(_cn(spark, d), f"{EX}nation#3").select("s", "p", "o")


@query("m05_delete_triples", f"{_CN} SELECT s, p, o FROM triples WHERE s <> '{EX}nation#3'")
def m05(spark, d):
    return M.delete_triples(_cn(spark, d), f"{EX}nation#3").select("s", "p", "o")


@query("m06_delete_where", f"{_CN} SELECT s, p, o FROM triples WHERE NOT (s = '{EX}nation#3' AND o_kind = 'lit')")
def m06(spark, d):
    return M.delete_where(_cn(spark, d), f"{EX}nation#3", F.col("o_kind") == "lit").select("s", "p", "o")


@query("m07_rename", f"""{_CN} SELECT CASE WHEN s = '{EX}nation#3' THEN '{EX}moved' ELSE ng END AS ng, CASE WHEN s = '{EX}nation#3' THEN '{EX}moved#3' ELSE s END AS s, p,
CASE WHEN o_kind = 'node' AND o = '{EX}nation#3' THEN '{EX}moved#3' ELSE o END AS o FROM triples""")
def m07(spark, d):
    names = spark.createDataFrame([(f"{EX}nation#3", f"{EX}moved#3", f"{EX}moved")], "old string, new string, ng string")
    return M.rename(_cn(spark, d), names).select("ng", "s", "p", "o")


@query("m08_add_imports", "SELECT 'n' || n_nationkey AS importer, 'r' || n_regionkey AS imported FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region")
def m08(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    one = n.select(F.concat(F.lit("n"), n["n_nationkey"].cast("string")).alias("importer"), F.concat(F.lit("r"), n["n_regionkey"].cast("string")).alias("imported"))
    return M.add_imports(one, r.select(F.concat(F.lit("r"), r["r_regionkey"].cast("string")).alias("importer"), F.lit("world").alias("imported")))


@query("m09_empty_graph", f"{_CN} SELECT s, p, o FROM triples WHERE ng <> '{EX}nation'")
def m09(spark, d):
    return M.empty_graph(_cn(spark, d), f"{EX}nation").select("s", "p", "o")


@query("m09_still_referenced", f"{_CN} SELECT DISTINCT s AS node FROM triples WHERE ng = '{EX}nation' AND s IN (SELECT o FROM triples WHERE ng <> '{EX}nation' AND o_kind = 'node')")
def m09b(spark, d):
    return M.dangling_after_empty(_cn(spark, d), f"{EX}nation")


@query("m10_delete_graph", "SELECT 'r' || r_regionkey AS ng, r_regionkey = 9 AS is_referenced, r_regionkey = 9 AS deleted FROM region UNION ALL SELECT 'x', true, true")
def m10(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    g = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ng")).union(spark.sql("select 'x'")).withColumn("is_referenced", F.lit(False)).withColumn("deleted", F.lit(False))
    i = n.select(F.lit("n").alias("importer"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("imported")).union(spark.sql("select 'y', 'z'"))
    return M.delete_graph(M.delete_graph(g, i, "x"), i, "r1")


@query("c01_build", "SELECT '_:l' || l_orderkey AS node, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS member_idx, CAST(l_partkey AS VARCHAR) AS o FROM lineitem")
def c01(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    own = li.select(F.concat(F.lit("_:l"), F.col("l_orderkey").cast("string")).alias("owner"), F.transform("m", lambda x: x["l_partkey"].cast("string")).alias("m"))
    return L.build(own, "owner", "m")


@query("c02_members", "SELECT '_:l' || l_orderkey AS node, string_agg('part#' || l_partkey, ' ' ORDER BY l_linenumber, 'part#' || l_partkey) AS members, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1")
def c02(spark, d):
    return L.members(lists(spark, d)).select("node", F.array_join(F.transform("members", lambda m: F.replace(m, F.lit(EX), F.lit(""))), " ").alias("members"), "n")


@query("c02_member_at", "SELECT '_:l' || l_orderkey AS node, 'http://ex.org/part#' || l_partkey AS o FROM lineitem WHERE l_linenumber = 2")
def c02b(spark, d):
    return L.member_at(lists(spark, d), 2).select("node", "o")


@query("c03_set_members", "SELECT '_:l' || l_orderkey AS s, 'http://ex.org/part#' || l_partkey AS o, CAST(l_linenumber AS INT) AS member_idx FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT DISTINCT '_:l' || l_orderkey, 'x', 1 FROM lineitem WHERE l_orderkey % 5 = 0")
def c03(spark, d):
    t = lists(spark, d)
    new = t.where("cast(substring(s, 4) as bigint) % 5 = 0").select("ng", "s_kind", "s", "p", F.lit("lit").alias("o_kind"), F.lit("x").alias("o"), "o_dtype", "o_lang", "o_members", F.lit(1).alias("member_idx")).distinct()
    return L.set_members(t, new).select("s", "o", "member_idx")


def chains(spark, d):
    """Each order's lines as a chain of rdf:first/rest cells."""
    from pyspark.sql.window import Window

    from ..model import FIRST, NIL, REST

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    i = F.row_number().over(w)
    li = table(spark, d, "lineitem").select("l_orderkey", i.alias("i"), "l_partkey", F.when(F.lead("l_partkey").over(w).isNotNull(), i + 1).alias("next"))
    cell = lambda n: F.concat(F.lit("_:l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col(n).cast("string"))
    rows = F.array(
        F.struct(F.lit(FIRST).alias("p"), F.lit("lit").alias("o_kind"), F.col("l_partkey").cast("string").alias("o"), F.lit("http://www.w3.org/2001/XMLSchema#integer").alias("o_dtype")),
        F.struct(F.lit(REST).alias("p"), F.lit("node").alias("o_kind"), F.coalesce(cell("next"), F.lit(NIL)).alias("o"), F.lit(None).cast("string").alias("o_dtype")),
    )
    return li.select(F.lit(f"{EX}chains").alias("ng"), cell("i").alias("s"), F.inline(rows))


@query("c06_collapse", """SELECT '_:l' || l_orderkey || '-1' AS node, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS member_idx,
CAST(l_partkey AS VARCHAR) AS o FROM lineitem""")
def c06(spark, d):
    return L.collapse(chains(spark, d)).select("node", "member_idx", "o")


@query("c06_endless", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY l_orderkey")
def c06c(spark, d):
    """Every tenth order's chain ends in its own first cell: none of it is a list."""
    t = chains(spark, d)
    k = F.regexp_extract("s", "l([0-9]+)-", 1).cast("bigint")
    ring = t.withColumn("o", F.when((F.col("o") == NIL) & (k % 10 == 0), F.regexp_replace("s", "-[0-9]+$", "-1")).otherwise(F.col("o")))
    found = L.endless(ring).select(F.regexp_extract("cell", "l([0-9]+)-", 1).cast("bigint").alias("l_orderkey"))
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("c06_homogeneous", "SELECT '_:l' || l_orderkey || '-1' AS node, 'litcoll' AS kind, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def c06b(spark, d):
    return L.homogeneous(L.collapse(chains(spark, d))).select("node", "kind", "n")


@query("c07_inline", "SELECT '_:l' || l_orderkey || '-' || i AS node FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem) WHERE i > 1")
def c07(spark, d):
    return L.inline_nodes(chains(spark, d))


@query("c08_render", "SELECT l_orderkey, '( ' || string_agg(CAST(l_quantity AS INT), ' ' ORDER BY l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR)) || ' )' AS text FROM lineitem GROUP BY l_orderkey")
def c08(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("q")))).alias("m"))
    return m.select("l_orderkey", L.rendered(F.transform("m", lambda x: x["q"])).alias("text"))


@query("p03_match_predicate", f"{_CN} SELECT s, o FROM triples WHERE p = '{N}c_nationkey' AND o = '{EX}nation#1'")
def p03b(spark, d):
    return match(_cn(spark, d), p=f"{N}c_nationkey", o=f"{EX}nation#1").select("s", "o")
