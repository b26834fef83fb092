"""Recursive, versioning and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import SCHEMA_NS, lower, sql, table
from ..operators import graphs as G
from ..operators import revisions as R
from ..operators import search as X
from ..operators import validate as D
from ..operators.aggregates import framed_sql, tree_sql
from .registry import query

N = SCHEMA_NS
_IMPORTS = "e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region)"


def imports(spark, d):
    """Customers' graphs import their nation's, nations' their region's, regions' the world's."""
    of = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(x), F.col(a).cast("string")).alias("a"), F.concat(F.lit(y), F.col(b).cast("string")).alias("b"))
    top = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("a"), F.lit("world").alias("b"))
    return of("customer", "c_custkey", "c", "c_nationkey", "n").union(of("nation", "n_nationkey", "n", "n_regionkey", "r")).union(top).distinct()


def _numbered(spark, d):
    """Orders by customer and time: i counts them, p1 is the one before, p2 for every fifth the one three before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("i"), F.lag("o_orderkey").over(w).alias("p1"), F.lag("o_orderkey", 3).over(w).alias("p2"))
    return o.withColumn("p2", F.when(F.col("i") % 5 == 0, F.col("p2")))


def parents(spark, d):
    """Orders as commits (commit, parent, idx): the first parent is the customer's order before, every fifth has a second."""
    o = _numbered(spark, d)
    one = o.where("p1 is not null").select(F.col("o_orderkey").alias("commit"), F.col("p1").alias("parent"), F.lit(0).alias("idx"))
    return one.union(o.where("p2 is not null").select("o_orderkey", "p2", F.lit(1)))


def commits(spark, d):
    return R.all_parents(parents(spark, d))


_COMMITS = """o AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS i, lag(o_orderkey) OVER w AS p1, lag(o_orderkey, 3) OVER w AS p2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT o_orderkey AS a, p1 AS b FROM o WHERE p1 IS NOT NULL UNION SELECT o_orderkey, p2 FROM o WHERE i % 5 = 0 AND p2 IS NOT NULL)"""


@query("g01_cycles", "SELECT 'n' || n_nationkey AS node FROM nation WHERE n_nationkey < 3")
def g01(spark, d):
    ring = spark.createDataFrame([("n0", "n1"), ("n1", "n2"), ("n2", "n0")], "a string, b string")
    return G.cyclic(imports(spark, d).union(ring))


@query("d08_acyclic", "SELECT 'n' || n_nationkey AS graph, CASE WHEN n_nationkey < 3 THEN 'ImportCycle' ELSE 'ok' END AS finding FROM nation UNION ALL SELECT 'r' || r_regionkey, 'ok' FROM region")
def d08(spark, d):
    ring = spark.createDataFrame([("n0", "n1"), ("n1", "n2"), ("n2", "n0")], "a string, b string")
    found = D.acyclic(imports(spark, d).union(ring)).select("graph", "finding")
    every = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("graph")).union(table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))))
    return every.join(found, "graph", "left").select("graph", F.coalesce("finding", F.lit("ok")).alias("finding"))


@query("g02_closure", f"WITH RECURSIVE {_IMPORTS}, c AS (SELECT a, b, 1 AS depth FROM e UNION SELECT c.a, e.b, c.depth + 1 FROM c JOIN e ON c.b = e.a) SELECT a, b, CAST(min(depth) AS INT) AS depth FROM c GROUP BY a, b")
def g02(spark, d):
    return G.closure(imports(spark, d))


@query("g03_importers", f"WITH RECURSIVE {_IMPORTS}, c AS (SELECT 'r1' AS node UNION SELECT e.a FROM c JOIN e ON c.node = e.b) SELECT node FROM c")
def g03(spark, d):
    back = imports(spark, d).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return G.reach(back, spark.createDataFrame([("r1",)], "node string")).select("node")


def _two(spark, d):
    """The tenth and the eighth order of the first customer that has ten."""
    o = _numbered(spark, d)
    c = o.where("i = 10").agg(F.min("o_custkey")).first()[0]
    return tuple(o.where((F.col("o_custkey") == c) & (F.col("i") == i)).first()["o_orderkey"] for i in (10, 8))


_TWO = "k AS (SELECT min(o_custkey) AS c FROM o WHERE i = 10), xy AS (SELECT max(CASE WHEN i = 10 THEN o_orderkey END) AS x, max(CASE WHEN i = 8 THEN o_orderkey END) AS y FROM o WHERE o_custkey = (SELECT c FROM k))"
_UP = "SELECT {0} AS node, 0 AS depth FROM xy UNION SELECT e.b, u{0}.depth + 1 FROM u{0} JOIN {1} ON u{0}.node = e.a"


def _ancestor_sql(edges):
    return f"""WITH RECURSIVE {_COMMITS}, {_TWO}, ux AS ({_UP.format("x", edges)}), uy AS ({_UP.format("y", edges)}), m AS (SELECT x.node, min(x.depth) + min(y.depth) AS hops FROM ux x JOIN uy y USING (node) GROUP BY x.node)
SELECT node, CAST(hops AS INT) AS hops FROM m ORDER BY hops, node LIMIT 1"""


@query("g05_common_ancestor", _ancestor_sql("e"))
def g05(spark, d):
    return G.common_ancestor(commits(spark, d), *_two(spark, d))


@query("g05_first_parent_ancestor", _ancestor_sql("(SELECT o_orderkey AS a, p1 AS b FROM o WHERE p1 IS NOT NULL) e"))
def g05b(spark, d):
    return G.common_ancestor(R.first_parents(parents(spark, d)), *_two(spark, d))


@query("g06_ancestry", f"""WITH RECURSIVE {_COMMITS}, {_TWO}, ux AS ({_UP.format("x", "e")}), uy AS ({_UP.format("y", "e")}), z AS (SELECT min(o_orderkey) AS z FROM o WHERE o_custkey <> (SELECT c FROM k)),
r AS (SELECT y IN (SELECT node FROM ux) AS yx, x IN (SELECT node FROM uy) AS xy, z IN (SELECT node FROM ux) AS zx FROM xy, z) SELECT 'x_y' AS pair, CASE WHEN yx THEN 'newer' WHEN xy THEN 'older' ELSE 'diverged' END AS relation FROM r
UNION ALL SELECT 'y_x', CASE WHEN yx THEN 'older' WHEN xy THEN 'newer' ELSE 'diverged' END FROM r UNION ALL SELECT 'x_z', CASE WHEN zx THEN 'newer' ELSE 'diverged' END FROM r UNION ALL SELECT 'x_x', 'same'""")
def g06(spark, d):
    e, (x, y) = commits(spark, d), _two(spark, d)
    o = _numbered(spark, d)
    c = o.where(F.col("o_orderkey") == x).first()["o_custkey"]
    z = o.where(F.col("o_custkey") != c).agg(F.min("o_orderkey")).first()[0]
    one = lambda pair, a, b: G.ancestry(e, a, b).select(F.lit(pair).alias("pair"), "relation")
    return one("x_y", x, y).union(one("y_x", y, x)).union(one("x_z", x, z)).union(one("x_x", x, x))


@query("g07_history", f"WITH RECURSIVE {_COMMITS}, s AS (SELECT max(o_orderkey) AS k FROM o WHERE o_custkey = 1), c AS (SELECT k AS node, 0 AS depth FROM s UNION SELECT e.b, c.depth + 1 FROM c JOIN e ON c.node = e.a) SELECT node, CAST(min(depth) AS INT) AS depth FROM c GROUP BY node")
def g07(spark, d):
    tip = table(spark, d, "orders").where("o_custkey = 1").agg(F.max("o_orderkey").alias("node"))
    return G.reach(commits(spark, d), tip)


@query("g07_history_order", f"""WITH RECURSIVE {_COMMITS}, s AS (SELECT max(o_orderkey) AS k FROM o WHERE o_custkey = 1), c AS (SELECT k AS node FROM s UNION SELECT e.b FROM c JOIN e ON c.node = e.a)
SELECT node, row_number() OVER (ORDER BY o_orderdate DESC, node) - 1 AS row, CAST(o_orderkey % 5 = 0 AS INT) AS col FROM c JOIN orders ON o_orderkey = node""")
def g07b(spark, d):
    tip = table(spark, d, "orders").where("o_custkey = 1").agg(F.max("o_orderkey").alias("node"))
    when = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderdate").alias("ts"), F.expr("cast(o_orderkey % 5 = 0 as int)").alias("lane"))
    return G.timeline(G.reach(commits(spark, d), tip).join(when, "node"), "ts", "lane").select("node", "row", "col")


_PARTS = """e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 's' || l_suppkey || '-' || (l_partkey % 40) AS b FROM lineitem), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, min(c.component) FROM c JOIN u ON c.node = u.a JOIN recurring.c AS old ON old.node = u.b WHERE c.component < old.component GROUP BY u.b)"""


@query("g08_components", f"WITH RECURSIVE {_PARTS} SELECT node, component FROM c")
def g08(spark, d):
    li = table(spark, d, "lineitem")
    return G.components(li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("-"), (F.col("l_partkey") % 40).cast("string")).alias("b")))


@query("a09_component_sizes", f"WITH RECURSIVE {_PARTS} SELECT component, count(*) AS n FROM c GROUP BY component")
def a09(spark, d):
    return g08(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


_A, _B = "o_orderkey % 10 <> 0", "o_orderkey % 10 <> 1"


def _graphs(spark, d, where, bump):
    """One graph per customer, by a digest of its orders."""
    price = "CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END" if bump else "o_totalprice"
    o = table(spark, d, "orders").where(where).select(F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("ng"), F.format_string("%d=%.2f", "o_orderkey", F.expr(price)).alias("x"))
    return o.groupBy("ng").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), ",").cast("binary"), 256).alias("hash"))


def _graphs_sql(where, bump):
    price = "CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END" if bump else "o_totalprice"
    return f"SELECT 'g' || o_custkey AS ng, sha256(string_agg(x, ',' ORDER BY x)) AS hash FROM (SELECT o_custkey, o_orderkey || '=' || printf('%.2f', {price}) AS x FROM orders WHERE {where}) GROUP BY 1"


@query("j08_commit_diff", f"WITH a AS ({_graphs_sql(_A, False)}), b AS ({_graphs_sql(_B, True)}) SELECT ng, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b USING (ng) WHERE a.hash IS DISTINCT FROM b.hash")
def j08(spark, d):
    return R.graph_changes(_graphs(spark, d, _B, True), _graphs(spark, d, _A, False))


@query("v01_dataset_hash", f"WITH a AS ({_graphs_sql(_A, False)}), x AS (SELECT sha256({framed_sql('ng')} || {framed_sql('hash')}) AS d FROM a) {tree_sql('x', name='ds_hash')}")
def v01(spark, d):
    return R.dataset_hash(_graphs(spark, d, _A, False))


@query("a10_version_hash", f"""WITH r AS (SELECT 'ds' || c_nationkey AS ds, 'branch' AS kind, c_name AS name, c_custkey AS commit FROM customer), x AS (SELECT sha256({" || ".join(framed_sql(c) for c in ("ds", "kind", "name", "commit"))}) AS d FROM r
UNION ALL SELECT sha256({framed_sql("o_orderkey")} || {framed_sql("'h' || o_custkey")}) FROM orders) {tree_sql("x", name="version")}""")
def a10(spark, d):
    refs = table(spark, d, "customer").select(F.concat(F.lit("ds"), F.col("c_nationkey").cast("string")).alias("ds"), F.lit("branch").alias("kind"), F.col("c_name").alias("name"), F.col("c_custkey").alias("commit"))
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("ds_hash"))
    return R.version_hash(refs, own)


@query("v03_leaves", f"WITH {_COMMITS} SELECT o_orderkey AS commit FROM o WHERE o_orderkey NOT IN (SELECT b FROM e) AND o_custkey % 3 <> 0")
def v03(spark, d):
    p = parents(spark, d)
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), "o_custkey")
    tips = own.where("o_custkey % 3 = 0").select("commit")  # these customers' commits have branches
    return R.unnamed_leaves(own.select("commit"), p, tips)


@query("v05_commit_details", """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS i, lag(o_orderkey) OVER w AS p1, lag(o_orderkey, 3) OVER w AS p2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_graphs FROM orders GROUP BY o_custkey)
SELECT o_orderkey AS commit, concat_ws(',', CAST(p1 AS VARCHAR), CASE WHEN i % 5 = 0 THEN CAST(p2 AS VARCHAR) END) AS parents, n_graphs FROM o JOIN g USING (o_custkey)""")
def v05(spark, d):
    o = table(spark, d, "orders")
    own = o.select(F.col("o_orderkey").alias("commit"), F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("ds_hash"))
    graphs = o.select(F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("ds_hash"), F.col("o_orderpriority").alias("ng"))
    return R.commit_details(own, parents(spark, d), graphs).select("commit", "parents", "n_graphs")


@query("x01_search_documents", f"WITH {sql('nation', 'region')} SELECT ng AS graph_uri, string_agg(DISTINCT CASE WHEN p IN ('{N}n_name', '{N}r_name') THEN o END, '|' ORDER BY CASE WHEN p IN ('{N}n_name', '{N}r_name') THEN o END) AS label, '' AS id, count(*) FILTER (o_kind = 'lit') AS literals, count(DISTINCT s) AS node_count FROM triples GROUP BY ng")
def x01(spark, d):
    return X.documents(lower(spark, d, "nation", "region"), (f"{N}n_name", f"{N}r_name"))


@query("x03_document_type", "SELECT 'http://ex.org/nation#' || n_nationkey AS ng, 'part' AS doc_type FROM nation UNION ALL SELECT 'http://ex.org/region#' || r_regionkey, 'breakdown' FROM region UNION ALL SELECT 'all', '-' UNION ALL SELECT 'none', '-'")
def x03(spark, d):
    """A graph for each nation and region, one that has all nations, and one that has nothing of a known type."""
    slots = spark.createDataFrame([(f"{N}Nation", 0, "part"), (f"{N}Region", 1, "breakdown")], "cls string, slot int, doc_type string")
    t = lower(spark, d, "nation", "region")
    every = t.withColumn("ng", F.col("s")).unionByName(t.where(F.col("ng").endswith("nation")).withColumn("ng", F.lit("all")))
    return X.document_type(every.unionByName(lower(spark, d, "supplier").withColumn("ng", F.lit("none"))), slots)


@query("x04_id_conflicts", "SELECT c_mktsegment, c_nationkey, count(DISTINCT c_custkey) AS n_graphs FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) > 1")
def x04(spark, d):
    return X.id_conflicts(table(spark, d, "customer").withColumn("graph", F.col("c_custkey")), "c_mktsegment", "c_nationkey")


_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query("x08_match", f"SELECT doc_id FROM documents WHERE list_has_any({_TOK}, ['the', 'von'])")
def x08(spark, d):
    return X.match(table(spark, d, "documents"), "text", "The, von").select("doc_id")


@query("x09_query_string", f"SELECT doc_id FROM documents WHERE lang = 'en' AND list_contains({_TOK}, 'from') AND NOT list_contains({_TOK}, 'with')")
def x09(spark, d):
    return table(spark, d, "documents").where(X.condition("+lang:en +from -with", "text", ("lang", "source"))).select("doc_id")


@query("x07_query_limit", f"SELECT doc_id FROM documents WHERE list_contains({_TOK}, 'the') OR source = 'src1' ORDER BY doc_id LIMIT 10")
def x07(spark, d):
    return X.page(table(spark, d, "documents").where(X.condition("the source:src1", "text", ("lang", "source"))).select("doc_id"), ["doc_id"])


@query("p20_field_names", "SELECT unnest(['lang', 'source']) AS field")
def p20(spark, d):
    t = table(spark, d, "documents").select(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("fields"))
    return X.field_names(t, "fields")


@query("p19_datasets", "SELECT DISTINCT source AS ds FROM documents")
def p19(spark, d):
    refs = table(spark, d, "documents").select(F.col("source").alias("ds"), F.lit("branch").alias("kind"), F.col("lang").alias("name"), F.col("doc_id").cast("string").alias("commit"))
    return R.datasets(refs.union(spark.sql("select '', '', '', ''")))


@query("x10_id_values", f"WITH {sql('part')}, v AS (SELECT DISTINCT CAST(CAST(split_part(s, '#', 2) AS INT) % 7 AS VARCHAR) AS ng, p, o FROM triples WHERE p IN ('{N}p_brand', '{N}p_type')) SELECT ng, p, string_agg(o, '|' ORDER BY o) AS vals, count(*) AS n FROM v GROUP BY ng, p")
def x10(spark, d):
    t = lower(spark, d, "part", predicates=(f"{N}p_brand", f"{N}p_type")).withColumn("ng", (F.substring_index("s", "#", -1).cast("int") % 7).cast("string"))
    return X.id_values(t, (f"{N}p_brand", f"{N}p_type")).select("ng", "p", F.array_join("vals", "|").alias("vals"), F.size("vals").cast("bigint").alias("n"))


@query("x05_incremental", f"WITH {sql('customer')}, t AS (SELECT 'g' || (CAST(split_part(s, '#', 2) AS INT) % 10) AS g, * FROM triples) SELECT g AS graph_uri, string_agg(DISTINCT CASE WHEN p = '{N}c_mktsegment' THEN o END, '|' ORDER BY CASE WHEN p = '{N}c_mktsegment' THEN o END) AS label, count(*) FILTER (o_kind = 'lit') AS literals, count(DISTINCT s) AS node_count FROM t GROUP BY g")
def x05(spark, d):
    """Only changed graphs are derived anew; the others' documents stay."""
    t = lower(spark, d, "customer").withColumn("ng", F.concat(F.lit("g"), (F.substring_index("s", "#", -1).cast("int") % 10).cast("string")))
    labels = (f"{N}c_mktsegment",)
    old = X.documents(t.where(~F.col("ng").isin("g3", "g7")).unionByName(t.where((F.col("ng") == "g3") & (F.col("o_kind") == "lit"))), labels)
    changed = spark.createDataFrame([("g3",), ("g7",)], "ng string")
    return X.refreshed(old, t, changed, labels).select("graph_uri", "label", "literals", "node_count")
