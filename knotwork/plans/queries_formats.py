"""Queries over files, converters, streams, and what changes whole graphs: their input is made from the tables, as text where files are meant."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import EX, OWL, RDF, RDFS, SCHEMA_NS, TYPE, XSD, conform, lower, sql, table
from ..operators import convert as C
from ..operators import graphs as G
from ..operators import index_mapping as I
from ..operators import lists as L
from ..operators import mutations as M
from ..operators import search as X
from ..operators import setops as U
from ..operators import vocab as V
from ..operators.revisions import Repository
from ..sources import graphfiles, ontologies, p21, turtle, xmltree
from ..streaming import follow
from .queries_repository import _folder
from .registry import query

N = SCHEMA_NS
_NR = ("nation", "region")


@query("s06_turtle_round_trip", f"WITH {sql(*_NR)} SELECT ng, s, p, o, coalesce(o_dtype, '') AS o_dtype FROM triples")
def s06(spark, d):
    """Written as Turtle, read again."""
    at, t = _folder(spark), lower(spark, d, *_NR)
    turtle.write(t, at, turtle.PREFIXES | {"s": N, "n": f"{EX}nation#"})
    return turtle.read(spark, f"{at}/*/*.txt").select("ng", "s", "p", "o", F.coalesce("o_dtype", F.lit("")).alias("o_dtype"))


@query("s07_trig_round_trip", f"WITH {sql(*_NR)} SELECT ng, s, p, o FROM triples")
def s07(spark, d):
    at, t = _folder(spark), lower(spark, d, *_NR)
    turtle.write_trig(t, at)
    return turtle.read(spark, f"{at}/*.txt", trig=True).select("ng", "s", "p", "o")


@query("s08_graph_files", f"WITH {sql(*_NR)} SELECT ng, s, p, o FROM triples")
def s08(spark, d):
    at = _folder(spark)
    graphfiles.write(lower(spark, d, *_NR), at)
    return graphfiles.read(spark, at).select("ng", "s", "p", "o")


@query("s11_one_graph_file", f"WITH {sql('region')} SELECT s, p, o, translate(to_base64(encode('{EX}region')), '+/', '-_') AS file FROM triples")
def s11(spark, d):
    """One graph's file alone, by the name that its header has."""
    at = _folder(spark)
    graphfiles.write(lower(spark, d, *_NR), at)
    h = graphfiles.headers(spark, at).where(F.col("ng") == f"{EX}region").select("ng", "file")
    return graphfiles.read(spark, at, f"{EX}region").join(h, "ng").select("s", "p", "o", "file")


@query("s13_headers", f"WITH {sql(*_NR)} SELECT ng, count(*) AS n_triples, CAST(0 AS BIGINT) AS damaged FROM triples GROUP BY ng")
def s13(spark, d):
    at = _folder(spark)
    graphfiles.write(lower(spark, d, *_NR), at)
    bad = graphfiles.damaged(spark, at).agg(F.count(F.lit(1)).alias("damaged"))
    return graphfiles.headers(spark, at).select("ng", "n_triples").crossJoin(bad)  # one row


_ENTITIES = "VALUES ('NATION', 0, 'p_name'), ('NATION', 1, 'p_region'), ('REGION', 0, 'p_name')"


def _exchange(spark, d):
    """One exchange file for each region, with its nations and their customers."""
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    line = lambda k, text: F.struct(k.cast("long").alias("k"), text.alias("t"))
    rows = [
        r.select("r_regionkey", line(F.col("r_regionkey") + 1, F.format_string("#%d=REGION('%s');", F.col("r_regionkey") + 1, "r_name")).alias("l")),
        n.select(F.col("n_regionkey").alias("r_regionkey"), line(F.col("n_nationkey") + 100, F.format_string("#%d = NATION ( 'it''s (%s); ' , #%d /* up */ );", F.col("n_nationkey") + 100, "n_name", F.col("n_regionkey") + 1)).alias("l")),
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"), line(F.col("c_custkey") + 1000, F.format_string("#%d=(PARTY($,.T.)CUSTOMER((%d,%d),#%d,%.2f));", F.col("c_custkey") + 1000, F.col("c_custkey").cast("int"), F.lit(7), F.col("c_nationkey") + 100, F.col("c_acctbal"))).alias("l")),
    ]
    every = rows[0].union(rows[1]).union(rows[2])
    data = every.groupBy("r_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\n").alias("data"))
    head = F.lit("ISO-10303-21;\nHEADER;\nFILE_NAME('x;y','',(''),(''),'','','');\nENDSEC;\nDATA;\n")
    return data.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("file"), F.concat(head, "data", F.lit("\nENDSEC;\nEND-ISO-10303-21;\n")).alias("text"))


@query("s22_p21_instances", """SELECT 'r' || r_regionkey AS file, r_regionkey + 1 AS id, 'REGION' AS entity, 1 AS n FROM region UNION ALL SELECT 'r' || n_regionkey, n_nationkey + 100, 'NATION', 2 FROM nation
UNION ALL SELECT 'r' || n_regionkey, c_custkey + 1000, 'PARTY', 2 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'r' || n_regionkey, c_custkey + 1000, 'CUSTOMER', 3 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def s22(spark, d):
    return p21.parse(_exchange(spark, d)).select("file", "id", "entity", F.size("args").alias("n"))


@query("k02_attribute_values", """WITH c AS (SELECT 'r' || n_regionkey AS file, c_custkey + 1000 AS id, * FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'r' || r_regionkey AS file, r_regionkey + 1 AS id, 0 AS pos, -1 AS idx, 'string' AS kind, r_name AS value FROM region UNION ALL SELECT 'r' || n_regionkey, n_nationkey + 100, 0, -1, 'string', 'it''s (' || n_name || '); ' FROM nation
UNION ALL SELECT 'r' || n_regionkey, n_nationkey + 100, 1, -1, 'ref', CAST(n_regionkey + 1 AS VARCHAR) FROM nation UNION ALL SELECT file, id, 1, -1, 'enum', 'T' FROM c UNION ALL SELECT file, id, 0, 0, 'integer', CAST(c_custkey AS VARCHAR) FROM c
UNION ALL SELECT file, id, 0, 1, 'integer', '7' FROM c UNION ALL SELECT file, id, 1, -1, 'ref', CAST(c_nationkey + 100 AS VARCHAR) FROM c UNION ALL SELECT file, id, 2, -1, 'double', printf('%.2f', c_acctbal) FROM c""")
def k02(spark, d):
    v = C.attribute_values(p21.parse(_exchange(spark, d)))
    return v.select("file", "id", "pos", F.coalesce("idx", F.lit(-1)).alias("idx"), "kind", "value")


def _schema(spark):
    """Entities, their own attributes' order, and what is above them."""
    o = spark.createDataFrame([("THING", 0, f"{N}name"), ("NATION", 0, f"{N}region"), ("CUSTOMER", 0, f"{N}codes"), ("CUSTOMER", 1, f"{N}nation"), ("CUSTOMER", 2, f"{N}balance")], "entity string, n int, p string")
    up = spark.createDataFrame([("NATION", "THING"), ("REGION", "THING")], "a string, b string")
    own = spark.createDataFrame([(e,) for e in ("THING", "NATION", "REGION", "CUSTOMER")], "sub string")
    return o, G.closure(up).toDF("sub", "kind", "depth").union(own.select("sub", "sub", F.lit(0)))


@query("k01_attribute_order", f"SELECT * FROM (VALUES ('THING', 0, '{N}name'), ('NATION', 0, '{N}name'), ('NATION', 1, '{N}region'), ('REGION', 0, '{N}name'), ('CUSTOMER', 0, '{N}codes'), ('CUSTOMER', 1, '{N}nation'), ('CUSTOMER', 2, '{N}balance')) v(entity, pos, p)")
def k01(spark, d):
    return C.attribute_order(*_schema(spark))


@query("k03_instance_triples", f"""WITH c AS (SELECT 'r' || n_regionkey AS ng, 'r' || n_regionkey || '#' || (c_custkey + 1000) AS s, * FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'r' || r_regionkey AS ng, 'r' || r_regionkey || '#' || (r_regionkey + 1) AS s, '{TYPE}' AS p, '{N}Region' AS o, -1 AS idx FROM region UNION ALL SELECT 'r' || n_regionkey, 'r' || n_regionkey || '#' || (n_nationkey + 100), '{TYPE}', '{N}Nation', -1 FROM nation UNION ALL SELECT ng, s, '{TYPE}', '{N}Customer', -1 FROM c
UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey || '#' || (r_regionkey + 1), '{N}name', r_name, -1 FROM region UNION ALL SELECT 'r' || n_regionkey, 'r' || n_regionkey || '#' || (n_nationkey + 100), '{N}name', 'it''s (' || n_name || '); ', -1 FROM nation UNION ALL SELECT 'r' || n_regionkey, 'r' || n_regionkey || '#' || (n_nationkey + 100), '{N}region', 'r' || n_regionkey || '#' || (n_regionkey + 1), -1 FROM nation
UNION SELECT ng, s, '{N}codes', CAST(c_custkey AS VARCHAR), 0 FROM c UNION SELECT ng, s, '{N}codes', '7', 1 FROM c UNION ALL SELECT ng, s, '{N}nation', ng || '#' || (c_nationkey + 100), -1 FROM c UNION ALL SELECT ng, s, '{N}balance', printf('%.2f', c_acctbal), -1 FROM c""")
def k03(spark, d):
    classes = spark.createDataFrame([("NATION", f"{N}Nation"), ("REGION", f"{N}Region"), ("CUSTOMER", f"{N}Customer")], "entity string, cls string")
    t = C.instance_triples(p21.parse(_exchange(spark, d)), C.attribute_order(*_schema(spark)), classes)
    return t.select("ng", "s", "p", "o", F.coalesce("member_idx", F.lit(-1)).alias("idx"))


@query("k05_without_scaffolding", f"WITH {sql('customer', 'nation')} SELECT s, p, o FROM triples WHERE ng LIKE '%customer' AND NOT (o_kind = 'node' AND o LIKE '{EX}nation#%')")
def k05(spark, d):
    return C.without_scaffolding(lower(spark, d, "customer", "nation"), spark.createDataFrame([(f"{N}Nation",)], "cls string")).select("s", "p", "o")


@query("k06_base_units", f"SELECT '{EX}part#' || p_partkey AS s, CAST(p_size * CASE WHEN p_brand LIKE '%1' THEN 1000 WHEN p_brand LIKE '%2' THEN 25 ELSE 1 END AS VARCHAR) AS o, CASE WHEN p_brand LIKE '%1' OR p_brand LIKE '%2' THEN 'mm' END AS base FROM part")
def k06(spark, d):
    """Sizes in metres, in units of 25 mm, or in something unknown, by the brand's last digit."""
    t = lower(spark, d, "part", predicates=(f"{N}p_size", f"{N}p_brand")).withColumn("o", F.when(F.col("p") == f"{N}p_brand", F.substring("o", -1, 1)).otherwise(F.col("o")))
    units = spark.createDataFrame([("1", 1000.0, "mm"), ("2", 25.0, "mm")], "unit string, factor double, base string")
    return C.in_base_units(t, f"{N}p_size", f"{N}p_brand", units, f"{N}length").select("s", "o", "base")


@query("k07_expanded", f"WITH {sql('supplier')} SELECT s, p, o FROM triples UNION ALL SELECT s || '/address', '{TYPE}', '{N}Address' FROM triples WHERE p = '{TYPE}' UNION ALL SELECT s, '{N}hasAddress', s || '/address' FROM triples WHERE p = '{TYPE}'")
def k07(spark, d):
    templates = spark.createDataFrame([(f"{N}Supplier", "address", f"{N}Address", f"{N}hasAddress"), (f"{N}Nobody", "x", "y", "z")], "cls string, role string, role_cls string, link string")
    return C.expanded(lower(spark, d, "supplier"), templates).select("s", "p", "o")


def _xml(spark, d):
    """One file of nations that refer to regions by uid; every fifth refers to one that isn't there."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    to = F.when(F.col("n_nationkey") % 5 == 4, "gone").otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    rows = n.select(F.format_string('<Nation uid="n%d"><Name>%s &amp; co</Name><In uidRef="%s"/></Nation>', "n_nationkey", "n_name", to).alias("x")).union(r.select(F.format_string('<x:Region uid="r%d"><Name>%s</Name></x:Region>', "r_regionkey", "r_name")))
    return rows.agg(F.concat(F.lit('<?xml version="1.0"?><Data xmlns:x="urn:x">'), F.array_join(F.array_sort(F.collect_list("x")), "\n"), F.lit("</Data>")).alias("text")).select(F.lit("f").alias("file"), "text")


@query("s24_xml_triples", f"""SELECT 'f#n' || n_nationkey AS s, '{TYPE}' AS p, '{N}Nation' AS o FROM nation UNION ALL SELECT 'f#r' || r_regionkey, '{TYPE}', '{N}Region' FROM region UNION ALL SELECT 'f#n' || n_nationkey, '{N}Name', n_name || ' & co' FROM nation
UNION ALL SELECT 'f#r' || r_regionkey, '{N}Name', r_name FROM region UNION ALL SELECT 'f#n' || n_nationkey, '{N}In', 'f#r' || n_regionkey FROM nation WHERE n_nationkey % 5 <> 4""")
def s24(spark, d):
    return C.xml_triples(xmltree.parse(_xml(spark, d))).where("s like 'f#%'").select("s", "p", "o")


@query("j11_unresolved", "SELECT 'f' AS file, 'gone' AS uid")
def j11(spark, d):
    return C.unresolved(xmltree.parse(_xml(spark, d)))


@query("k09_nested_documents", f"""SELECT '{EX}nation#' || n_nationkey AS s, '{{"' || '{N}n_name":["' || n_name || '"],"{N}n_regionkey":[{{"' || '{N}r_name":["' || r_name || '"],"{TYPE}":["{N}Region"]}}],"{TYPE}":["{N}Nation"]}}' AS document FROM nation JOIN region ON n_regionkey = r_regionkey""")
def k09(spark, d):
    return C.nested(lower(spark, d, *_NR).withColumn("ng", F.lit("g")), f"{N}Nation").select("s", "document")


def _svg(spark, d):
    """A file for each customer segment: a line for every customer, to points that many share, in a group that has the style."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey").cast("int")
    row = F.format_string('<line x1="%d" y1="0" x2="%d" y2="5.50"/><polyline points="0,0 %d,1"/>', k, k % 3, k % 4)
    rows = c.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("x"))
    return rows.select(F.col("c_mktsegment").alias("file"), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g style="red">'), "x", F.lit("</g></svg>")).alias("text"))


@query("s26_svg_points", """WITH c AS (SELECT c_mktsegment AS f, c_custkey AS k FROM customer), p AS (SELECT f, k || ',0' AS pt FROM c UNION SELECT f, (k % 3) || ',5.5' FROM c UNION SELECT f, '0,0' FROM c UNION SELECT f, (k % 4) || ',1' FROM c)
SELECT 'http://ex.org/' || f AS ng, '#point' || pt AS s, split_part(pt, ',', 1) AS x, split_part(pt, ',', 2) AS y FROM p""")
def s26(spark, d):
    """Points of all shapes: equal ones are one node."""
    t = C.shape_triples(C.shapes(xmltree.parse(_svg(spark, d)))).where("s like '#point%'")
    of = lambda k: F.max(F.when(F.col("p") == f"{N}{k}", F.col("o"))).alias(k)
    return t.groupBy("ng", "s").agg(of("x"), of("y"))


@query("k10_shape_attributes", """SELECT 'http://ex.org/' || c_mktsegment AS ng, 'line' AS kind, 'red' AS style, c_custkey || ',0 ' || (c_custkey % 3) || ',-5.5' AS points FROM customer UNION ALL SELECT 'http://ex.org/' || c_mktsegment, 'polyline', 'red', '0,0 ' || (c_custkey % 4) || ',-1' FROM customer""")
def k10(spark, d):
    a = F.col("attrs")
    return C.shape_attributes(C.shape_triples(C.shapes(xmltree.parse(_svg(spark, d))))).select("ng", a["kind"].alias("kind"), a["style"].alias("style"), a["points"].alias("points"))


@query("x05_stream_index", f"WITH {sql(*_NR)} SELECT ng AS graph_uri, string_agg(DISTINCT CASE WHEN p IN ('{N}n_name', '{N}r_name') THEN o END, '|' ORDER BY CASE WHEN p IN ('{N}n_name', '{N}r_name') THEN o END) AS label, count(*) FILTER (o_kind = 'lit') AS literals FROM triples GROUP BY ng")
def x05(spark, d):
    """Two commits, each followed by the stream that keeps the index."""
    t, r = lower(spark, d, *_NR), Repository(spark, _folder(spark))
    index = follow.SearchIndex(r, _folder(spark), (f"{N}n_name", f"{N}r_name"))
    one = r.commit("ds", t.where("ng like '%nation'"), "me", "2020-01-01 00:00:00", "one")
    index.follow().awaitTermination()
    r.commit("ds", t, "me", "2020-01-02 00:00:00", "two", parents=(one,))
    index.follow().awaitTermination()
    return index.documents("ds").select("graph_uri", "label", "literals")


@query("v12_stream_replica", f"WITH {sql('region')} SELECT s, p, o FROM triples")
def v12(spark, d):
    r, to = Repository(spark, _folder(spark)), Repository(spark, _folder(spark))
    r.commit("ds", lower(spark, d, "region"), "me", "2020-01-01 00:00:00", "one")
    follow.replicate(r, to, _folder(spark)).awaitTermination()
    return to.checkout_branch("ds").select("s", "p", "o")


@query("l06_log_stream", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def l06(spark, d):
    """The events as a stream of log entries, counted by day and type."""
    at = _folder(spark)
    table(spark, d, "events").select("ts", F.col("event_type").alias("type")).repartition(4).write.parquet(at)
    log = spark.readStream.schema("ts timestamp, type string").option("maxFilesPerTrigger", 8).parquet(at)
    out, work = _folder(spark), _folder(spark)
    # all that has come in is let through at the end, as no later entry would
    q = follow.events_by_type(log, 86400, 0).writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).outputMode("complete").option("checkpointLocation", work).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(out)
    return last.where(F.col("batch") == last.agg(F.max("batch")).first()[0]).groupBy("type").agg(F.sum("n").alias("n"))


def _parts(spark, d):
    """Orders have lines, lines have a part: whole to part."""
    li = table(spark, d, "lineitem")
    k = lambda x, *cs: F.concat_ws("-", F.lit(x), *(F.col(c).cast("string") for c in cs))
    one = li.select(k("o", "l_orderkey").alias("a"), k("l", "l_orderkey", "l_linenumber").alias("b"))
    return one.union(li.select(k("l", "l_orderkey", "l_linenumber"), k("p", "l_partkey"))).distinct()


@query("g09_part_groups", """SELECT 'o-' || l_orderkey AS root, 1 + count(DISTINCT l_linenumber) + count(DISTINCT l_partkey) AS n, count(DISTINCT l_orderkey) AS ids FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_orderkey""")
def g09(spark, d):
    """Groups of all pending orders, each with an id of its own."""
    roots = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("node"))
    roots = roots.join(_parts(spark, d).select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    ids = G.group_ids(G.part_groups(_parts(spark, d), roots))
    return ids.groupBy("root", "n").agg(F.count_distinct("group_id").alias("ids"))


@query("g10_partitioned", f"WITH {sql('customer', 'nation', 'region')} SELECT CASE WHEN s LIKE '{EX}customer#%' THEN 'c' || (CAST(split_part(s, '#', 2) AS INT) % 3) ELSE 'shared' END AS ng, count(*) AS n FROM triples GROUP BY 1")
def g10(spark, d):
    """Customers in three groups: nations, which all refer to, and regions are shared."""
    t = lower(spark, d, "customer", "nation", "region")
    own = t.where("ng like '%customer'").select(F.concat(F.lit("c"), (F.substring_index("s", "#", -1).cast("int") % 3).cast("string")).alias("grp"), F.col("s").alias("node")).distinct()
    out, _ = G.partitioned(t, own, "shared")
    return out.groupBy("ng").agg(F.count(F.lit(1)).alias("n"))


@query("g10_partition_imports", "SELECT unnest(['c0', 'c1', 'c2']) AS importer, 'shared' AS imported")
def g10b(spark, d):
    t = lower(spark, d, "customer", "nation", "region")
    own = t.where("ng like '%customer'").select(F.concat(F.lit("c"), (F.substring_index("s", "#", -1).cast("int") % 3).cast("string")).alias("grp"), F.col("s").alias("node")).distinct()
    return G.partitioned(t, own, "shared")[1]


@query("g11_walk", """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS b, 'r' || n_regionkey AS a FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
w AS (SELECT 'world' AS path, 'world' AS node, 0 AS depth UNION ALL SELECT w.path || '/' || e.b, e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node) SELECT path, node, depth FROM w""")
def g11(spark, d):
    from .queries_graphs import imports

    return G.walk_order(imports(spark, d).select(F.col("b").alias("a"), F.col("a").alias("b")), "world").select(F.array_join("path", "/").alias("path"), "node", "depth")


@query("k12_eligible_roots", "SELECT DISTINCT 'http://ex.org/customer#' || c_custkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def k12(spark, d):
    t = lower(spark, d, "customer", "nation", "region")
    roots = t.where("ng like '%customer'").select(F.col("s").alias("node")).distinct()
    return G.eligible_roots(t, roots, f"{N}Region", f"{N}Nation")


@query("m01_new_graphs", "SELECT 'r' || r_regionkey AS ng, true AS old FROM region UNION ALL SELECT 'mine', false UNION ALL SELECT 'urn', false")
def m01(spark, d):
    g = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ng"), F.lit(False).alias("is_referenced"), F.lit(False).alias("deleted"))
    out = M.new_graphs(g, spark.createDataFrame([("mine",), ("",)], "ng string"))
    return out.select(F.when(F.col("ng").rlike("^urn:uuid:[0-9a-f-]{36}$"), "urn").otherwise(F.col("ng")).alias("ng"), F.col("ng").startswith("r").alias("old"))


@query("m02_new_nodes", f"WITH {sql('region')} SELECT s, p, o FROM triples UNION ALL SELECT '{EX}nation#x' || n_nationkey, '{TYPE}', unnest(['{N}A', '{N}B']) FROM nation")
def m02(spark, d):
    rows = table(spark, d, "nation").select(F.lit(f"{EX}nation").alias("ng"), F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("fragment"), F.array(F.lit(f"{N}A"), F.lit(f"{N}B")).alias("types"))
    return M.new_nodes(lower(spark, d, "region"), rows).select("s", "p", "o")


@query("m11_rename_strict", f"WITH {sql('nation')} SELECT replace(s, '{EX}nation#', '{EX}nation#k') AS s, p, o FROM triples")
def m11(spark, d):
    """Every fragment gets a letter before it; none is taken."""
    t = lower(spark, d, "nation")
    names = t.select(F.col("s").alias("old"), F.replace("s", F.lit("nation#"), F.lit("nation#k")).alias("new"), F.lit(None).cast("string").alias("ng")).distinct()
    return M.rename(t, names, strict=True).select("s", "p", "o")


@query("u11_copied", f"WITH {sql(*_NR)} SELECT ng, s, p, o FROM triples UNION SELECT 'copy', s, p, o FROM triples WHERE ng LIKE '%region'")
def u11(spark, d):
    t = lower(spark, d, *_NR)
    once = M.copied(t, t.where("ng like '%region'").select(F.col("s").alias("node")), "copy")
    return M.copied(once, t.where("ng like '%region'").select(F.col("s").alias("node")), "copy").select("ng", "s", "p", "o")


@query("u10_stubs", "SELECT n_nationkey AS k, n_nationkey % 3 = 0 AS is_referenced FROM nation WHERE n_nationkey % 2 = 0 AND (n_nationkey % 3 <> 0 OR n_nationkey % 5 > 0) UNION ALL SELECT n_nationkey, true FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey % 3 = 0 AND n_nationkey % 5 > 0")
def u10(spark, d):
    """Even nations are in the target, all in the source; those divisible by 3 are referenced, by 5 empty."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("ng"), F.expr("n_nationkey % 3 = 0").alias("is_referenced"), F.expr("n_nationkey % 5").alias("n_nodes"))
    return U.moved_stubs(n, n.where("ng % 2 = 0")).select(F.col("ng").alias("k"), "is_referenced")


@query("j06_additional_types", f"SELECT '{EX}customer#' || c_custkey AS node, unnest(['{N}Ghost', '{N}Spirit']) AS cls FROM customer WHERE c_custkey % 60 = 1")
def j06(spark, d):
    """Some customers have a type that the ontology lacks; another graph says what is above it."""
    from .queries_rules import _typed, ontology

    t = _typed(spark, d)
    more = spark.createDataFrame([("other", f"{N}Ghost", V.SUB_CLASS, "node", f"{N}Spirit")], "ng string, s string, p string, o_kind string, o string")
    return V.additional_types(t.unionByName(more, allowMissingColumns=True), V.elements(ontology(spark))).select("node", "cls")


@query("o02_inverse_order", f"SELECT '{N}homeOf' AS sub, '{N}placeOf' AS kind")
def o02(spark, d):
    """home is below place; so homeOf is below placeOf."""
    from .queries_rules import ontology

    o = ontology(spark)
    more = spark.createDataFrame([("x", f"{N}home", V.SUB_PROPERTY, f"{N}place"), ("x", f"{N}placeOf", V.INVERSE, f"{N}place"), ("x", f"{N}place", TYPE, f"{RDF}Property")], "ng string, s string, p string, o string")
    every = o.union(more)
    return V.inverse_sub_properties(V.elements(every), V.kinds(every))


@query("o04_about", f"SELECT 'http://ex.org/schema#r' || r_regionkey AS element, r_name AS label, CAST(NULL AS VARCHAR) AS comment, n.c AS below FROM region JOIN (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY ALL) n ON n_regionkey = r_regionkey")
def o04(spark, d):
    """Regions as classes with a label, nations below them."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    k = lambda c: F.concat(F.lit(f"{N}r"), F.col(c).cast("string"))
    t = r.select(F.lit("g").alias("ng"), k("r_regionkey").alias("s"), F.lit(f"{RDFS}label").alias("p"), F.col("r_name").alias("o"))
    t = t.union(n.select(F.lit("g"), F.concat(F.lit(f"{N}n"), F.col("n_nationkey").cast("string")), F.lit(V.SUB_CLASS), k("n_regionkey")))
    return V.about(t).where("label is not null").select("element", "label", "comment", "below")


@query("o01_class_flags", f"SELECT * FROM (VALUES ('{N}Region', false, true), ('{N}Nation', false, true), ('{N}Customer', false, true), ('{N}Supplier', false, true), ('{N}Party', false, false), ('{N}Place', false, false), ('{N}Thing', true, false)) v(cls, is_root, is_leaf)")
def o01(spark, d):
    from .queries_rules import ontology

    o = ontology(spark)
    return V.class_flags(o, V.kinds(o)).select("cls", "is_root", "is_leaf")


@query("d05_literal_ranges", f"""SELECT r.rng AS range, l.dt AS dtype, r.rng = '{RDFS}Literal' OR r.rng = l.dt AS fits FROM (SELECT unnest(['{XSD}string', '{XSD}double', '{XSD}integer', '{XSD}boolean', '{RDFS}Literal']) AS rng) r, (SELECT unnest(['{XSD}string', '{XSD}double', '{XSD}integer', '{XSD}date']) AS dt) l""")
def d05(spark, d):
    from ..operators.validate import literal_fits

    values = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    both = values("range", [f"{XSD}string", f"{XSD}double", f"{XSD}integer", f"{XSD}boolean", f"{RDFS}Literal"]).crossJoin(values("dtype", [XSD + k for k in ("string", "double", "integer", "date")]))  # twenty rows
    return both.select("range", "dtype", literal_fits(F.col("range"), F.col("dtype"), F.lit(None).cast("string")).alias("fits"))


@query("c04_as_list", "SELECT '_:l' || o_orderkey AS node, count(l_orderkey) > 0 AS is_list, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def c04(spark, d):
    from .queries_patterns import lists

    return L.as_list(lists(spark, d), table(spark, d, "orders").select(F.concat(F.lit("_:l"), F.col("o_orderkey").cast("string")).alias("node")))


@query("c05_literal_arrays", f"SELECT '_:l' || l_orderkey || '-1' AS node, '{XSD}integer' AS o_dtype, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS members, arg_min(CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS first FROM lineitem GROUP BY l_orderkey")
def c05(spark, d):
    from .queries_sets import chains

    a = L.literal_arrays(L.collapse(chains(spark, d)))
    return a.select("node", "o_dtype", F.array_join("o_members", " ").alias("members"), L.member(F.col("o_members"), 0).alias("first"))


@query("c09_nested", "SELECT '_:c' || o_custkey AS node, k || '.' || i AS path, CAST(o_orderkey * 10 + i AS VARCHAR) AS o FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders), (SELECT unnest([0, 1]) AS i)")
def c09(spark, d):
    """Each customer's list of orders, which are lists of two numbers."""
    from pyspark.sql.window import Window

    o, none = table(spark, d, "orders"), F.lit(None).cast("string")
    own, k = F.concat(F.lit("_:o"), F.col("o_orderkey").cast("string")), F.col("o_orderkey").cast("long")
    outer = o.select(F.lit("g").alias("ng"), F.concat(F.lit("_:c"), F.col("o_custkey").cast("string")).alias("node"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("member_idx"), own.alias("o"), F.lit("node").alias("o_kind"), none.alias("o_dtype"))
    inner = o.select(F.lit("g"), own, F.posexplode(F.array(k * 10, k * 10 + 1))).toDF("ng", "node", "member_idx", "v").select("ng", "node", "member_idx", F.col("v").cast("string"), F.lit("lit"), none)
    return L.nested(outer.union(inner)).select("node", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "o")


def _documents(spark, d):
    """A graph for each nation, with its region as who issued its id; and one that has all regions."""
    t = lower(spark, d, *_NR)
    own = t.where("ng like '%nation'").withColumn("ng", F.col("s")).unionByName(t.where("ng like '%region'"))
    main = spark.createDataFrame([(f"{N}Nation", "Organization"), (f"{N}Region", "Person")], "cls string, main_type string")
    return X.full_documents(own, main, (f"{N}n_name", f"{N}r_name"), (), (f"{N}n_name",), f"{N}n_regionkey")


@query("x01_full_documents", f"SELECT '{EX}nation#' || n_nationkey AS graph_uri, 'Organization' AS main_type, n_name AS label, r_name AS owner, '{EX}nation#' || n_nationkey AS main_node, '1' AS nodes FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '{EX}region', '-', string_agg(r_name, '|' ORDER BY r_name), NULL, NULL, CAST(count(*) AS VARCHAR) FROM region")
def x01(spark, d):
    f = lambda k: F.array_join(F.col("fields")[k], "|")
    return _documents(spark, d).select("graph_uri", "main_type", f("label").alias("label"), f("id.idOwner").alias("owner"), f("mainNode").alias("main_node"), f("nodeCount").alias("nodes"))


@query("x02_terms", f"""WITH n AS (SELECT '{EX}nation#' || n_nationkey AS g, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), tok AS (SELECT g, 'label' AS field, unnest(regexp_split_to_array(lower(n_name), '[^a-z0-9]+')) AS term FROM n)
SELECT DISTINCT * FROM (SELECT * FROM tok WHERE term <> '' UNION ALL SELECT g, 'label.phrase', lower(n_name) FROM n UNION ALL SELECT g, 'id', n_name FROM n UNION ALL SELECT g, 'id.key', lower(translate(trim(n_name, '-_/ '), '_/ ', '---')) FROM n) v(graph_uri, field, term)""")
def x02(spark, d):
    """The inverted index of some fields, each by its own analyzer."""
    t = I.terms(_documents(spark, d).where("main_type = 'Organization'"), "Organization")
    return t.where("field in ('label', 'label.phrase', 'id', 'id.key')")


@query("x02_mapping", "SELECT 14 AS types, CAST(3 AS BIGINT) AS only_one")
def x02b(spark, d):
    """Every type has the common fields; three fields belong to one type alone."""
    m = I.mapping(spark)
    n = m.groupBy("field").agg(F.count_distinct("type").alias("n"))
    return n.agg(F.max("n").cast("int").alias("types"), F.count(F.when(F.col("n") == 1, 1)).alias("only_one"))


@query("u09_same_state", "SELECT unnest(['clone', 'after a commit']) AS what, unnest([true, false]) AS same")
def u09(spark, d):
    t = lower(spark, d, "region")
    r, to = Repository(spark, _folder(spark)), Repository(spark, _folder(spark))
    one = r.commit("ds", t, "me", "2020-01-01 00:00:00", "one")
    to.sync_from(r)
    clone = r.state() == to.state()
    to.commit("ds", t.where("o_kind = 'lit'"), "me", "2020-01-02 00:00:00", "two", parents=(one,))
    return spark.createDataFrame([("clone", clone), ("after a commit", r.state() == to.state())], "what string, same boolean")


@query("g13_read_closure", "SELECT 'n3' AS ng UNION ALL SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'world'")
def g13(spark, d):
    """Graph files of nations, regions and the world; one nation's graph with all that it imports."""
    from .queries_graphs import imports

    e = imports(spark, d).where("a not like 'c%'")
    t = e.select(F.col("a").alias("ng"), F.lit("iri").alias("s_kind"), F.col("a").alias("s"), F.lit(f"{OWL}imports").alias("p"), F.lit("node").alias("o_kind"), F.col("b").alias("o"))
    t = t.unionByName(t.limit(1).withColumn("ng", F.lit("world")).withColumn("p", F.lit("p")))
    at = _folder(spark)
    graphfiles.write(t, at)
    return graphfiles.read_closure(spark, at, "n3").select("ng").distinct()


def _ontology_file(spark):
    """The ontology of the rules' queries as a Turtle file, loaded again."""
    from .queries_rules import ontology

    at = _folder(spark)
    turtle.write(conform(ontology(spark)).withColumn("o_kind", F.lit("node")).withColumn("s_kind", F.lit("iri")), at)
    return ontologies.load(spark, f"{at}/*/*.txt")


@query("s30_dictionary", f"SELECT '{EX}customer#' || c_custkey AS s, '{N}c_nationkey' AS p, '{N}home' AS kind FROM customer UNION ALL SELECT '{EX}supplier#' || s_suppkey, '{N}s_nationkey', '{N}home' FROM supplier")
def s30(spark, d):
    """Triples by a dictionary's property that is functional, or below one that is."""
    book = _ontology_file(spark)
    t = lower(spark, d, "customer", "supplier", predicates=(f"{N}c_nationkey", f"{N}s_nationkey", f"{N}c_name"))
    top = book.elements.where("is_functional").select(F.col("element").alias("kind"))
    return t.join(book.kinds.where("depth > 0").join(top, "kind", "left_semi").select(F.col("sub").alias("p"), "kind"), "p").select("s", "p", "kind")


@query("j03_lookup", f"SELECT DISTINCT 'http://ex.org/schema#' || c AS element, c <> 'c_mktsegment' AS known, CASE WHEN c <> 'c_mktsegment' THEN true END AS is_property FROM (SELECT unnest(['c_nationkey', 'c_name', 'c_mktsegment', 'c_acctbal']) AS c)")
def j03(spark, d):
    p = lower(spark, d, "customer", predicates=tuple(N + c for c in ("c_nationkey", "c_name", "c_mktsegment", "c_acctbal"))).select(F.col("p").alias("element")).distinct()
    return _ontology_file(spark).lookup(p).select("element", "known", "is_property")


@query("j07_repointed", f"WITH {sql('customer', 'nation')} SELECT o AS node, count(*) AS refs FROM triples WHERE o_kind = 'node' AND o IN (SELECT s FROM triples WHERE ng LIKE '%nation') GROUP BY o")
def j07(spark, d):
    """Two stages become one: references of the first find the nodes of the second, since a node is its name."""
    moved = U.union(lower(spark, d, "customer"), lower(spark, d, "nation"))
    nodes = moved.where("ng like '%nation'").select(F.col("s").alias("node")).distinct()
    refs = moved.where("o_kind = 'node'").select(F.col("o").alias("node"))
    return refs.join(nodes, "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("refs"))
