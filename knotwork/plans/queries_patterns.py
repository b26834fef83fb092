"""Pattern, join, count and order queries over lowered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import EX, SCHEMA_NS, TYPE, lower, sql, table
from ..operators import aggregates as A
from ..operators import order as O
from ..operators import patterns as P
from ..operators.aggregates import framed_sql, tree_sql
from .registry import query

NODE = f"{EX}nation#3"
SMALL = ("region", "nation", "supplier")
N = SCHEMA_NS


@query("p01_touching", f"""WITH {sql(*SMALL)} SELECT ng, s, p, o, CASE WHEN s = '{NODE}' THEN 'subject' WHEN o_kind = 'node' AND o = '{NODE}' THEN 'object' ELSE 'predicate' END AS role
FROM triples WHERE s = '{NODE}' OR p = '{NODE}' OR (o_kind = 'node' AND o = '{NODE}')""")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return P.touching(lower(spark, d, *SMALL), NODE).select("ng", "s", "p", "o", "role")


@query("p02_objects", f"WITH {sql('customer')} SELECT o_kind, o FROM triples WHERE s = '{EX}customer#7' AND p = '{N}c_nationkey'")
def p02(spark, d):
    return P.objects(lower(spark, d, "customer", predicates=(f"{N}c_nationkey",)), f"{EX}customer#7", f"{N}c_nationkey").select("o_kind", "o")


@query("p03_has_triples", f"""WITH {sql("nation")}, wanted AS (SELECT '{EX}nation#' || n_nationkey AS s, '{N}n_regionkey' AS p, '{EX}region#1' AS o FROM nation)
SELECT s, p, o, EXISTS (SELECT 1 FROM triples t WHERE t.s = w.s AND t.p = w.p AND t.o = w.o) AS held FROM wanted w""")
def p03(spark, d):
    wanted = table(spark, d, "nation").select(F.concat(F.lit(f"{EX}nation#"), F.col("n_nationkey").cast("string")).alias("s"), F.lit(f"{N}n_regionkey").alias("p"), F.lit(f"{EX}region#1").alias("o"))
    return P.has_triples(lower(spark, d, "nation", predicates=(f"{N}n_regionkey",)), wanted)


@query("p04_positions", f"""WITH {sql("customer")} SELECT s, p, o, row_number() OVER (PARTITION BY ng, s
ORDER BY CASE o_kind WHEN 'node' THEN 0 ELSE 1 END, p, o_dtype NULLS FIRST, o) - 1 AS pos FROM triples""")
def p04(spark, d):
    return P.positions(lower(spark, d, "customer")).select("s", "p", "o", F.col("pos").cast("bigint").alias("pos"))


@query("p05_nodes", f"WITH {sql('orders')} SELECT s AS node FROM triples UNION SELECT o FROM triples WHERE o_kind = 'node'")
def p05(spark, d):
    return P.nodes(lower(spark, d, "orders")).select("node")


@query("p06_iri_nodes", f"WITH {sql(*SMALL)}, n AS (SELECT s AS node FROM triples UNION SELECT o FROM triples WHERE o_kind = 'node') SELECT split_part(node, '#', 1) AS base, count(*) AS n FROM n WHERE node NOT LIKE '\\_:%' ESCAPE '\\' GROUP BY 1")
def p06(spark, d):
    return P.iri_nodes(lower(spark, d, *SMALL)).groupBy(F.substring_index("node", "#", 1).alias("base")).agg(F.count(F.lit(1)).alias("n"))


def _blanks(spark, d):
    """Orders as blank nodes that customers point to."""
    o = table(spark, d, "orders")
    b = F.concat(F.lit("_:o"), F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    rows = F.array(
        F.struct(F.lit("iri").alias("s_kind"), F.concat(F.lit(f"{EX}customer#"), F.col("o_custkey").cast("string")).alias("s"), F.lit(f"{N}placed").alias("p"), F.lit("node").alias("o_kind"), b.alias("o")),
        F.struct(F.lit("blank").alias("s_kind"), b.alias("s"), F.lit(f"{N}status").alias("p"), F.lit("lit").alias("o_kind"), F.col("o_orderstatus").alias("o")),
    )
    return o.select(F.lit(f"{EX}blanks").alias("ng"), F.inline(rows)).select("*", none.alias("o_dtype"), none.alias("o_lang"), F.lit(None).cast("array<string>").alias("o_members"), F.lit(None).cast("int").alias("member_idx"))


@query("p07_blank_nodes", "SELECT DISTINCT '_:o' || o_orderkey AS node FROM orders")
def p07(spark, d):
    return P.blank_nodes(_blanks(spark, d)).select("node")


def lists(spark, d):
    """Orders as lists of their parts, by line number."""
    li = table(spark, d, "lineitem")
    none = F.lit(None).cast("string")
    return li.select(
        F.lit(f"{EX}lists").alias("ng"), F.lit("blank").alias("s_kind"), F.concat(F.lit("_:l"), F.col("l_orderkey").cast("string")).alias("s"),
        F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#first").alias("p"), F.lit("node").alias("o_kind"), F.concat(F.lit(f"{EX}part#"), F.col("l_partkey").cast("string")).alias("o"),
        none.alias("o_dtype"), none.alias("o_lang"), F.lit(None).cast("array<string>").alias("o_members"), F.col("l_linenumber").cast("int").alias("member_idx"),
    )


@query("p08_list_nodes", "SELECT DISTINCT '_:l' || l_orderkey AS node FROM lineitem")
def p08(spark, d):
    return P.list_nodes(lists(spark, d))


@query("p09_undefined", f"WITH {sql('customer', 'region')} SELECT DISTINCT o AS node FROM triples WHERE o_kind = 'node' AND o NOT IN (SELECT s FROM triples)")
def p09(spark, d):
    return P.undefined(lower(spark, d, "customer", "region"))


@query("p10_by_fragment", f"WITH {sql(*SMALL)} SELECT DISTINCT node FROM (SELECT s AS node FROM triples UNION SELECT o FROM triples WHERE o_kind = 'node') WHERE split_part(node, '#', 2) = '3'")
def p10(spark, d):
    return P.by_fragment(lower(spark, d, *SMALL), "3").select("node")


@query("p11_graphs", f"""WITH {sql("customer", "nation")}, l AS (SELECT DISTINCT ng FROM triples),
r AS (SELECT DISTINCT split_part(o, '#', 1) AS ng FROM triples WHERE o_kind = 'node' AND contains(o, '#'))
SELECT ng, false AS is_referenced FROM l UNION ALL SELECT ng, true FROM r WHERE ng NOT IN (SELECT ng FROM l)""")
def p11(spark, d):
    return P.graphs(lower(spark, d, "customer", "nation"))


@query("p12_is_element", f"WITH {sql(*SMALL)} SELECT o, count(*) AS n, bool_or(o = '{N}Nation') AS is_nation FROM triples WHERE p = '{TYPE}' GROUP BY o")
def p12(spark, d):
    t = P.match(lower(spark, d, *SMALL, predicates=(TYPE,)), p=TYPE)
    return t.groupBy("o").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o") == f"{N}Nation").alias("is_nation"))


@query("p16_flags", f"""WITH {sql(*SMALL)}, n AS (SELECT s AS node FROM triples UNION SELECT o FROM triples WHERE o_kind = 'node')
SELECT node, true AS is_iri, false AS is_blank, false AS is_uuid, false AS is_list FROM n""")
def p16(spark, d):
    return P.flags(lower(spark, d, *SMALL))


@query("p17_dump", f"""WITH {sql("nation")} SELECT replace(s, '{EX}', 'ex:') AS s, replace(replace(p, '{N}', 's:'), '{TYPE}', 'a') AS p,
CASE WHEN o_kind = 'node' THEN replace(replace(o, '{N}', 's:'), '{EX}', 'ex:') ELSE '"' || o || '"' END AS o FROM triples""")
def p17(spark, d):
    t = lower(spark, d, "nation")
    short = lambda c: F.replace(F.replace(c, F.lit(N), F.lit("s:")), F.lit(EX), F.lit("ex:"))
    o = F.when(F.col("o_kind") == "node", short(F.col("o"))).otherwise(S.display(F.col("o"), F.col("o_dtype"), F.col("o_lang")))
    return t.select(short(F.col("s")).alias("s"), F.replace(short(F.col("p")), F.lit(TYPE), F.lit("a")).alias("p"), o.alias("o"))


@query("p18_identity", f"WITH {sql('part')} SELECT DISTINCT s, split_part(s, '#', 1) AS base, split_part(s, '#', 2) AS fragment, ng FROM triples")
def p18(spark, d):
    t = lower(spark, d, "part").select("s", "ng").distinct()
    return t.select("s", S.iri_base(F.col("s")).alias("base"), S.iri_fragment(F.col("s")).alias("fragment"), "ng")


@query("p21_belongs", f"WITH {sql('nation')} SELECT '{EX}nation#' || c_nationkey AS node, c_custkey FROM customer WHERE '{EX}nation#' || c_nationkey IN (SELECT s FROM triples WHERE p = '{N}n_name' AND o LIKE '%1%')")
def p21(spark, d):
    wanted = table(spark, d, "customer").select(F.concat(F.lit(f"{EX}nation#"), F.col("c_nationkey").cast("string")).alias("node"), "c_custkey")
    return P.belongs(wanted, P.match(lower(spark, d, "nation", predicates=(f"{N}n_name",)), p=f"{N}n_name").where("o like '%1%'"))


@query("p22_by_value", f"""WITH {sql("customer")} SELECT 'segment' AS how, s AS node FROM triples WHERE p = '{N}c_mktsegment' AND o = 'BUILDING'
UNION ALL SELECT 'type', s FROM triples WHERE p = '{TYPE}' AND o = '{N}Customer' UNION ALL SELECT 'value', s FROM triples WHERE o_kind = 'lit' AND o = 'MACHINERY'""")
def p22(spark, d):
    t = lower(spark, d, "customer")
    one = P.subjects_with(t, f"{N}c_mktsegment", "BUILDING").select(F.lit("segment").alias("how"), "node")
    two = P.of_type(t, f"{N}Customer").select(F.lit("type"), "node")
    return one.union(two).union(P.predicates_of_value(t, "MACHINERY").select(F.lit("value"), F.col("s")))


@query("j01_multi_hop", "SELECT r_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders per region, over customer, nation and region nodes: small hops are joined first, the orders' last."""
    t = lower(spark, d, "customer", "nation", "region", predicates=(f"{N}c_nationkey", f"{N}n_regionkey", f"{N}r_name"))
    start = P.of_type(lower(spark, d, "customer", predicates=(TYPE,)), f"{N}Customer").select("node")
    home = P.path(t, start, f"{N}c_nationkey", f"{N}n_regionkey", f"{N}r_name").select("node", F.col("end").alias("r_name"))
    placed = P.match(lower(spark, d, "orders", predicates=(f"{N}o_custkey",)), p=f"{N}o_custkey").groupBy(F.col("o").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return placed.join(home, "node").groupBy("r_name").agg(F.sum("n").alias("orders"))


@query("j02_lookup_or_create", f"WITH {sql('nation')}, w AS (SELECT DISTINCT c_nationkey + 10 AS k FROM customer) SELECT '{EX}nation#' || k AS node, coalesce(o, 'new') AS name FROM w LEFT JOIN (SELECT s, o FROM triples WHERE p = '{N}n_name') ON s = '{EX}nation#' || k")
def j02(spark, d):
    wanted = table(spark, d, "customer").select(F.concat(F.lit(f"{EX}nation#"), (F.col("c_nationkey") + 10).cast("string")).alias("s")).distinct()
    names = P.match(lower(spark, d, "nation", predicates=(f"{N}n_name",)), p=f"{N}n_name").select("s", "o")
    return wanted.join(names, "s", "left").select(F.col("s").alias("node"), F.coalesce("o", F.lit("new")).alias("name"))


@query("j04_owner_values", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j04(spark, d):
    t = lower(spark, d, "customer", "nation", "region", predicates=tuple(N + p for p in ("c_nationkey", "n_name", "n_regionkey", "r_name")))
    of = lambda p, a, b: P.match(t, p=f"{N}{p}").select(F.col("s").alias(a), F.col("o").alias(b))
    out = of("c_nationkey", "c", "n").join(of("n_name", "n", "n_name"), "n", "left").join(of("n_regionkey", "n", "r"), "n", "left").join(of("r_name", "r", "r_name"), "r", "left")
    return out.select(F.substring_index("c", "#", -1).cast("bigint").alias("c_custkey"), "n_name", "r_name")


@query("j05_exclude_parts", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j05(spark, d):
    t = lower(spark, d, "orders", predicates=(f"{N}o_orderstatus", f"{N}o_custkey"))
    done = P.match(t, p=f"{N}o_orderstatus", o="F").select("s").join(P.match(t, p=f"{N}o_custkey").select("s", "o"), "s").select(F.col("o").alias("node"))
    c = P.of_type(lower(spark, d, "customer", predicates=(TYPE,)), f"{N}Customer").select("node").distinct()
    return c.join(done, "node", "left_anti").select(F.substring_index("node", "#", -1).cast("bigint").alias("c_custkey"))


@query("j09_star", "SELECT '" + EX + "part#' || p_partkey AS s, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def j09(spark, d):
    own = (f"{N}p_name", f"{N}p_brand", f"{N}p_size")
    return P.star(lower(spark, d, "part", predicates=own), *own)


@query("a01_graph_info", f"""WITH {sql("customer", "nation", "region", "supplier")} SELECT ng, count(DISTINCT s) AS iri_subjects, CAST(0 AS BIGINT) AS blank_subjects, count(DISTINCT p) AS predicates, count(*) AS triples,
count(*) FILTER (o_kind = 'node') AS node_objects, count(*) FILTER (o_kind = 'lit') AS literals, CAST(0 AS BIGINT) AS members FROM triples GROUP BY ng""")
def a01(spark, d):
    return A.graph_info(lower(spark, d, "customer", "nation", "region", "supplier"))


@query("a02_stage_info", f"""WITH {sql("customer", "region")}, l AS (SELECT DISTINCT ng FROM triples), r AS (SELECT DISTINCT split_part(o, '#', 1) AS ng FROM triples WHERE o_kind = 'node' AND contains(o, '#'))
SELECT (SELECT count(*) FROM l) AS local_graphs, (SELECT count(*) FROM r WHERE ng NOT IN (SELECT ng FROM l)) AS referenced_graphs, (SELECT count(*) FROM triples) AS triples""")
def a02(spark, d):
    return A.stage_info(lower(spark, d, "customer", "region"))


@query("a04_node_counts", f"""WITH {sql("customer", "nation")}, x AS (SELECT s AS node, CAST(o_kind = 'node' AS INT) AS a, CAST(o_kind = 'lit' AS INT) AS b, 0 AS c FROM triples UNION ALL SELECT o, 0, 0, 1 FROM triples WHERE o_kind = 'node')
SELECT node, CAST(sum(a) AS BIGINT) AS as_subject_nodes, CAST(sum(b) AS BIGINT) AS as_subject_literals, CAST(sum(c) AS BIGINT) AS as_object FROM x GROUP BY node""")
def a04(spark, d):
    return A.node_counts(lower(spark, d, "customer", "nation"))


@query("a05_predicate_usage", f"WITH {sql('orders', 'customer')} SELECT p, count(DISTINCT s) AS subjects, count(*) AS uses FROM triples GROUP BY p")
def a05(spark, d):
    return A.predicate_usage(lower(spark, d, "orders", "customer"))


@query("a05_own_predicates", f"WITH {sql('orders', 'customer')} SELECT p, count(DISTINCT s) AS subjects, count(*) AS uses FROM triples WHERE p LIKE '{N}%' GROUP BY p")
def a05b(spark, d):
    return A.predicate_usage(lower(spark, d, "orders", "customer"), N.rstrip("#"))


@query("a01_import_counts", "SELECT 'http://ex.org/n' || n_nationkey AS ng, CAST(1 AS BIGINT) AS direct_imports, CAST(2 AS BIGINT) AS all_imports, c.n AS imported_by FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) c ON c_nationkey = n_nationkey")
def a01b(spark, d):
    from .queries_graphs import imports

    e = imports(spark, d)
    return A.import_counts(e).where("graph like 'n%'").select(F.concat(F.lit(EX), "graph").alias("ng"), "direct_imports", "all_imports", "imported_by")


@query("a06_values", "SELECT '" + EX + "customer' AS ng, string_agg(v, '|' ORDER BY v) AS vals FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)")
def a06(spark, d):
    return A.values_of(lower(spark, d, "customer", predicates=(f"{N}c_mktsegment",)), f"{N}c_mktsegment")


@query("a07_facet", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def a07(spark, d):
    return A.facet(table(spark, d, "documents"), "source", 5)


_LINE = " || ".join([*map(framed_sql, ("s", "p", "o_kind", "o", "o_dtype")), "'-'", "'-'", "'-'"])


@query("s09_graph_hash", f"WITH {sql('customer', 'nation', 'region')}, x AS (SELECT DISTINCT ng, sha256({_LINE}) AS d FROM triples) {tree_sql('x', 'ng')}")
def s09(spark, d):
    return A.graph_hash(lower(spark, d, "customer", "nation", "region"))


@query("s09_list_hash", f"""WITH l AS (SELECT l_orderkey % 100 AS ng, '_:l' || l_orderkey AS s, 'http://ex.org/part#' || l_partkey AS o, l_linenumber AS i FROM lineitem),
x AS (SELECT DISTINCT CAST(ng AS VARCHAR) AS ng, sha256({framed_sql("s")} || {framed_sql("'http://www.w3.org/1999/02/22-rdf-syntax-ns#first'")} || {framed_sql("'node'")} || {framed_sql("o")} || '---' || {framed_sql("i")}) AS d FROM l) {tree_sql("x", "ng")}""")
def s09b(spark, d):
    """Graphs of lists: equal members in other places give another hash."""
    return A.graph_hash(lists(spark, d).withColumn("ng", (F.substring("s", 4, 20).cast("bigint") % 100).cast("string")))


@query("s13_header_only", "SELECT 'http://ex.org/nation#' || n_nationkey AS importer, 'http://ex.org/region#' || n_regionkey AS imported FROM nation")
def s13(spark, d):
    return P.match(lower(spark, d, "nation", predicates=(f"{N}n_regionkey",)), p=f"{N}n_regionkey").select(F.col("s").alias("importer"), F.col("o").alias("imported"))


@query("s17_blobs", "SELECT sha256(text) AS hash, min(doc_id) AS first_doc, count(*) AS puts, strlen(min(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY text")
def s17(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.octet_length("text").alias("size"))
    return t.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("puts"), F.min("size").cast("bigint").alias("size"))


@query("l01_canonical_order", f"""WITH {sql("customer")} SELECT s, string_agg(o, '|' ORDER BY CASE o_kind WHEN 'node' THEN 0 ELSE 1 END, p, o) AS os FROM triples GROUP BY s""")
def l01(spark, d):
    return P.rendered(lower(spark, d, "customer")).select("s", "os")


@query("l01_member_order", "SELECT '_:l' || l_orderkey AS s, string_agg('http://ex.org/part#' || l_partkey, '|' ORDER BY l_linenumber, 'http://ex.org/part#' || l_partkey) AS os FROM lineitem GROUP BY 1")
def l01b(spark, d):
    return P.rendered(lists(spark, d)).select("s", "os")


@query("l02_node_order", f"WITH {sql(*SMALL)}, n AS (SELECT DISTINCT p AS node FROM triples UNION SELECT s FROM triples) SELECT node, row_number() OVER (ORDER BY node <> '{TYPE}', split_part(node, '#', 1), split_part(node, '#', 2)) - 1 AS rank FROM n")
def l02(spark, d):
    t = lower(spark, d, *SMALL)
    every = t.select(F.col("p").alias("node")).union(t.select("s")).distinct()
    return O.ranked(every, O.node_key(F.col("node")))


@query("l03_literal_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS by_value FROM orders")
def l03(spark, d):
    return O.ranked(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], "by_value").select("o_orderkey", "by_value")


@query("l03_canonical_literals", f"WITH {sql('part')}, l AS (SELECT DISTINCT o, o_dtype FROM triples WHERE o_kind = 'lit') SELECT o, o_dtype, row_number() OVER (ORDER BY o_dtype, CASE WHEN o_dtype LIKE '%integer' THEN lpad(printf('%X', CAST(o AS BIGINT)), 16, '0') END, hex(encode(o))) - 1 AS rank FROM l")
def l03b(spark, d):
    t = lower(spark, d, "part").where("o_kind = 'lit'").select("o", "o_dtype").distinct()
    return O.ranked(t, O.literal_key(F.col("o"), F.col("o_dtype")))


@query("l04_file_order", "SELECT 'http://ex.org/customer#' || c_custkey AS node, false AS is_blank, 0 AS uses, row_number() OVER (ORDER BY 'http://ex.org/customer#' || c_custkey) - 1 AS rank FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders) UNION ALL SELECT '_:o' || o_orderkey, true, 1, (SELECT count(DISTINCT o_custkey) FROM orders) + row_number() OVER (ORDER BY '_:o' || o_orderkey) - 1 FROM orders")
def l04(spark, d):
    return O.file_order(_blanks(spark, d))


@query("l05_sorted_nodes", f"WITH {sql('customer')} SELECT s AS node, row_number() OVER (ORDER BY split_part(s, '#', 2)) - 1 AS rank FROM (SELECT DISTINCT s FROM triples)")
def l05(spark, d):
    return O.sorted_nodes(lower(spark, d, "customer", "nation", predicates=(TYPE,)), f"{EX}customer")


@query("l06_log_page", "SELECT event_id AS key FROM events WHERE event_id <= 500 AND event_id > 450 ORDER BY event_id DESC")
def l06(spark, d):
    from ..operators.revisions import log_page

    return log_page(table(spark, d, "events").select(F.col("event_id").alias("key")), 500, 450)


@query("l07_page", "SELECT doc_id, lang FROM documents ORDER BY lang DESC, doc_id LIMIT 10 OFFSET 20")
def l07(spark, d):
    from ..operators.search import page

    return page(table(spark, d, "documents").select("doc_id", "lang"), ["-lang", "doc_id"], 20, 10)


@query("l09_natural_key", "SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all('A' || o_orderkey || '-' || o_custkey, '(\\d+|\\D+)', 1), lambda t: CASE WHEN regexp_matches(t, '^\\d') AND length(t) < 10 THEN lpad(t, 10, '0') ELSE t END), '') AS k FROM orders")
def l09(spark, d):
    c = F.concat(F.lit("A"), F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", S.natural_key(c).alias("k"))


@query("l08_id_groups", "WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT 'P' || l_partkey)) AS ids FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, row_number() OVER (ORDER BY CASE WHEN len(ids) = 1 THEN 0 ELSE 1 END, array_to_string(ids, chr(1)), l_orderkey) - 1 AS rank FROM g")
def l08(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("ids"))
    return O.ranked(g, [*O.id_groups(g, "ids"), F.col("l_orderkey")]).select("l_orderkey", "rank")


@query("l10_priority", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) - 1 AS rank FROM orders")
def l10(spark, d):
    return O.ranked(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), [O.priority(F.col("o_orderstatus"), "P", "O"), F.col("o_orderkey")]).select("o_orderkey", "rank")


@query("l11_sorted_distinct", f"WITH {sql('customer')}, x AS (SELECT DISTINCT s, p FROM triples) SELECT s, p, row_number() OVER (ORDER BY s, p) - 1 AS rank FROM x")
def l11(spark, d):
    return O.ranked(lower(spark, d, "customer").select("s", "p").distinct(), [F.col("s"), F.col("p")])
