"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import EX, TYPE, XSD, lower, sql, table
from ..shipping import ship
from .registry import query


@query("f01_split_iri", f"WITH {sql('nation')} SELECT DISTINCT s, split_part(s, '#', 1) AS base, split_part(s, '#', 2) AS fragment FROM triples")
def f01(spark, d):
    c = F.col("s")
    return lower(spark, d, "nation").select("s", S.iri_base(c).alias("base"), S.iri_fragment(c).alias("fragment")).distinct()


@query("f02_is_iri", "SELECT page_id, url LIKE '%:%' AND NOT contains(url, ' ') AS valid, false AS no_scheme FROM pages")
def f02(spark, d):
    return table(spark, d, "pages").select("page_id", S.is_iri(F.col("url")).alias("valid"), S.is_iri(F.concat(F.lit("/x/"), F.col("page_id").cast("string"))).alias("no_scheme"))


@query("f03_split", "SELECT page_id, regexp_extract(url, '^(.*[/#])([^/#]*)$', 1) AS prefix, regexp_extract(url, '^(.*[/#])([^/#]*)$', 2) AS suffix FROM pages")
def f03(spark, d):
    return table(spark, d, "pages").select("page_id", S.split_prefix(F.col("url")).alias("prefix"), S.split_suffix(F.col("url")).alias("suffix"))


@query("f04_graph_id", f"""WITH h AS (SELECT url, sha1(from_hex('{S.URL_NAMESPACE}') || encode(regexp_replace(url, '#$', ''))) AS h FROM pages)
SELECT url, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (position(h[17:17] IN '0123456789abcdef') - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""")
def f04(spark, d):
    return table(spark, d, "pages").select("url", S.graph_id(F.col("url")).alias("id"))


@query("f05_hash", "SELECT page_id, sha256(url) AS h FROM pages")
def f05(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("url").cast("binary"), 256).alias("h"))


@query("f05_base58")
def f05b(spark, d):
    ship(spark)
    return table(spark, d, "pages").select("page_id", S.base58_udf()(F.unhex(F.sha2(F.col("url").cast("binary"), 256))).alias("h"))


@query("f05_base58_decode", "SELECT page_id, sha256(url) AS h FROM pages")
def f05c(spark, d):
    """There and back."""
    ship(spark)
    return table(spark, d, "pages").select("page_id", F.lower(F.hex(S.base58_decode_udf()(S.base58_udf()(F.unhex(F.sha2(F.col("url").cast("binary"), 256)))))).alias("h"))


@query("f06_short_hash", "SELECT page_id FROM pages WHERE sha256(url) LIKE 'a%'")
def f06(spark, d):
    h = F.sha2(F.col("url").cast("binary"), 256)
    return table(spark, d, "pages").where(h.between(*S.short_hash_range("a", "0123456789abcdef", 64))).select("page_id")


@query("f07_display", f"WITH {sql('supplier')} SELECT s, p, CASE WHEN o_dtype = '{XSD}string' THEN '\"' || o || '\"' ELSE o END AS shown FROM triples WHERE o_kind = 'lit'")
def f07(spark, d):
    t = lower(spark, d, "supplier").where("o_kind = 'lit'")
    return t.select("s", "p", S.display(F.col("o"), F.col("o_dtype"), F.col("o_lang")).alias("shown"))


@query("f08_canonical", f"WITH {sql('supplier')} SELECT s, p, CASE WHEN o_kind = 'node' THEN '<' || o || '>' ELSE '\"' || o || '\"^^<' || coalesce(o_dtype, '') || '>' END AS key FROM triples")
def f08(spark, d):
    return lower(spark, d, "supplier").select("s", "p", S.canonical(F.col("o_kind"), F.col("o"), F.col("o_dtype")).alias("key"))


@query("f09_typed", f"WITH {sql('part')} SELECT s, max(CASE WHEN o_dtype = '{XSD}integer' THEN CAST(o AS BIGINT) END) AS size, CAST(floor(max(CASE WHEN o_dtype = '{XSD}double' THEN CAST(o AS DOUBLE) END)) AS BIGINT) AS price FROM triples WHERE o_kind = 'lit' AND o_dtype <> '{XSD}string' GROUP BY s")
def f09(spark, d):
    t = lower(spark, d, "part").where("o_kind = 'lit'")
    v = lambda k: F.max(S.typed(F.col("o"), F.col("o_dtype"), k))
    return t.groupBy("s").agg(v("integer").alias("size"), F.floor(v("double")).cast("bigint").alias("price"))


@query("f10_lang_tag", """SELECT doc_id, regexp_full_match(lang, '[A-Za-z]+(-[A-Za-z0-9]+)*') AS plain, regexp_full_match(lang || '-x1', '[A-Za-z]+(-[A-Za-z0-9]+)*') AS region,
regexp_full_match(coalesce(text, ''), '[A-Za-z]+(-[A-Za-z0-9]+)*') AS of_text FROM documents""")
def f10(spark, d):
    c = F.col("lang")
    return table(spark, d, "documents").select("doc_id", S.is_lang_tag(c).alias("plain"), S.is_lang_tag(F.concat(c, F.lit("-x1"))).alias("region"), S.is_lang_tag(F.coalesce("text", F.lit(""))).alias("of_text"))


@query("f12_prefixed", f"WITH {sql('nation', 'region')} SELECT DISTINCT s, CASE WHEN s LIKE '%nation#%' THEN 'n:' ELSE 'ns7:' END || split_part(s, '#', 2) AS short FROM triples")
def f12(spark, d):
    t = lower(spark, d, "nation", "region", predicates=(TYPE,)).select("s").distinct()
    prefixes = spark.createDataFrame([(f"{EX}nation", "n", 1), (f"{EX}region", None, 7)], "base string, prefix string, number int")
    return t.withColumn("base", S.iri_base(F.col("s"))).join(prefixes, "base", "left").select("s", S.prefixed(F.col("base"), S.iri_fragment(F.col("s")), F.col("prefix"), F.col("number")).alias("short"))


@query("f13_camel", """SELECT p_partkey, 'Has' || replace(p_brand, '#', '') || 'ID' AS name, 'Part_urlOf' || replace(p_brand, '#', '') AS inner_url, 'URL' || replace(p_brand, '#', '') || '_idIDs' AS two FROM part""")
def f13(spark, d):
    name = lambda *parts: S.camel(F.concat(*(F.col(x) if x == "p_brand" else F.lit(x) for x in parts)))
    return table(spark, d, "part").select("p_partkey", name("has-", "p_brand", "-id").alias("name"), name("part_url-of-", "p_brand").alias("inner_url"), name("url-", "p_brand", "_id-iDs").alias("two"))


@query("f15_token", "SELECT p_partkey, lower(translate(trim(p_type, '-_/ '), '_/ ', '---')) AS t FROM part")
def f15(spark, d):
    return table(spark, d, "part").select("p_partkey", S.separated_token(F.col("p_type")).alias("t"))


@query("f16_phrase", "SELECT p_partkey, lower(p_type) AS t FROM part")
def f16(spark, d):
    return table(spark, d, "part").select("p_partkey", S.phrase_token(F.col("p_type")).alias("t"))


@query("f17_base64", "SELECT page_id, translate(to_base64(encode(url)), '+/', '-_') AS b FROM pages")
def f17(spark, d):
    return table(spark, d, "pages").select("page_id", S.base64_url(F.col("url")).alias("b"))


@query("f18_vault_path", "SELECT page_id, upper(sha256(url)[1:2]) || '/' || sha256(url)[3:64] AS path FROM pages")
def f18(spark, d):
    return table(spark, d, "pages").select("page_id", S.vault_path(F.sha2(F.col("url").cast("binary"), 256)).alias("path"))


@query("f19_encodings", "SELECT page_id, sha256(url) AS hex, to_base64(from_hex(sha256(url))) AS b64 FROM pages")
def f19(spark, d):
    h = F.upper(F.sha2(F.col("url").cast("binary"), 256))
    return table(spark, d, "pages").select("page_id", S.encoded(h, "hex").alias("hex"), S.encoded(h, "base64").alias("b64"))


@query("f20_order_bytes", "SELECT o_orderkey, lpad(printf('%X', o_orderkey), 16, '0') AS k, CASE WHEN o_orderkey > 500 THEN lpad(printf('%X', o_orderkey - 500), 16, '0') ELSE printf('%X', CAST(o_orderkey - 500 AS BIGINT)) END AS below, o_orderkey - 500 AS back FROM orders WHERE o_orderkey <> 500")
def f20(spark, d):
    below = F.col("o_orderkey") - 500
    return table(spark, d, "orders").where("o_orderkey <> 500").select("o_orderkey", S.order_bytes(F.col("o_orderkey")).alias("k"), S.order_bytes(below).alias("below"), S.number_of_bytes(S.order_bytes(below)).alias("back"))


@query("f20_value_bytes", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders")
def f20b(spark, d):
    from ..operators.order import ranked

    return ranked(table(spark, d, "orders").select("o_orderkey", S.value_bytes(F.col("o_orderkey") - 3000).alias("k")), [F.col("k")]).select("o_orderkey", "rank")


@query("f21_floats", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) + o_custkey AS total, CAST(2 AS INT) AS n FROM orders")
def f21(spark, d):
    v = S.floats(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("  "), F.col("o_custkey").cast("string")))
    return table(spark, d, "orders").select("o_orderkey", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(v).alias("n"))


@query("f22_points", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x, CAST(o_orderkey AS DOUBLE) AS y, -1.5 AS x2, CAST(3 AS INT) AS n FROM orders")
def f22(spark, d):
    p = S.points(F.concat(F.col("o_custkey").cast("string"), F.lit(","), F.col("o_orderkey").cast("string"), F.lit(" -1.5.25 3e2,4 7")))
    return table(spark, d, "orders").select("o_orderkey", p[0]["x"].alias("x"), p[0]["y"].alias("y"), p[1]["x"].alias("x2"), F.size(p).alias("n"))


@query("f22_path", "SELECT o_orderkey, 'MlAz' AS commands, CAST(o_custkey AS DOUBLE) AS x, CAST(13 AS INT) AS n_args, CAST(o_orderkey AS DOUBLE) AS last FROM orders")
def f22b(spark, d):
    text = F.concat(F.lit("M"), F.col("o_custkey").cast("string"), F.lit("-2 l 1e1,.5-3 4A1 1 0 1,0 "), F.col("o_custkey").cast("string"), F.lit(","), F.col("o_orderkey").cast("string"), F.lit(" z"))
    c = S.path_commands(text)
    every = F.flatten(F.transform(c, lambda x: x["args"]))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(c, lambda x: x["command"]), "").alias("commands"), c[0]["args"][0].alias("x"), F.size(every).alias("n_args"), F.element_at(every, -1).alias("last"))


@query("f23_affine", "SELECT o_orderkey, o_custkey * 2.0 AS a, 3.0 * o_custkey + 1.0 AS e FROM orders")
def f23(spark, d):
    k = F.col("o_custkey").cast("double")
    m = S.affine((k, F.lit(0.0), F.lit(0.0), k, F.lit(1.0), F.lit(0.0)), (F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(3.0), F.lit(0.0)))
    return table(spark, d, "orders").select("o_orderkey", m[0].alias("a"), m[4].alias("e"))


@query("f24_arc_center", "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS cx, CAST(l_suppkey AS DOUBLE) AS cy, CAST(l_partkey AS DOUBLE) AS qx, CAST(l_suppkey AS DOUBLE) AS qy FROM lineitem")
def f24(spark, d):
    """The centres of a half circle and of a quarter of one, around (l_partkey, l_suppkey)."""
    t, q, z = table(spark, d, "lineitem"), F.col("l_quantity"), F.lit(0.0)
    x, y = F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double")
    cx, cy = S.arc_center(x - q, y, x + q, y, q, q, z, F.lit(0), F.lit(1))
    qx, qy = S.arc_center(x + q, y, x, y + q, q, q, z, F.lit(0), F.lit(1))
    return t.select("l_orderkey", "l_linenumber", *((F.round(c, 6) + 0.0).alias(n) for c, n in ((cx, "cx"), (cy, "cy"), (qx, "qx"), (qy, "qy"))))


@query("f25_arc_text", "SELECT o_orderkey, 'M ' || (o_custkey + 2) || ' 0 A 2 2 0 ' || CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END || ' 1 ' || o_custkey || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN '-2' ELSE '2' END AS d FROM orders")
def f25(spark, d):
    """A quarter and three quarters of a circle, from its right."""
    end = F.when(F.col("o_orderkey") % 2 == 0, 1.5 * 3.141592653589793).otherwise(0.5 * 3.141592653589793)
    return table(spark, d, "orders").select("o_orderkey", S.arc_text(F.col("o_custkey"), F.lit(0), F.lit(2), F.lit(2), F.lit(0.0), end).alias("d"))


@query("f26_inherit", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE o_orderstatus END AS v FROM orders")
def f26(spark, d):
    child = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", S.inherit(child, F.col("o_orderpriority")).alias("v"))


@query("f27_media", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE 'application/octet-stream' END AS m, CASE WHEN page_id % 2 = 0 THEN 'html' END AS ext FROM pages")
def f27(spark, d):
    m = S.media_type(F.expr("if(page_id % 2 = 0, 'a.HTML', 'b.zzz')"))
    return table(spark, d, "pages").select("page_id", m.alias("m"), S.extension(m).alias("ext"))


@query("f27_content", "SELECT page_id, CASE WHEN lower(ltrim(html)[1:64]) LIKE '<!doctype html%' OR lower(ltrim(html)[1:64]) LIKE '<html%' THEN 'text/html' ELSE 'text/plain' END AS m FROM pages WHERE html IS NOT NULL")
def f27b(spark, d):
    return table(spark, d, "pages").where("html is not null").select("page_id", S.media_of_content(F.col("html")).alias("m"))


@query("f29_literals", f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS o, '{XSD}integer' AS o_dtype, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o2, o_orderpriority || '@en' AS o3 FROM orders")
def f29(spark, d):
    a, b, c = S.literal(F.col("o_orderkey"), "integer"), S.literal(F.col("o_orderdate"), "dateTime"), S.literal(F.col("o_orderpriority"), "langString", F.lit("en"))
    return table(spark, d, "orders").select("o_orderkey", a["o"].alias("o"), a["o_dtype"].alias("o_dtype"), b["o"].alias("o2"), F.concat(c["o"], F.lit("@"), c["o_lang"]).alias("o3"))
