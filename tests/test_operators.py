"""Algebraic properties and cases of the graph operators."""

import pytest
from pyspark.sql import functions as F

from knotwork.functions import scalars as S
from knotwork.model import FIRST, KEY, RDFS, SCHEMA, TYPE
from knotwork.operators import aggregates, graphs, lists, mutations, patterns, search, setops
from knotwork.operators.revisions import Repository, log_page


def triples(spark, *rows):
    """(ng, s, p, o): an object that starts with ' is a literal."""
    full = [(g, "blank" if s.startswith("_:") else "iri", s, p, "lit" if o.startswith("'") else "node", o.strip("'"), None, None, None, None) for g, s, p, o in rows]
    return spark.createDataFrame(full, SCHEMA)


def key(df):
    return sorted(map(tuple, df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY)).collect()))


@pytest.fixture(scope="module")
def two(spark):
    a = triples(spark, ("g", "s1", "p", "'x"), ("g", "s1", "p", "s2"), ("g", "_:b", "p", "'y"), ("h", "s3", "q", "s1"))
    b = triples(spark, ("g", "s1", "p", "'x"), ("g", "s1", "p", "s3"), ("h", "s3", "q", "s1"), ("h", "s3", "q", "'1"))
    return a, b


def test_patch_of_diff(two):
    a, b = two
    assert key(setops.patch(a, setops.diff(a, b))) == key(b)
    assert setops.diff(a, a).isEmpty()
    assert key(setops.union(a, a)) == key(a) and key(setops.union(a, b)) == key(setops.union(b, a))


def test_hash_ignores_order(two):
    a, _ = two
    one = aggregates.graph_hash(a).orderBy("ng").collect()
    assert one == aggregates.graph_hash(a.orderBy(F.desc("o")).repartition(3)).orderBy("ng").collect()


def test_touching_and_delete(two):
    a, _ = two
    assert patterns.touching(a, "s1").count() == 3
    assert mutations.delete_node(a, "s1").count() == 1
    assert key(mutations.add(a, a)) == key(a)
    with pytest.raises(Exception, match="duplicate triple"):
        mutations.add(a, a, strict=True).collect()


def test_graph_algorithms(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "a string, b string")
    assert {r["node"] for r in graphs.cyclic(e).collect()} == {"a", "b", "c"}
    assert {tuple(r) for r in graphs.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    assert graphs.closure(e).where("a = 'x'").count() == 1
    long = spark.range(40).select(F.format_string("n%02d", "id").alias("a"), F.format_string("n%02d", F.col("id") + 1).alias("b"))
    assert {r["component"] for r in graphs.components(long).collect()} == {"n00"}
    up = spark.createDataFrame([("e", "c"), ("d", "c"), ("c", "b"), ("b", "a")], "a string, b string")
    assert graphs.common_ancestor(up, "e", "d").first()["node"] == "c"
    assert [graphs.ancestry(up, *p).first()[0] for p in (("e", "a"), ("a", "e"), ("e", "d"), ("e", "e"))] == ["newer", "older", "diverged", "same"]
    with pytest.raises(ValueError, match="cycle"):
        mutations.add_imports(up.toDF("importer", "imported"), spark.createDataFrame([("a", "e")], "importer string, imported string"))


def test_components_brute(spark):
    import random

    r = random.Random(3)
    name = [f"n{i}" for i in r.sample(range(1000), 400)]
    pairs = [(name[i], name[i + 1]) for i in range(399) if i % 90 != 89] + [(r.choice(name[:80]), r.choice(name[:80])) for _ in range(20)]
    root = {n: n for p in pairs for n in p}
    for a, b in pairs:
        x, y = root[a], root[b]
        root = {n: min(x, y) if c in (x, y) else c for n, c in root.items()}
    got = graphs.components(spark.createDataFrame(pairs, "a string, b string"))
    assert {tuple(x) for x in got.collect()} == set(root.items())


def test_rounds_keep_estimates_small(spark):
    df = spark.range(3).toDF("k")
    for _ in range(6):
        df = graphs.checkpointed(df.join(df.select("k"), "k").join(df.select("k"), "k"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() <= 64
    assert df.count() == 3


def test_lists(spark):
    df = spark.createDataFrame([("_:l", ["a", "b"]), ("_:e", [])], "owner string, m array<string>")
    got = {tuple(r) for r in lists.build(df, "owner", "m").collect()}
    assert got == {("_:l", 0, "a"), ("_:l", 1, "b")}
    assert spark.sql("select array('1','2') as m").select(lists.rendered(F.col("m"))).first()[0] == "( 1 2 )"
    assert FIRST.endswith("first")


def test_repository(spark, tmp_path, two):
    a, b = two
    r = Repository(spark, f"file://{tmp_path}/r")
    c1 = r.commit("ds", a, "me", "2020-01-01 00:00:00", "one")
    c2 = r.commit("ds", b, "me", "2020-01-02 00:00:00", "two", parents=(c1,))
    assert key(r.checkout(c1)) == key(a) and key(r.checkout_branch("ds")) == key(b)
    c3 = r.commit("ds", a, "me", "2020-01-03 00:00:00", "three")  # its tip isn't a parent, so it becomes a leaf
    assert {x["commit"] for x in r.leaves("ds").collect()} == {c2} and r.branches("ds").first()["commit"] == c3
    assert {(x["commit"], x["depth"]) for x in r.history(c2).select("commit", "depth").collect()} == {(c2, 0), (c1, 1)}
    assert {tuple(x) for x in r.commit_diff(c2, c1).collect()} == {("g", "modified"), ("h", "modified")}
    assert r.table("ng_revisions").select("hash").distinct().count() == 4  # equal content is stored once
    r.set_branch("ds", "old", c2)
    with pytest.raises(ValueError):
        r.set_branch("ds", "old", "nothing")
    other = Repository(spark, f"file://{tmp_path}/o")
    other.sync_from(r)
    assert key(other.checkout(c2)) == key(b) and other.refs().count() == r.refs().count()
    assert [x["key"] for x in log_page(r.table("repo_log"), None, -2).collect()] == [4, 3]


def test_search(spark):
    df = spark.createDataFrame([(1, "Red apple pie", "en"), (2, "green Apple", "de"), (3, "pear", "en")], "id int, text string, lang string")
    ids = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    assert ids(search.match(df, "text", "APPLE pear")) == [1, 2, 3]
    for q, want in {"apple": [1, 2], "+apple -green": [1], "lang:en": [1, 3], "+lang:en pear": [1, 3], '"apple pie"': [1], "nothing": []}.items():
        assert ids(df.where(search.condition(q, "text", ("lang",)))) == want, q
    assert [r["id"] for r in search.page(df, ["-id"], 1, 1).collect()] == [2]


def test_scalars(spark):
    import hashlib
    import uuid

    row = spark.sql("select 'http://a/b#c' as i, 'x12y3' as n").select(S.graph_id(F.lit("http://a/b#")), S.natural_key(F.col("n")), S.iri_fragment(F.col("i")), S.camel(F.lit("part_id-of thing-url-hasId")), S.separated_token(F.lit("_A b/c-"))).first()
    assert tuple(row) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "http://a/b")), "x0000000012y0000000003", "c", "Part_idOfthingURLHasID", "a-b-c")
    h = hashlib.sha256(b"x").digest()
    assert S.base58_decode(S.base58(h)) == h and len(S.base58(b"\0" * 32)) == 44
    lo, hi = S.short_hash_range("abc")
    assert lo <= "abc" + "z" * 41 <= hi
    assert S.affine((1, 0, 0, 1, 5, 6), (2, 0, 0, 2, 0, 0)) == (2, 0, 0, 2, 5, 6)


def test_types_of_nodes(spark):
    t = triples(spark, ("g", "n", TYPE, "C"), ("g", "n", f"{RDFS}label", "'x"), ("g", "_:b", "p", "n"))
    assert {(r["node"], r["is_blank"]) for r in patterns.nodes(t).collect()} == {("n", False), ("_:b", True), ("C", False)}


def listed(spark, *rows):
    """(s, member, place) as rdf:first rows of one graph."""
    return spark.createDataFrame([("g", "blank", s, FIRST, "lit", o, None, None, None, i) for s, o, i in rows], SCHEMA)


def test_places_and_languages_count(spark, tmp_path):
    a, b = listed(spark, ("_:l", "a", 0), ("_:l", "a", 1), ("_:l", "b", 2)), listed(spark, ("_:l", "b", 0), ("_:l", "a", 1), ("_:l", "a", 2))
    hashed = lambda t: aggregates.graph_hash(t).first()["hash"]
    assert hashed(a) != hashed(b) and not setops.equal(a, b).first()["equal"]
    assert setops.union(a, a).count() == 3 and setops.diff(a, b).count() == 4 and key(setops.patch(a, setops.diff(a, b))) == key(b)
    tagged = lambda lang: spark.createDataFrame([("g", "iri", "s", "p", "lit", "x", None, lang, None, None)], SCHEMA)
    assert hashed(tagged("en")) != hashed(tagged("de")) and setops.diff(tagged("en"), tagged("de")).count() == 2
    frames = spark.createDataFrame([("g", "iri", "s", "p", "lit", "x\ty", None, None, None, None)], SCHEMA), spark.createDataFrame([("g", "iri", "s\tp", "lit", "lit", "x", None, "y", None, None)], SCHEMA)
    assert hashed(frames[0]) != hashed(frames[1])
    r = Repository(spark, f"file://{tmp_path}/r")
    one = r.commit("ds", tagged("en"), "me", "2020-01-01 00:00:00", "en")
    two = r.commit("ds", tagged("de"), "me", "2020-01-02 00:00:00", "de", parents=(one,))
    three = r.commit("ds", a, "me", "2020-01-03 00:00:00", "a", parents=(two,))
    four = r.commit("ds", b, "me", "2020-01-04 00:00:00", "b", parents=(three,))
    assert [r.checkout(c).first()["o_lang"] for c in (one, two)] == ["en", "de"]
    assert key(r.checkout(three)) == key(a) and key(r.checkout(four)) == key(b)
    assert r.commit_diff(two, one).first()["change"] == "modified"


def test_checkout_reads_its_partitions(spark, tmp_path, two):
    r = Repository(spark, f"file://{tmp_path}/r")
    c = r.commit("ds", two[0], "me", "2020-01-01 00:00:00", "one")
    plan = r.checkout(c)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "hp" in plan.split("PartitionFilters: [")[1].split("]")[0]
    h = r.graphs_of(c).where("ng = 'h'").first()["hash"]
    assert r.revision(h).count() == 1 and r.blob("00") is None
    r.put_blobs(spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (None,), (bytearray(b""),)], "data binary"))
    assert r.table("blobs").count() == 2 and r.blob(__import__("hashlib").sha256(b"x").hexdigest()) == b"x"
    with pytest.raises(ValueError):
        r.checkout("nothing")
    with pytest.raises(RuntimeError, match="another writer"):
        r._set_refs([], r.version() - 1)


def test_a_circle_of_cells_ends(spark):
    from knotwork.model import NIL, REST

    rows = [("a", "b"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", NIL), ("lost", "nowhere")]
    full = [("g", "blank", s, REST, "node", o, None, None, None, None) for s, o in rows] + [("g", "blank", s, FIRST, "lit", s, None, None, None, None) for s, _ in rows]
    t = spark.createDataFrame(full, SCHEMA)
    assert {(r["node"], r["member_idx"], r["o"]) for r in lists.collapse(t).collect()} == {("x", 0, "x"), ("x", 1, "y"), ("lost", 0, "lost")}
    assert {r["cell"] for r in lists.endless(t).collect()} == {"a", "b", "c"}
    long = spark.createDataFrame([("g", f"n{i}", REST, f"n{i + 1}" if i < 99 else NIL) for i in range(100)] + [("g", f"n{i}", FIRST, str(i)) for i in range(100)], "ng string, s string, p string, o string")
    got = lists.collapse(long.withColumn("o_kind", F.lit("lit")).withColumn("o_dtype", F.lit(None).cast("string"))).collect()
    assert sorted((r["member_idx"], r["o"]) for r in got) == [(i, str(i)) for i in range(100)]


def test_only_wanted_columns_are_read(spark):
    from knotwork.model import SCHEMA_NS, lower

    if not __import__("os").path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the test tables")
    t = lower(spark, "/root/testdata/sf0.001", "orders", predicates=(f"{SCHEMA_NS}o_custkey",))
    plan = patterns.match(t, p=f"{SCHEMA_NS}o_custkey").groupBy("o").count()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan or "ReadSchema: struct<o_custkey:bigint>" in plan
    assert "Generate" not in plan
    every = lower(spark, "/root/testdata/sf0.001", "orders").where(F.col("p") == f"{SCHEMA_NS}o_custkey")
    assert key(every) == key(t)


def test_mutations_raise(spark, two):
    a, _ = two
    names = spark.createDataFrame([("s1", "s3", None)], "old string, new string, ng string")
    with pytest.raises(Exception, match="the name is taken"):
        mutations.rename(a, names, strict=True).collect()
    g = spark.createDataFrame([("g", False, False)], "ng string, is_referenced boolean, deleted boolean")
    with pytest.raises(Exception, match="the graph exists"):
        mutations.new_graphs(g, spark.createDataFrame([("g",)], "ng string")).collect()
    with pytest.raises(Exception, match="the node exists"):
        mutations.new_nodes(triples(spark, ("g", "g#x", "p", "'1")), spark.createDataFrame([("g", "x", ["T"])], "ng string, fragment string, types array<string>")).collect()


def test_ranks(spark):
    from knotwork.operators.order import ranked

    df = spark.range(500).select(((F.col("id") * 7919) % 500).alias("k"), F.lit("x").alias("v")).repartition(5)
    assert sorted((r["k"], r["rank"]) for r in ranked(df, [F.desc("k")]).collect()) == [(k, 499 - k) for k in range(500)]


def test_partition_without_circles(spark):
    t = triples(spark, ("g", "a1", "p", "b1"), ("g", "b1", "p", "c1"), ("g", "c1", "p", "a2"), ("g", "a2", "p", "'x"), ("g", "lone", "p", "'y"), ("g", "b2", "p", "a1"), ("g", "d", "p", "a2"))
    groups = spark.createDataFrame([("A", "a1"), ("A", "a2"), ("B", "b1"), ("B", "b2"), ("C", "d")], "grp string, node string")
    out, imports = graphs.partitioned(t, groups, "S")
    assert out.count() == t.count()
    edges = imports.toDF("a", "b")
    assert graphs.cyclic(edges).isEmpty() and ("S",) not in {(r["a"],) for r in edges.collect()}


def test_name_parts(spark):
    names = {"hasId": "HasID", "has_id": "Has_id", "part-of": "PartOf", "uuid-x": "UUIDX", "Idea-id": "IdeaId", "a.b-uRl": "AbURl"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.camel(F.col("n")).alias("c")).collect()
    assert {r["n"]: r["c"] for r in got} == names
    h = "".join(f"{b:02x}" for b in __import__("hashlib").sha256(b"y").digest())
    want = __import__("base64").b32encode(bytes.fromhex(h)).decode().rstrip("=")
    assert spark.sql(f"select '{h}' as h").select(S.base32(F.col("h"))).first()[0] == want


def test_rounds_of_endless_follow_the_longest_list(spark, monkeypatch):
    """Many short lists beside a circle: rounds follow the lists' length, not how many cells there are."""
    from knotwork.model import NIL, REST

    rounds = []
    monkeypatch.setattr(lists, "checkpointed", lambda df, f=lists.checkpointed: rounds.append(1) or f(df))
    cells = [(f"{i}-{j}", f"{i}-{j + 1}" if j < 2 else NIL) for i in range(300) for j in range(3)] + [("a", "b"), ("b", "c"), ("c", "a"), ("in", "a"), ("lost", "nowhere")]
    t = spark.createDataFrame([("g", s, REST, o, "node", None) for s, o in cells] + [("g", s, FIRST, s, "lit", None) for s, _ in cells], "ng string, s string, p string, o string, o_kind string, o_dtype string")
    assert {r["cell"] for r in lists.endless(t).collect()} == {"a", "b", "c", "in"}
    assert len(rounds) <= 5
    got = {(r["node"], r["member_idx"], r["o"]) for r in lists.collapse(t).collect()}
    assert got == {(f"{i}-0", j, f"{i}-{j}") for i in range(300) for j in range(3)} | {("lost", 0, "lost")}


def test_validation_never_broadcasts_data(spark, tmp_path):
    """A compressed file's size tells little about its rows: joins build on the ontology's side alone."""
    import re

    from knotwork.model import SCHEMA_NS, lower
    from knotwork.operators import validate, vocab
    from knotwork.plans.queries_rules import ontology

    for name, rows, kind in (("customer", [(1, "a", 1, 2.0, "x"), (2, "b", 9, 1.0, "y")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"), ("nation", [(1, "n", 0)], "n_nationkey int, n_name string, n_regionkey int")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    o = ontology(spark)
    e, k = vocab.elements(o), vocab.kinds(o)
    t = lower(spark, str(tmp_path), "customer", "nation")
    found = validate.domain_and_range(t, e, vocab.inherited(e, k), k)
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (found, validate.functional(t, e, k))]
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" in plans[1]
    for p in plans:
        assert not re.search(r"BuildLeft|BroadcastHashJoin[^\n]*Left(Anti|Semi)", p)
    assert sorted((r["rule"], r["predicate"], r["subject"].rpartition("#")[2]) for r in found.collect()) == [("predicate_unknown", f"{SCHEMA_NS}c_mktsegment", i) for i in "12"]
