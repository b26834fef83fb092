"""Queries that commit to a repository and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..model import EX, SCHEMA_NS, lower, sql, table
from ..operators import graphs as G
from ..operators import revisions as R
from .registry import query

N = SCHEMA_NS


def _folder(spark) -> str:
    """A fresh folder in the shared place."""
    G.checkpointed(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/repo-{uuid.uuid4().hex}"


def _repository(spark, t):
    """Two commits on master, nations, then nations and regions; one of a second dataset, suppliers."""
    r = R.Repository(spark, _folder(spark))
    one = r.commit("ds", t.where("ng like '%nation'"), "me", "2020-01-01 00:00:00", "one")
    two = r.commit("ds", t.where("ng not like '%supplier'"), "me", "2020-01-02 00:00:00", "two", parents=(one,))
    r.commit("other", t.where("ng like '%supplier'"), "you", "2020-01-03 00:00:00", "three", branch="main")
    return r, one, two


_SMALL = ("nation", "region", "supplier")


@query("v02_checkout", f"WITH {sql('nation', 'region')} SELECT 'master' AS of, ng, s, p, o FROM triples UNION ALL SELECT 'first', ng, s, p, o FROM triples WHERE ng LIKE '%nation'")
def v02(spark, d):
    r, one, _ = _repository(spark, lower(spark, d, *_SMALL))
    cols = ("ng", "s", "p", "o")
    return r.checkout_branch("ds").select(F.lit("master").alias("of"), *cols).union(r.checkout(one).select(F.lit("first"), *cols))


@query("v02_checkout_lists", "SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS of, '_:l' || l_orderkey AS s, 'http://ex.org/part#' || l_partkey AS o, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber ELSE -l_linenumber END AS member_idx FROM lineitem")
def v02b(spark, d):
    """Two revisions that differ in nothing but the members' places."""
    from .queries_patterns import lists

    r, t = R.Repository(spark, _folder(spark)), lists(spark, d)
    one = r.commit("ds", t, "me", "2020-01-01 00:00:00", "one")
    two = r.commit("ds", t.withColumn("member_idx", -F.col("member_idx")), "me", "2020-01-02 00:00:00", "two", parents=(one,))
    even = F.substring("s", 4, 20).cast("bigint") % 2 == 0
    cols = ("s", "o", "member_idx")
    return r.checkout(one).where(even).select(F.lit("even").alias("of"), *cols).union(r.checkout(two).where(~even).select(F.lit("odd"), *cols))


@query("s16_read_revision", f"WITH {sql('region')} SELECT s, p, o FROM triples")
def s16(spark, d):
    r, _, two = _repository(spark, lower(spark, d, *_SMALL))
    return r.revision(r.graphs_of(two).where(f"ng = '{EX}region'").first()["hash"]).select("s", "p", "o")


@query("s17_blob_store", "SELECT DISTINCT sha256(text) AS hash, strlen(text) AS size FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de' AND text IS NOT NULL)")
def s17b(spark, d):
    """All texts put twice, those that a German document has deleted."""
    r, t = R.Repository(spark, _folder(spark)), table(spark, d, "documents").select("lang", F.col("text").cast("binary").alias("data"))
    r.put_blobs(t)
    r.put_blobs(t.where("lang = 'en'"))
    r.delete_blobs(t.where("lang = 'de' and data is not null").select(F.sha2("data", 256).alias("hash")).distinct())
    return r.table("blobs").select("hash", "size")


@query("s19_flat_repository", f"WITH {sql('nation', 'region')} SELECT ng, s, p, o FROM triples WHERE ng LIKE '%region' UNION ALL SELECT ng, s, p, o FROM triples WHERE ng LIKE '%nation' AND o_kind = 'lit'")
def s19(spark, d):
    """Without history: the second commit's graph takes the place of the first one's."""
    r, t = R.FlatRepository(spark, _folder(spark)), lower(spark, d, "nation", "region")
    r.commit(t)
    r.commit(t.where("ng like '%nation' and o_kind = 'lit'"))
    return r.checkout(f"{EX}nation", f"{EX}region").select("ng", "s", "p", "o")


@query("s21_collection", "SELECT unnest(['a', 'default']) AS name")
def s21(spark, d):
    c = R.Collection(spark, _folder(spark))
    for name in ("b", "", "a"):
        c.open(name)
    c.delete("b")
    return spark.createDataFrame([(n,) for n in c.names()], "name string")


@query("j08_stored_commit_diff", f"SELECT '{EX}region' AS ng, 'added' AS change")
def j08b(spark, d):
    r, one, two = _repository(spark, lower(spark, d, *_SMALL))
    return r.commit_diff(two, one)


@query("j13_sync_branch", f"WITH {sql('supplier')} SELECT ng, s, p, o FROM triples")
def j13(spark, d):
    """Only the branch main is synced, and what it leads to."""
    r, _, _ = _repository(spark, lower(spark, d, *_SMALL))
    to = R.Repository(spark, _folder(spark))
    to.sync_from(r, branch="main")
    return to.table("ng_revisions").select("ng", "s", "p", "o")


@query("u08_sync_dataset", "SELECT 'ds' AS ds, 'master' AS name, CAST(2 AS BIGINT) AS n_commits, CAST(2 AS BIGINT) AS n_revisions")
def u08b(spark, d):
    r, _, _ = _repository(spark, lower(spark, d, *_SMALL))
    to = R.Repository(spark, _folder(spark))
    to.sync_from(r, ds=("ds",))
    to.sync_from(r, ds=("ds",))  # a second time copies nothing
    n = to.info()
    return to.refs().select("ds", "name").crossJoin(n.select("n_commits", "n_revisions"))  # one row each


@query("a03_repository_info", "SELECT CAST(2 AS BIGINT) AS n_commits, CAST(2 AS BIGINT) AS n_datasets, CAST(2 AS BIGINT) AS n_revisions, CAST(3 AS BIGINT) AS n_log")
def a03(spark, d):
    r, _, _ = _repository(spark, lower(spark, d, *_SMALL))
    return r.info("master")


@query("g04_stored_imports", """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region),
c AS (SELECT a, b, 1 AS depth FROM e UNION SELECT c.a, e.b, c.depth + 1 FROM c JOIN e ON c.b = e.a) SELECT a AS importer, b AS imported, CAST(min(depth) AS INT) AS depth FROM c GROUP BY a, b""")
def g04(spark, d):
    from .queries_graphs import imports

    e = imports(spark, d).where("a not like 'c%'")
    t = e.select(F.col("a").alias("ng"), F.lit("iri").alias("s_kind"), F.col("a").alias("s"), F.lit(R.IMPORTS).alias("p"), F.lit("node").alias("o_kind"), F.col("b").alias("o"))
    r = R.Repository(spark, _folder(spark))
    return r.import_closure(r.commit("ds", t, "me", "2020-01-01 00:00:00", "imports"))


@query("v06_ancestor_stage", f"WITH {sql('nation')} SELECT ng, s, p, o FROM triples")
def v06(spark, d):
    """Two branches from one commit: its graphs are the third side of their merge."""
    t = lower(spark, d, *_SMALL)
    r, one, two = _repository(spark, t)
    three = r.commit("ds", t, "you", "2020-01-04 00:00:00", "four", branch="side", parents=(one,))
    return r.ancestor_stage(two, three).select("ng", "s", "p", "o")


@query("v04_set_branch", "SELECT unnest(['branch', 'leaf']) AS kind, unnest(['master', '']) AS name, unnest(['one', 'two']) AS message")
def v04(spark, d):
    """The branch goes back to the first commit, which a second branch names; its old tip becomes a leaf."""
    r, one, _ = _repository(spark, lower(spark, d, *_SMALL))
    r._set_refs([*r._ref_rows(), ("ds", "branch", "old", one)], r.version())
    r.set_branch("ds", "master", one)
    r.remove_branch("ds", "old")
    return r.refs().where("ds = 'ds'").join(r.table("commits").select("commit", "message"), "commit").select("kind", "name", "message")


@query("v08_log", "SELECT key, CASE key WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three' END AS message FROM (SELECT unnest([1, 2, 3]) AS key)")
def v08(spark, d):
    r, _, _ = _repository(spark, lower(spark, d, *_SMALL))
    return R.log_page(r.table("repo_log"), None, 0).select("key", F.col("fields")["message"].alias("message"))


@query("v12_clone", f"WITH {sql('nation', 'region')} SELECT ng, s, p, o FROM triples")
def v12(spark, d):
    r, _, _ = _repository(spark, lower(spark, d, *_SMALL))
    to = R.Repository(spark, _folder(spark))
    to.sync_from(r)
    return to.checkout_branch("ds").select("ng", "s", "p", "o")
