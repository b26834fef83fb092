"""Readers, writers and streams on text made here."""

import pytest
from pyspark.sql import functions as F
from tests.test_operators import key, listed, triples

from knotwork.model import EX, OWL, SCHEMA, TYPE
from knotwork.operators import convert as C
from knotwork.operators import search
from knotwork.operators.revisions import Collection, FlatRepository, Repository
from knotwork.sources import graphfiles, p21, turtle, xmltree
from knotwork.streaming import follow

P21 = """ISO-10303-21; HEADER; FILE_NAME('a;b'); ENDSEC; DATA;
/* a comment with ; and ' */ #1=POINT('it''s',(1.,-2.5E-3,#3),$,*,.T.); #2 = (A(1)B()C('x;y',LENGTH(3.0)));
ENDSEC; END-ISO-10303-21;"""


def test_p21(spark):
    assert list(p21.instances(P21)) == [(1, 0, "POINT", ["'it''s'", "(1.,-2.5E-3,#3)", "$", "*", ".T."]), (2, 0, "A", ["1"]), (2, 1, "B", []), (2, 2, "C", ["'x;y'", "LENGTH(3.0)"])]
    for bad in ("DATA; #1=X(1; ENDSEC;", "DATA; #1; ENDSEC;", "DATA; ~ ENDSEC;", "DATA; #1=X; ENDSEC;"):
        with pytest.raises(p21.P21Problem):
            list(p21.instances(bad))
    df = p21.parse(spark.createDataFrame([("a", P21), ("b", "DATA; #1=X(1;"), ("c", None)], "file string, text string"))
    assert {(r["file"], r["_corrupt_record"] is not None) for r in df.select("file", "_corrupt_record").distinct().collect()} == {("a", False), ("b", True)}
    v = {(r["id"], r["pos"], r["idx"]): (r["kind"], r["value"]) for r in C.attribute_values(df).collect()}
    assert v[1, 0, None] == ("string", "it's") and v[1, 1, 1] == ("double", "-2.5E-3") and v[1, 1, 2] == ("ref", "3") and v[1, 4, None] == ("enum", "T") and (1, 2, None) not in v
    assert v[2, 1, None] == ("typed", "LENGTH(3.0)")


def test_xml(spark):
    texts = [("a", '<r><x uid="1"><y uidRef="2"/><z>t</z></x><x uid="2"/><y uidRef="9"/></r>'), ("b", "<r><open></r>")]
    e = xmltree.parse(spark.createDataFrame(texts, "file string, text string"), batch=2)
    assert {r["file"] for r in e.where("_corrupt_record is not null").collect()} == {"b"}
    assert [(r["file"], r["uid"]) for r in C.unresolved(e).collect()] == [("a", "9")]
    t = {(r["s"], r["p"].rpartition("#")[2], r["o"]) for r in C.xml_triples(e).where("s like 'a#%'").collect()}
    assert t == {("a#1", "type", "http://ex.org/schema#x"), ("a#1", "y", "a#2"), ("a#1", "z", "t"), ("a#2", "type", "http://ex.org/schema#x")}


def test_turtle_writer(spark, tmp_path):
    t = triples(spark, (f"{EX}g", f"{EX}g", TYPE, f"{OWL}Ontology"), (f"{EX}g", f"{EX}g#s", f"{EX}p", "_:b1"), (f"{EX}g", "_:b1", f"{EX}q", "_:b2"), (f"{EX}g", "_:b2", f"{EX}q", "'x"), (f"{EX}g", f"{EX}g#s", f"{EX}l", "_:l"), (f"{EX}g", "_:c1", f"{EX}q", "_:c2"), (f"{EX}g", "_:c2", f"{EX}q", "_:c1"))
    t = t.unionByName(listed(spark, ("_:l", "a", 0), ("_:l", "a", 1), ("_:l", "b", 2)).withColumn("ng", F.lit(f"{EX}g")))
    turtle.write(t, str(tmp_path / "o"), turtle.PREFIXES | {"g": f"{EX}g#"})
    (file,) = (tmp_path / "o").glob("*/*.txt")
    text = file.read_text()
    body = [x for x in text.split("\n\n") if x.strip()]
    assert body[0].splitlines()[0] == f"@prefix g: <{EX}g#> ." and body[1].startswith(f"<{EX}g> a owl:Ontology")
    assert f'<{EX}p> [ <{EX}q> [ <{EX}q> "x" ] ]' in text and f'<{EX}l> ( "a" "a" "b" )' in text and text.count("_:bc1") == 2
    back = turtle.read(spark, str(file))
    assert back.where("p like '%#first'").count() == 3 and back.where(f"p = '{EX}q'").count() == 4


def test_graph_files(spark, tmp_path):
    t = triples(spark, ("g", "s1", "p", "'x"), ("g", "s1", f"{OWL}imports", "h"), ("urn:uuid:6BA7B811-9DAD-11D1-80B4-00C04FD430C8", "s", "p", "s1"))
    at = str(tmp_path / "f")
    graphfiles.write(t, at)
    assert key(graphfiles.read(spark, at)) == key(t) and key(graphfiles.read(spark, at, "g")) == key(t.where("ng = 'g'"))
    h = {r["ng"]: r for r in graphfiles.headers(spark, at).collect()}
    assert h["g"]["imports"] == ["h"] and h["g"]["n_triples"] == 2 and {r["file"] for r in h.values()} == {"Zw==", "6ba7b811-9dad-11d1-80b4-00c04fd430c8"}
    assert graphfiles.damaged(spark, at).isEmpty()
    spark.createDataFrame([("g", "iri", "s9", "p", "lit", "y", None, None, None, None, "Zw==")], f"{SCHEMA}, file string").write.mode("append").partitionBy("file").parquet(f"{at}/triples")
    assert [r["ng"] for r in graphfiles.damaged(spark, at).collect()] == ["g"]


def test_flat_and_collection(spark, tmp_path):
    f = FlatRepository(spark, f"file://{tmp_path}/flat")
    f.commit(triples(spark, ("g", "s", "p", "'1"), ("h", "s", "p", "'2")))
    f.commit(triples(spark, ("g", "s", "p", "'3")))
    assert {(r["ng"], r["o"]) for r in f.checkout().collect()} == {("g", "3"), ("h", "2")} and f.checkout("h").count() == 1
    c = Collection(spark, f"file://{tmp_path}/c")
    c.open(), c.open("b")
    assert c.names() == ["b", "default"]
    c.delete()
    assert c.names() == ["b"]
    with pytest.raises(ValueError):
        c.open("../x")


def test_index_follows_commits(spark, tmp_path):
    r = Repository(spark, f"file://{tmp_path}/r")
    index = follow.SearchIndex(r, f"file://{tmp_path}/i", ("name",))
    a = triples(spark, ("g", "s", "name", "'one"), ("h", "s", "name", "'two"))
    one = r.commit("ds", a, "me", "2020-01-01 00:00:00", "one")
    index.follow().awaitTermination()
    r.commit("ds", a.where("ng = 'g'").unionByName(triples(spark, ("h", "s", "name", "'three"))), "me", "2020-01-02 00:00:00", "two", parents=(one,))
    index.follow().awaitTermination()
    shown = lambda: {(x["graph_uri"], x["label"]) for x in index.documents("ds").collect()}
    assert shown() == {("g", "one"), ("h", "three")}
    assert index._documents().count() == 3  # an unchanged graph is derived once
    index.rebuild()
    assert shown() == {("g", "one"), ("h", "three")}
    want = {(x["graph_uri"], x["label"]) for x in search.documents(r.checkout_branch("ds"), ("name",)).collect()}
    assert shown() == want
    log = follow.log_stream(r).writeStream.format("memory").queryName("log").trigger(availableNow=True).start()
    log.awaitTermination()
    assert spark.table("log").count() == 2


def test_command_line(spark, tmp_path, capsys):
    from knotwork.__main__ import run

    (tmp_path / "a.ttl").write_text("@prefix e: <http://a/g#> . e:s a e:C ; e:name 'red apple' .")
    (tmp_path / "b.ttl").write_text("@prefix e: <http://a/g#> . e:s a e:C ; e:name 'green apple' .")

    def told(*args):
        run(spark, [f"file://{tmp_path}/r", *args])
        return capsys.readouterr().out.splitlines()

    (one,) = told("import", "ds", str(tmp_path / "a.ttl"), "--message", "first")
    (two,) = told("import", "ds", str(tmp_path / "b.ttl"), "--parent", one)
    assert told("datasets") == ["ds", "ds"] and told("branches", "ds")[1] == f"master\t{two}"
    assert len(told("diff", two, one)) == 3 and told("commit-diff", two, one)[1] == "http://a/g\tmodified"
    assert [x.split("\t")[0] for x in told("history", two)[1:]] == [two, one] and told("info")[1] == "2\t2\t2\t2"
    assert len(told("query", one, "+red", "--label", "http://a/g#name")) == 2 and len(told("query", two, "+red", "--label", "http://a/g#name")) == 1
    assert len(told("touching", one, "http://a/g#s")) == 3 and told("fragment", one, "s")[1].startswith("http://a/g#s")
    told("checkout", one, "--to", str(tmp_path / "out"))
    assert key(turtle.read(spark, f"{tmp_path}/out/*/*.txt").drop("_corrupt_record")) == key(turtle.read(spark, str(tmp_path / "a.ttl")).drop("_corrupt_record"))
    run(spark, [f"file://{tmp_path}/other", "sync", f"file://{tmp_path}/r"])
    assert Repository(spark, f"file://{tmp_path}/other").state() == Repository(spark, f"file://{tmp_path}/r").state()


def test_conditions_and_hooks(spark, tmp_path):
    told = []

    def never_empty(t):
        if t.isEmpty():
            raise ValueError("nothing to commit")

    r = Repository(spark, f"file://{tmp_path}/r", (never_empty,), (told.append,))
    t = triples(spark, ("g", "s", "p", "'1"))
    with pytest.raises(ValueError):
        r.commit("ds", t.limit(0), "me", "2020-01-01 00:00:00", "one")
    assert r.version() == 0
    assert told == [] and r.commit("ds", t, "me", "2020-01-01 00:00:00", "one") in told
