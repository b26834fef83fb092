import pytest

from knotwork.model import FIRST, NIL, RDF, TYPE, XSD
from knotwork.operators.lists import collapse
from knotwork.sources import turtle as T

GOOD = {
    "plain": ("<http://a/s> <http://a/p> <http://a/o> .", 1),
    "prefix": ("@prefix e: <http://a/> . e:s e:p e:o , e:o2 ; e:q 1 .", 3),
    "sparql_prefix": ("PREFIX e: <http://a/>\ne:s a e:C .", 1),
    "base": ("@base <http://a/x/> . <s> <p> <../o> .", 1),
    "blank_list": ("@prefix e: <http://a/> . e:s e:p [ e:q 1 ; e:r 'x' ] .", 3),
    "alone": ("@prefix e: <http://a/> . [ e:q 1 ] .", 1),
    "list": ("@prefix e: <http://a/> . e:s e:p ( 1 2 3 ) .", 7),
    "empty_list": ("@prefix e: <http://a/> . e:s e:p () .", 1),
    "trailing": ("@prefix e: <http://a/> . e:s e:p 1 ; ; .", 1),
    "long": ('@prefix e: <http://a/> . e:s e:p """a "quoted"\nline""" .', 1),
    "numbers": ("@prefix e: <http://a/> . e:s e:p -1, 2.5, 1e3, true .", 4),
    "dots": ("@prefix e: <http://a/> . e:s.t e:p e:o.", 1),
    "comment": ("# note\n<http://a/s> <http://a/p> 'a#b' . # end", 1),
    "blank_labels": ("_:a <http://a/p> _:b . _:b <http://a/p> _:a .", 2),
}
BAD = ["<http://a/s> <http://a/p> .", "e:s e:p e:o .", "<http://a/s> <http://a/p> <http://a/o>", "'x' <http://a/p> 1 .", "<http://a/s> a [ .", '<http://a/s> <http://a/p> "a\nb" .', "@prefix e <http://a/> .", '<http://a/s> <http://a/p> "\\q" .']


@pytest.mark.parametrize("name", GOOD)
def test_good(name):
    text, n = GOOD[name]
    assert len(T.parse_text(text)) == n


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    with pytest.raises(T.SyntaxProblem):
        T.parse_text(text)


def test_terms():
    rows = T.parse_text('@prefix e: <http://a/> . e:s e:p "x"@en-GB, "1"^^e:t, "\\u00e9\\t", 2.5, 7 .')
    assert [(r[5], r[6], r[7]) for r in rows] == [("x", RDF + "langString", "en-GB"), ("1", "http://a/t", None), ("é\t", XSD + "string", None), ("2.5", XSD + "decimal", None), ("7", XSD + "integer", None)]


def test_recover():
    text = "<http://a/s> <http://a/p> 1 .\n<http://a/s> broken .\n<http://a/s> <http://a/p> 2 .\n"
    assert [r[5] for r in T.parse_text(text, mode="DROPMALFORMED")] == ["1", "2"]
    rows = T.parse_text(text, mode="PERMISSIVE")
    assert len(rows) == 3 and "line 2" in rows[1][10]


def test_trig():
    rows = T.parse_text("@prefix e: <http://a/> . e:g { e:s e:p 1 . e:s e:q 2 } GRAPH e:h { e:s e:p 3 . } e:s e:p 4 .", trig=True)
    assert [(r[0], r[5]) for r in rows] == [("http://a/g", "1"), ("http://a/g", "2"), ("http://a/h", "3"), ("http://a/s", "4")]


def test_read_write(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.ttl").write_text('@prefix e: <http://a/g#> . e:s a e:C ; e:p "q\\"\\n", 2 ; e:l ( "a" "b" "c" ) . e:t e:p e:s .')
    t = T.read(spark, str(src)).drop("_corrupt_record")
    lists = collapse(t).orderBy("member_idx").collect()
    assert [r["o"] for r in lists] == ["a", "b", "c"]
    T.write(t, str(out))
    back = T.read(spark, str(out)).select(*t.columns)
    named = lambda df: sorted((r["p"], r["o_kind"], "" if r["o"].startswith("_:") else r["o"], r["o_dtype"] or "") for r in df.collect())
    assert named(back) == named(t)
    assert {r["p"] for r in t.collect()} >= {TYPE, FIRST} and any(r["o"] == NIL for r in t.collect())
