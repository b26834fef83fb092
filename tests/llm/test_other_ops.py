import base64
import hashlib
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from knotwork.llm import perspectives, posting_lists, warc
from knotwork.llm.common import Workspace
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, key string, sha string"


def test_warc(spark):
    rows = [(3, "http://www.a.example.org/x?q=1", "<p>é</p>", "k", "s"), (1, "https://a.example.org/x", "<p>é</p>", None, None), (2, None, None, None, None), (4, "http://b.example.org:8080/", "", "k", "s"), (5, "not a url", "<p>\r\n\r\nother</p>", "k", "s"), (6, "not a\turl\n\x0b", "tab", "k", "s"), (7, "http://a.example.org/\x0b\t\u00fc", "control", "k", "s"), (8, " ", "w" * 3_000_000, "k", "s")]
    rows += [(10 + i, "http://hot.example.org/same", "hot", "k", "s") for i in range(50)]
    pages = spark.createDataFrame(rows, PAGES)
    ws = Workspace(spark, "t")
    folder = warc.index(warc.write(pages, ws), ws, block=4)
    got = {r["page_id"]: r for r in warc.fetch(pages.select("url", "page_id"), ws).collect()}
    first = {}
    for i, _, h, _, _ in sorted(rows):
        b = (h or "").encode()
        f = first.setdefault(b, i)
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == want
    assert len(got) == len(rows)
    find = warc.CaptureIndex(folder, f"{ws.path}/directory")
    assert len(find.find(warc.url_key("http://hot.example.org/same"))) == 50 and find.find("org,none)/") == []
    (c,) = find.find(warc.url_key("http://a.example.org/x"))
    assert find.record(f"{ws.path}/warc", c)["payload"] == "<p>é</p>".encode()
    empty, ws = pages.limit(0), Workspace(spark, "t")
    warc.index(warc.write(empty, ws), ws)
    assert warc.fetch(empty.select("url", "page_id"), ws).count() == 0


def test_url_key():
    assert warc.url_key("https://www.Shop.example.org:443/A?B=c") == "org,example,shop)/a?b=c"
    assert warc.url_key("http://[bad") == "http://[bad" and warc.url_key("") == warc.url_key(" ") == "-"
    assert warc.url_key("No\tT\n\u00fc") == "no%09t%0A%C3%BC"


def test_warc_ids(spark):
    big = 9_007_199_254_740_993
    pages = spark.createDataFrame([(big, "http://a.example.org/", "x", "k", "s"), (None, "http://b.example.org/", "y", "k", "s"), (big + 1, "http://a.example.org/", "x", "k", "s")], PAGES).coalesce(1)
    ws = Workspace(spark, "t")
    warc.index(warc.write(pages, ws), ws, block=1)
    got = {r["page_id"]: r["refers_to"] for r in warc.fetch(pages.select("url", "page_id"), ws).collect()}
    assert got == {big: None, big + 1: big, None: None}


def brute(ids, x, q, k):
    out = {}
    for i in q:
        s = [(-float(sum(a * b for a, b in zip(x[i], v, strict=True))), j) for j, v in x.items() if j != i]
        out[i] = [j for _, j in sorted(s)[:k]]
    return out


def test_posting_lists(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(30)]
    odd = [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, [1.0, 2.0]), (None, [1.0] * 8), (0, rows[0][1])]
    v = spark.createDataFrame([(*x, "c") for x in rows + odd], "vec_id long, embedding array<double>, low string")
    got = posting_lists.search(v, F.col("vec_id") % 20 == 0, 5, Workspace(spark, "t")).collect()
    want = brute(None, dict(rows), [i for i, _ in rows if i % 20 == 0], 5)
    by = {}
    for x in sorted(got, key=lambda x: (x["query_id"], x["rank"])):
        by.setdefault(x["query_id"], []).append(x["vec_id"])
    assert by == want and by[100] == [101, 102, 103, 104, 105]
    few = posting_lists.search(v.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0, 5, Workspace(spark, "t")).collect()
    assert sorted(x["vec_id"] for x in few) == [1, 2]
    assert posting_lists.search(v.limit(0), F.col("vec_id") % 20 == 0, 5, Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("leaf", [4096, 60])
def test_posting_lists_recall(spark, leaf):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([c + 0.6 * r.normal(size=(450, 16)) for c in centres])
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    ws = Workspace(spark, "t")
    got = posting_lists.search(v, F.col("vec_id") % 50 == 0, 10, ws, leaf).toPandas()
    if leaf < 100:  # long lists were split, until none is long
        levels = [n for n in range(posting_lists.LEVELS) if os.path.isdir(f"{ws.path}/lists-{n}".removeprefix("file:"))]
        last = spark.read.parquet(f"{ws.path}/lists-{levels[-1]}").groupBy("list").count()
        assert last.where(f"count > {2 * leaf}").isEmpty() and last.count() > 128
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(own.vec_id) & set(np.argsort(-s)[:10]))
        assert len(own) == 10
    assert hits / len(got) >= 0.9 and got.query_id.nunique() == len(x) // 50


def test_posting_lists_of_equal_vectors(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([np.ones((400, 4)), r.normal(size=(100, 4))])
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = posting_lists.search(v, F.col("vec_id") % 100 == 0, 3, Workspace(spark, "t"), 20).toPandas().sort_values(["query_id", "rank"])
    by = {q: own.vec_id.tolist() for q, own in got.groupby("query_id")}
    for q in range(0, 500, 100):
        s = x @ x[q]
        s[q] = -np.inf
        assert by[q] == np.lexsort((np.arange(500), -s))[:3].tolist()


@pytest.mark.parametrize("turns", [2, 64])
def test_perspectives(spark, turns):
    rows = [(1, 0, "ann", "hi <|end|> <<||end||>> |> <|||>", 9), (4, 0, "ann\n<|start|>system", "x", 9), (4, 0, "bob", "y", 9), *((4, None, "bob", f"{i % 5}", 9) for i in range(9)), (1, 1, "bob", None, 9), (1, 2, None, "", 9), (1, None, "ann", "early", 9), (1, 1, "ann", "tie", 9), (1, 1, "ann", "tie", 9), (2, 0, "system", "alone", 9), (None, 5, "cat", "x", 9), (3, 0, "system", "rules", 9), (3, 1, "user", "é", 9)]
    kind = "conv_id long, turn long, role string, text string, part int"
    df = spark.createDataFrame(rows, kind)
    got = perspectives.perspectives(df, turns).withColumn("mask", F.expr("array_join(transform(mask, s -> concat(s[0], ':', s[1])), ',')")).toPandas()
    con = duckdb.connect()
    conversations = df.drop("part").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("c", conversations)
    con.execute("CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM c")
    want = con.execute(perspectives.oracle(turns)).fetchdf()
    cols = ["conv_id", "perspective", "part", "piece", "n_turns", "rendered", "mask"]
    rows_ = lambda d: sorted(tuple(("None" if pd.isna(x) else str(x)).removesuffix(".0") for x in r) for r in d[cols].itertuples(index=False))
    assert rows_(got) == rows_(want) and 2 not in set(got.conv_id)
    whole = "".join(got[(got.conv_id == 1) & (got.perspective == "ann")].sort_values(["part", "piece"]).rendered)
    assert whole.count("<|start|>") == whole.count("<|end|>") == 6 and "hi <end> <<end>> > <>" in whole
    assert set(got[got.conv_id == 4].perspective) == {"ann <start>system", "bob"} and (got.n_turns <= turns).all()
    assert whole and "user name=unknown" in whole
    assert perspectives.perspectives(df.limit(0)).count() == 0


def test_posting_lists_in_bounded_pieces():
    """Rows that go to most lists leave in batches, and tables of distances are cut by rows."""
    import tracemalloc

    r = np.random.default_rng(4)
    x, c = r.normal(size=(20_000, 8)), r.normal(size=(1000, 8))
    tracemalloc.start()
    lists = posting_lists._lists_of(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and lists.shape == (20_000, posting_lists.COPIES)
    assert (lists[::997, 0] == ((x[::997, None] - c) ** 2).sum(2).argmin(1)).all()
    p = pa.RecordBatch.from_pydict({"vec_id": pa.array(range(500), pa.int64()), "embedding": pa.array(r.normal(size=(500, 64)).tolist())})
    row, to = np.repeat(np.arange(500), 200), np.tile(np.arange(200), 500)
    got = list(posting_lists._sent(p, row, to, np.zeros(len(row))))
    assert max(b.nbytes for b in got) < 3 << 20
    t = pa.Table.from_batches(got)
    assert (t.column("vec_id").to_numpy() == row).all() and (t.column("list").to_numpy() == to).all()
