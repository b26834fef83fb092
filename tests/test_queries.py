"""Registered queries against their SQL in DuckDB; those that write files too with KNOTWORK_ALL=1."""

import os

import duckdb
import pytest

from knotwork.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
#: Queries that commit to repositories or write files take some seconds each; these stand for them.
WRITERS = ("queries_repository", "queries_formats")
OF_THEM = {"v02_checkout_lists", "s06_turtle_round_trip", "k03_instance_triples", "s24_xml_triples", "g10_partitioned", "x05_stream_index", "u08_sync_dataset"}
SOME = [n for n in sorted(oracle_sql()) if n in OF_THEM or not queries()[n].__module__.endswith(WRITERS)]


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("KNOTWORK_ALL") else SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = queries()[name](spark, DATA).toPandas(), con.execute(oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_history_of_all_customers(spark):
    from knotwork.plans.queries_graphs import commits

    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    n = orders.groupBy("o_custkey").count().where("count > 1").selectExpr("sum(count - 1)").first()[0]
    got = commits(spark, DATA)
    assert got.select("a").distinct().count() == n > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_cycles_over_all_imports(spark, monkeypatch):
    from knotwork.plans import queries_graphs as Q

    seen, cyclic = [], Q.G.cyclic
    monkeypatch.setattr(Q.G, "cyclic", lambda e: seen.append(e) or cyclic(e))
    assert {r["node"] for r in Q.g01(spark, DATA).collect()} == {"n0", "n1", "n2"}
    assert seen[0].where("a like 'c%'").count() == spark.read.parquet(f"{DATA}/customer.parquet").count()
