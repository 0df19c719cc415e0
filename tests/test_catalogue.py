"""Every query with SQL gives what DuckDB gives."""

import math
import os

import duckdb
import pytest

from rivulet.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_queries_without_sql(spark):
    assert catalogue.QUERIES["profile_personas"](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_of_whole_table(spark, duck):
    every = {r[0] for r in duck.sql("SELECT vec_id FROM embeddings").fetchall()}
    found = catalogue.QUERIES["topk_cosine_all"](spark, SF).collect()
    assert {r["user_id"] for r in found} == every and any(r["item_id"] < 50 for r in found)


def test_outer_join_of_whole_tables(spark, duck):
    joined = catalogue.QUERIES["outer_joins_all"](spark, SF).collect()
    assert {r["c_custkey"] for r in joined} - {None} == {r[0] for r in duck.sql("SELECT c_custkey FROM customer").fetchall()}
    assert {r["o_orderkey"] for r in joined} - {None} == {r[0] for r in duck.sql("SELECT o_orderkey FROM orders").fetchall()}
    assert any(r["c_custkey"] is None for r in joined) and any(r["o_orderkey"] is None for r in joined)


def test_als_gives_whole_vectors(spark):
    rows = catalogue.QUERIES["als_embeddings"](spark, SF).collect()
    users = {r["user_id"] for r in rows}
    assert users and {(r["user_id"], r["i"]) for r in rows} == {(u, i) for u in users for i in range(16)}
    assert len(rows) == 16 * len(users) and all(math.isfinite(r["x"]) for r in rows) and any(r["x"] for r in rows)
