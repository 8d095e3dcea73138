import decimal

import duckdb
import pytest

from corvane.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_is_listed():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(catalog.QUERIES)


def plain(v):
    """A value of either engine as both print it."""
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, tables, name):
    want = tables.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == rows


def test_bm25_reads_the_passages_once(spark):
    """One scan of the documents: totals, frequencies and scores share a shuffle."""
    got = catalog.QUERIES["bm25_topk"](spark, SF)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") == 2


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
