"""Each SQL twin against its query on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from lodestone.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(v[i]) for i in order)) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_subqueries_with_null_order_keys(spark, tmp_path):
    """Of a customer's orders of one price, an order without a key is the last."""
    customers = [(k, float(k)) for k in range(6)]
    orders = [(k, c, "F", p) for k, c, p in [(None, 3, 9.0), (7, 3, 9.0), (8, 3, 9.0), (None, 4, 9.0), (2, 4, None), (3, 5, None), (None, 5, None), (1, 1, 9.0)]]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    got = QUERIES["subqueries"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("customer", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == [(3, 1, 7), (4, 1, None), (5, 1, 3)] == sorted(con.execute(ORACLES["subqueries"]).fetchall())


def test_subqueries_where_sorts_spill(spark, tmp_path):
    """Rows of a customer come to their task in any order on a cluster, and where sorts spill: here after 100 rows."""
    spark.range(200).selectExpr("id AS c_custkey", "double(id) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(4000).selectExpr("id AS o_orderkey", "pmod(xxhash64(id, 1), 200) AS o_custkey", "'F' AS o_orderstatus", "double(pmod(xxhash64(id, 2), 1000)) AS o_totalprice")
    orders.repartition(6).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(0,)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    conf, name = spark.sparkContext._jsc.sc().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "100")
    try:
        got = QUERIES["subqueries"](spark, str(tmp_path)).collect()
    finally:
        conf.remove(name)
    con = duckdb.connect()
    for t in ("customer", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert len(got) == 100 and sorted(map(tuple, got)) == sorted(con.execute(ORACLES["subqueries"]).fetchall())
