"""The query catalogue against DuckDB on the driver's smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from broadsheet import plans

FOLDER = "/root/testdata/sf0.001"
plans.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as c:
        for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
        yield c


def plain(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: None if pd.isna(x) else x if isinstance(x, str | bool) else round(float(x), 6)
    return list(frame.columns), sorted(str([cell(x) for x in r]) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, FOLDER)
    if name in plans.SQL:
        assert plain(found.toPandas()) == plain(duck.sql(plans.SQL[name]).df())
    else:
        assert found.count() > 0


def test_time_scores_of_odd_orders(spark, tmp_path):
    """Orders with a time of day, keys below zero, no key and no date are as the query's SQL has them."""
    odd = "SELECT * REPLACE (CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 13 > 0 THEN o_orderdate + to_microseconds(o_orderkey * 57777777) END AS o_orderdate)"
    with duckdb.connect() as c:
        c.execute(f"COPY ({odd} FROM '{FOLDER}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
        expected = plain(c.execute(plans.SQL["time_scores"]).df())
    assert plain(plans.QUERIES["time_scores"](spark, str(tmp_path)).toPandas()) == expected


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York"])
def test_time_scores_in_any_zone(spark, tmp_path, zone):
    """The session's zone, its missing hours and years of five digits change nothing; scores are the SQL's to the last bit."""
    odd = "SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '12345-03-08 02:30:00' WHEN o_orderkey % 3 > 0 THEN o_orderdate + to_microseconds(o_orderkey * 57777777) END AS o_orderdate)"
    with duckdb.connect() as c:
        c.execute(f"COPY ({odd} FROM '{FOLDER}/orders.parquet') TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
        expected = sorted(map(str, c.execute(plans.SQL["time_scores"]).fetchall()))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = [tuple(r) for r in plans.QUERIES["time_scores"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(str, found)) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
