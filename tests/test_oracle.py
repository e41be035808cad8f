"""Every query with SQL against DuckDB, as values without order."""

import datetime
import decimal
import math
import sys

import duckdb
import pytest

from tiermark.plans.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set threads = 2; set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, duck, name, sf=SF):
    df = QUERIES[name](spark, sf)
    got = table(df.columns, df.collect())
    rel = duck.execute(ORACLES[name])
    want = table([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0], name
    assert len(got[1]) == len(want[1]), (name, len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, (name, got[0], a, b)
    return len(got[1])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert compare(spark, duck, name) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


if __name__ == "__main__":
    # python tests/test_oracle.py [names]: reports all failures instead of the first
    import os

    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    session = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("set threads = 2; set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    bad = 0
    for n in sys.argv[1:] or sorted(ORACLES):
        try:
            k = compare(session, con, n)
            if not k:
                print("EMPTY", n)
        except Exception as e:
            bad += 1
            print("FAIL", n, " ".join(str(e).split())[:600], flush=True)
    print("failed", bad, "of", len(sys.argv[1:] or ORACLES))
