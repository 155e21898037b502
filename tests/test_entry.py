import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["concat", "semijoin_weighted", "antijoin", "intersection", "snapshot_diff", "closure", "top_ns3", "global_max", "literal_extremes"])
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = db.sql(entry.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    order = ", ".join(f'"{c}"' for c in columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(db.sql(f"SELECT {order} FROM ({entry.oracle_sql()[name]})").fetchall())
