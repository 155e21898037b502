import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rel(spark):
    """rel("k int, v int", {(1, 2): 1}) is a relation of those rows."""
    from deltaweave.relation import Relation

    def make(schema, rows):
        rows = [((*r,) if isinstance(r, tuple) else (r,)) + (n,) for r, n in (rows.items() if isinstance(rows, dict) else rows)]
        return Relation(spark.createDataFrame(rows, f"{schema}, n long"))

    return make


def bag(relation):
    """A relation's consolidated rows: row -> n."""
    from deltaweave.relation import net

    out = {}
    for row in net(relation).df.collect() if hasattr(relation, "df") else relation.collect():
        row = tuple(tuple(x) if isinstance(x, list) else x for x in row)
        assert row[:-1] not in out
        out[row[:-1]] = row[-1]
    return out
