from collections import Counter

import pytest

from deltaweave import operators as op
from deltaweave import streaming


@pytest.fixture
def stream(spark, tmp_path):
    """Batches of changes as a stream: one file a batch, read one at a time."""

    def make(name, schema, batches):
        folder = tmp_path / name
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, f"{schema}, n long").coalesce(1).write.mode("append").parquet(str(folder / f"b={i}"))
        return streaming.changes(spark.readStream.schema(f"{schema}, n long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder)))

    return make


def total(spark, df, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    out = Counter()
    for *row, n in spark.table("out").collect():
        out[tuple(row)] += n
    return {r: n for r, n in out.items() if n}


KV = "k int, v int"


def test_join_of_two_streams(spark, stream, tmp_path):
    left, right = stream("l", KV, [[(1, 1, 1), (2, 2, 1)], [(1, 1, -1)]]), stream("r", "k int, w int", [[(1, 3, 1)], [(1, 3, -1), (2, 4, 1)]])
    assert total(spark, op.join(left, right, "k").df, tmp_path) == {(2, 2, 4): 1}


@pytest.mark.parametrize(
    ("operator", "expected"),
    [
        (lambda s: streaming.distinct(s), {(1, 5): 1, (1, 6): 1}),
        (lambda s: streaming.counts(s), {(1, 5, 2): 1, (1, 6, 1): 1}),
        (lambda s: streaming.top_ns(s, ["k"], "v", 2), {(1, 6, 1): 1, (1, 5, 2): 1}),
        (lambda s: streaming.maxes(s, ["k"], "v"), {(1, 6): 1}),
        (lambda s: streaming.mins(s, ["k"], "v"), {(1, 5): 1}),
    ],
)
def test_views_under_retraction(spark, stream, tmp_path, operator, expected):
    s = stream("s", KV, [[(1, 5, 2), (1, 7, 1), (2, 1, 1)], [(1, 6, 1), (1, 7, -1), (2, 1, -1)]])
    assert total(spark, operator(s).df, tmp_path) == expected


def test_antijoin(spark, stream, tmp_path):
    left, right = stream("l", KV, [[(1, 2, 1), (1, 3, 1), (2, 1, 1)]]), stream("r", "k int", [[(1, 1)], [(1, -1), (2, 1)]])
    assert total(spark, streaming.antijoin(left, right, ["k"]).df, tmp_path) == {(1, 2): 1, (1, 3): 1}


def test_consolidated_view(spark, stream, tmp_path):
    s = stream("s", KV, [[(1, 5, 2)], [(1, 5, -2), (1, 6, 1)]])
    assert total(spark, streaming.consolidated(s), tmp_path, "complete") == {(1, 6): 1}


def test_nulls_and_large_integers_stay_whole(spark, stream, tmp_path):
    big = (1 << 53) + 1
    batches = [[(1, big, 1), (1, None, 1), (2, None, 1)], [(1, -5, 1)]]
    schema = "k int, v long"
    assert total(spark, streaming.top_ns(stream("t", schema, batches), ["k"], "v", 2).df, tmp_path / "1") == {(1, big, 1): 1, (1, -5, 2): 1, (2, None, 1): 1}
    assert total(spark, streaming.maxes(stream("x", schema, batches), ["k"], "v").df, tmp_path / "2") == {(1, big): 1, (2, None): 1}
    assert total(spark, streaming.mins(stream("m", schema, batches), ["k"], "v").df, tmp_path / "3") == {(1, -5): 1, (2, None): 1}
    left, right = stream("a", schema, batches), stream("b", "k int", [[(2, 1)]])
    assert total(spark, streaming.antijoin(left, right, ["k"]).df, tmp_path / "4") == {(1, big): 1, (1, None): 1, (1, -5): 1}
