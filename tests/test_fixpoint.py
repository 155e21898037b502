import pytest
from pyspark.sql import functions as F

from deltaweave.plans import fixpoint
from deltaweave.plans.fixpoint import Loop

EDGES = [("A", "B", 1), ("A", "C", 2), ("A", "F", 7), ("B", "D", 2), ("C", "E", 3), ("D", "A", 1), ("D", "E", 1), ("E", "A", 1), ("E", "F", 1)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_shortest_way(spark):
    assert fixpoint.settled_distance(spark, EDGES, "A", "F") == 5
    assert fixpoint.settled_distance(spark, EDGES, "F", "A") is None
    all_ = fixpoint.shortest_paths(spark.createDataFrame(EDGES, "src string, dst string, w long"), "A")
    assert {r["node"]: r["d"] for r in all_.df.collect()} == {"A": 0, "B": 1, "C": 2, "D": 3, "E": 4, "F": 5}


def test_closure_of_a_cycle_and_a_path(spark):
    pairs = fixpoint.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "src int, dst int")).df.select("src", "dst")
    assert rows(pairs) == sorted([(a, b) for a in (1, 2, 3) for b in (1, 2, 3)] + [(7, 8)])
    assert rows(fixpoint.closure(spark.createDataFrame([], "src int, dst int")).df) == []


def test_frames(spark):
    loop = Loop(spark)
    loop.new_input("a", "x int")
    loop.new_frameless_input("b", "x int")
    assert loop.insert("a", [(1,)])
    loop.push_frame()
    assert loop.insert("a", [(2,)]) and loop.insert("b", [(9,)])
    loop.pop_frame()
    assert (rows(loop["a"]), rows(loop["b"])) == ([(1,)], [(9,)])
    assert loop.insert("a", [(2,)]) and not loop.insert("a", [(1,)])
    with pytest.raises(RuntimeError):
        loop.pop_frame_()


def test_fed_rows_are_undone(spark):
    loop = Loop(spark)
    loop.new_input("seed", "x int")
    loop.new_input("up", "x int")
    loop.set_feedback("up", lambda at: at["seed"].unionByName(at["up"].where("x < 4").select((F.col("x") + 1).alias("x"))))
    loop.insert("seed", [(9,)])
    assert loop.commit() is None
    with loop.with_frame():
        loop.insert("seed", [(2,)])
        loop.commit()
        assert rows(loop["up"]) == [(2,), (3,), (4,), (9,)]
    assert rows(loop["up"]) == [(9,)]


def test_first_occurrences(spark):
    loop = Loop(spark)
    loop.new_first_occurrences_input("best", "k int, v int", ["k"])
    loop.insert("best", [(1, 1), (1, 4), (2, 5)])
    assert rows(loop["best"]) == [(1, 4), (2, 5)]
    assert not loop.insert("best", [(1, 9)])


def test_interrupts_have_priority(spark):
    loop = Loop(spark)
    loop.new_input("n", "x int")
    stop = loop.set_interrupt(lambda at: at["n"].where("x = 3"))
    loop.set_feedback("n", lambda at: at["n"].select((F.col("x") + 1).alias("x")))
    loop.insert("n", [(1,)])
    assert loop.commit() == stop == loop.commit()
    assert rows(loop["n"]) == [(1,), (2,), (3,)]


def test_runaway_rule_ends(spark):
    loop = Loop(spark, max_rounds=2)
    loop.new_input("n", "x int")
    loop.set_feedback("n", lambda at: at["n"].select((F.col("x") + 1).alias("x")))
    loop.insert("n", [(1,)])
    with pytest.raises(RuntimeError):
        loop.commit()


def test_many_rounds_with_frames(spark):
    loop = Loop(spark)
    loop.new_input("x", "v int")
    loop.set_feedback("x", lambda at: at["x"].where("v < 12").selectExpr("v + 1 as v"))
    loop.insert("x", [(0,)])
    loop.commit()
    with loop.with_frame():
        loop.insert("x", [(100,), (3,)])
        loop.commit()
        assert loop["x"].count() == 14
    assert sorted(r.v for r in loop["x"].collect()) == list(range(13))


def test_closure_of_a_long_way_and_a_circle(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 51), (51, 52), (52, 50), (50, 50)]
    got = {(r.src, r.dst) for r in fixpoint.closure(spark.createDataFrame(edges, "src int, dst int")).df.collect()}
    assert got == {(i, j) for i in range(20) for j in range(i + 1, 21)} | {(i, j) for i in (50, 51, 52) for j in (50, 51, 52)}
