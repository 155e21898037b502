import pytest
from conftest import bag

from deltaweave import operators as op
from deltaweave.sources import Engine, parse_cnf, read_cnf


@pytest.fixture
def engine(spark):
    return Engine(spark)


def test_join_under_retraction(engine):
    left, right = engine.new_input("k int, v int"), engine.new_input("k int, w int")
    out = engine.output(lambda at: op.join(left.at(at), right.at(at), "k"), left, right)
    engine.begin()
    left.update((1, 1))
    left.update((2, 2))
    right.update((1, 3))
    assert bag(out.pull()) == {}  # not yet committed
    engine.commit()
    view = out.dump_to_map({})
    assert view == {(1, 1, 3): 1}
    left.update((1, 1), -1)
    right.update((1, 3), -1)
    right.update((2, 4))
    engine.commit()
    assert out.dump_to_map(view) == {(2, 2, 4): 1}
    assert bag(out.pull()) == {}


def test_maxes_under_retraction(engine):
    values = engine.new_input("k int, v int")
    out = engine.output(lambda at: op.maxes(values.at(at), "k"), values)
    for i in range(1000):
        values.update((1, i))
    engine.commit()
    assert bag(out.pull()) == {(1, 999): 1}
    values.update((1, 999), -1)
    engine.commit()
    assert bag(out.pull()) == {(1, 999): -1, (1, 998): 1}
    for i in range(999):
        values.update((1, i), -1)
    values.update((1, 1000))
    engine.commit()
    assert bag(out.pull()) == {(1, 998): -1, (1, 1000): 1}


def test_antijoin_under_retraction(engine):
    left, right = engine.new_input("k int, v int"), engine.new_input("k int")
    out = engine.output(lambda at: op.antijoin(left.at(at), right.at(at), "k"), left, right)
    for row in ((1, 2), (1, 3), (2, 1)):
        left.update(row)
    right.update(1)
    engine.commit()
    assert bag(out.pull()) == {(2, 1): 1}
    right.update(1, -1)
    engine.commit()
    assert bag(out.snapshot()) == {(1, 2): 1, (1, 3): 1, (2, 1): 1}


def test_pulls_add_up(engine):
    rows = engine.new_input("t int")
    out = engine.output(lambda at: op.counts(rows.at(at)), rows)
    view = {}
    for change in ([(1, 1), (2, 2)], [(1, -1)], [(2, -3), (3, 1)], [(2, 1)]):
        for t, n in change:
            rows.update(t, n)
        engine.commit()
        out.dump_to_map(view)
    assert view == {k: n for k, n in bag(out.snapshot()).items()} == {(3, 1): 1}


def test_skipped_pull_and_zero(engine):
    rows = engine.new_input("t int")
    out = engine.output(rows.at, rows)
    rows.update(1)
    engine.commit()
    rows.update(1, -1)
    rows.update(2, 0)
    engine.commit()
    assert bag(out.pull()) == {}


def test_constant_append_and_foreign_input(spark, engine):
    fixed = engine.constant([((1,), 2)], "t int")
    fixed.append(spark.createDataFrame([(5,)], "t int"))
    assert bag(fixed.at(0)) == {}
    engine.commit()
    assert bag(fixed.at(1)) == {(1,): 2, (5,): 1}
    with pytest.raises(ValueError):
        Engine(spark).output(fixed.at, fixed)


def test_cnf(spark):
    text = "c note\n\np cnf 3 3\n1 -2\n0 3 0\n-1 2 3 0\n"
    assert list(parse_cnf(text.splitlines())) == [[1, -2], [3], [-1, 2, 3]]
    assert bag(read_cnf(spark, text))[0, -2] == 1
    for bad in ("", "p dnf 1 1\n1 0", "p cnf 1 2\n1 0", "p cnf 1 1\nx 0"):
        with pytest.raises(ValueError):
            list(parse_cnf(bad.splitlines()))
