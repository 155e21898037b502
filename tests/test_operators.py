from collections import Counter

import pytest
from conftest import bag
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from deltaweave import operators as op
from deltaweave.relation import Relation

T, KV, K = "t int", "k int, v int", "k int"


def plain(*rows):
    return [(r, 1) for r in rows]


def test_distinct_concat_consolidate(rel):
    r = rel(T, [(1, 1), (2, 2), (3, 1), (2, -1)])
    assert bag(op.distinct(r)) == {(1,): 1, (2,): 1, (3,): 1}
    assert bag(op.concat(rel(T, plain(1)), rel(T, plain(2)))) == {(1,): 1, (2,): 1}
    assert bag(op.consolidate(rel(T, plain(1, 1)))) == {(1,): 2}
    saved = op.save(r)
    assert bag(op.concat(op.distinct(saved.get()), saved.get_())) == {(1,): 2, (2,): 2, (3,): 2}


def test_projections(rel):
    r = rel(T, plain(1, 2))
    assert bag(op.flat_map(r, "array(t, 2 * t)", x="it")) == {(1,): 1, (2,): 2, (4,): 1}
    assert bag(op.map(r, t="2 * t")) == bag(op.map_h(r, t="2 * t")) == {(2,): 1, (4,): 1}
    assert bag(op.filter(r, "t > 1")) == {(2,): 1}
    kv = rel(KV, plain((1, 2), (3, 4)))
    assert bag(op.fsts(kv, "k")) == {(1,): 1, (3,): 1}
    assert bag(op.snds(kv, "k")) == {(2,): 1, (4,): 1}
    assert bag(op.swaps(kv)) == {(2, 1): 1, (4, 3): 1}
    assert [bag(x) for x in op.split(kv, "k")] == [{(1,): 1, (3,): 1}, {(2,): 1, (4,): 1}]
    assert bag(op.flatten(rel("a array<int>", [(([1, 1],), 2), (([],), 1)]), "a")) == {(1,): 4}
    left, right = op.partition(rel("s string, x int", plain(("l", 1), ("r", 2), (None, 3))), "s = 'l'", {"x": "x"}, {"x": "x"})
    assert (bag(left), bag(right)) == ({(1,): 1}, {(2,): 1, (3,): 1})


def test_global_extremes(rel):
    assert bag(op.global_max(rel(T, plain(1, 2, 3)))) == {(3,): 1}
    assert bag(op.global_min(rel(T, plain(1, 2, 3)))) == {(1,): 1}
    assert bag(op.global_max(rel(T, []))) == bag(op.global_min(rel(T, [(1, 1), (1, -1)]))) == {}


def test_joins(rel):
    left, right = rel(KV, plain((1, 2), (2, 3))), rel("k int, w int", plain((1, 4), (2, 5)))
    assert bag(op.join(left, right, "k")) == {(1, 2, 4): 1, (2, 3, 5): 1}
    assert bag(op.join_values(left, right, "k")) == {(2, 4): 1, (3, 5): 1}
    assert bag(op.join(rel(KV, [((1, 7), 2)]), rel(KV, [((1, 8), 3)]), "k")) == {(1, 7, 8): 6}
    kv = rel(KV, plain((1, 1), (2, 2)))
    assert bag(op.antijoin(kv, rel(K, plain(2)), "k")) == {(1, 1): 1}
    assert bag(op.semijoin(kv, rel(K, plain(1)), "k")) == {(1, 1): 1}
    assert bag(op.semijoin(kv, rel(K, [(1, 2)]), "k")) == {(1, 1): 2}
    assert bag(op.semijoin(kv, op.distinct(rel(K, [(1, 2)])), "k")) == {(1, 1): 1}
    assert bag(op.antijoin(rel(KV, plain((1, 1))), rel(K, [(1, -1)]), "k")) == {}
    assert bag(op.cartesian_product(rel("a int", [(1, 2)]), rel("b int", [(2, 3)]))) == {(1, 2): 6}


def test_null_keys_are_equal(rel):
    assert bag(op.semijoin(rel(KV, plain((None, 1))), rel(K, plain(None)), "k")) == {(None, 1): 1}
    assert bag(op.antijoin(rel(KV, plain((None, 1))), rel(K, plain(None)), "k")) == {}


def test_set_operations(rel):
    assert bag(op.intersection(rel(T, plain(1, 2)), rel(T, plain(2, 3)))) == {(2,): 1}
    assert bag(op.intersection(rel(T, [(1, 2)]), rel(T, [(1, 3)]))) == {(1,): 6}
    assert bag(op.set_minus(rel(T, [(1, 3), (2, 2)]), rel(T, plain(1)))) == {(2,): 2}


def test_counts(rel):
    assert bag(op.counts(rel(T, [(1, -2), (2, 1), (2, -1), (3, 4)]))) == {(1, -2): 1, (3, 4): 1}
    assert bag(op.distinct(rel(T, [(1, -1)]))) == {(1,): 1}


def test_order_statistics(rel):
    r = rel(KV, plain((1, 2), (1, 3), (2, 1)))
    assert bag(op.maxes(r, "k")) == {(1, 3): 1, (2, 1): 1}
    assert bag(op.mins(r, "k")) == {(1, 2): 1, (2, 1): 1}
    tops = rel(KV, [((1, 5), 3), ((1, 7), 1), ((1, 6), 1), ((2, None), 1)])
    assert bag(op.top_ns(tops, "k", "v", 2)) == {(1, (7, 6)): 1, (2, (None,)): 1}
    assert bag(op.top_ns(op.concat(tops, rel(KV, [((1, 7), -1)])), "k", "v", 2))[1, (6, 5)] == 1
    with pytest.raises(ValueError):
        op.top_ns(tops, "k", "v", 0)


def test_random_ns(rel):
    r = rel(KV, [((k, v), 1) for k in range(3) for v in range(10)])
    one, again, other = (bag(op.random_ns(r, "k", "v", 4, seed)) for seed in (1, 1, 2))
    assert one == again != other
    assert all(len(set(v)) == 4 and set(v) <= set(range(10)) for _, v in one)


def test_floats_are_no_keys(spark):
    with pytest.raises(TypeError):
        op.distinct(Relation.of(spark.createDataFrame([(1.0,)], "x double")))


ROWS = st.lists(st.tuples(st.tuples(st.integers(0, 2), st.integers(0, 2)), st.integers(-2, 2)), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=ROWS, b=ROWS)
def test_laws(rel, a, b):
    def total(rows):
        c = Counter()
        for r, n in rows:
            c[r] += n
        return {r: n for r, n in c.items() if n}

    x, y, ta, tb = rel(KV, a), rel(KV, b), total(a), total(b)
    assert bag(op.concat(x, y)) == total(a + b)
    joined = Counter()
    for (k, v), n in ta.items():
        for (k2, w), m in tb.items():
            if k == k2:
                joined[k, v, w] += n * m
    assert bag(op.join(x, y, "k")) == {r: n for r, n in joined.items() if n}
    assert bag(op.set_minus(x, y)) == {r: n for r, n in ta.items() if r not in tb}
    assert bag(op.intersection(x, y)) == {r: n * tb[r] for r, n in ta.items() if r in tb}
    assert bag(op.maxes(x, "k")) == {(k, max(v for q, v in ta if q == k)): 1 for k, _ in ta}


def test_no_second_aggregation(rel):
    from deltaweave.relation import net

    r = net(rel(T, plain(1)))
    assert net(r) is r


def test_extremes_of_positive_rows_need_one_shuffle_at_most(spark):
    r = Relation.of(spark.createDataFrame([(1, 2), (1, 2), (2, None)], "k int, v int"))
    plan = op.maxes(r, "k").df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert sorted(map(tuple, op.maxes(r, "k").df.collect()), key=str) == [(1, 2, 1), (2, None, 1)]
    taken = Relation(r.df.unionByName(r.negated().df))
    assert op.maxes(taken, "k").df.isEmpty() and op.global_max(taken).df.isEmpty()
