import itertools
import random

import pytest

from deltaweave.plans import sat_graph
from deltaweave.plans.proof import translate, translate_all
from deltaweave.plans.solver import Solver, report, rup_valid, sanitize, solve_all
from deltaweave.sources import read_cnf

LITS = "rule long, lit long"


def clauses(spark, rules):
    return spark.createDataFrame([(i, x) for i, r in enumerate(rules) for x in r], LITS)


def values(df):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.collect())


def models(rules, atoms):
    for bits in itertools.product([False, True], repeat=atoms):
        if all(any(bits[abs(x) - 1] == (x > 0) for x in r) for r in rules):
            yield bits


def test_sanitize():
    assert sanitize([3, -1, 3]) == ((-1, 3), None)
    assert sanitize([2, -2]) == (None, 2)


def test_solver_against_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        rules = [[rng.choice((-1, 1)) * rng.randint(1, 8) for _ in range(3)] for _ in range(34)]
        solver = Solver(rules)
        model = solver.solve()
        assert (model is not None) == any(True for _ in models(rules, 8))
        if model:
            assert all(set(r) & set(model) for r in rules)
            assert report(model)[0] == "v SATISFIABLE"
        else:
            assert rup_valid(rules, solver.proof) and report(model) == ["v UNSATISFIABLE"]


@pytest.mark.parametrize(("rules", "model"), [([[]], None), ([[1], [-1]], None), ([[1, -1]], [-1]), ([[2]], [2])])
def test_small_instances(rules, model):
    assert Solver(rules).solve() == model


def test_instances_side_by_side(spark):
    rows = [(0, 0, 1), (0, 1, -1), (1, 0, 1), (1, 0, 2), (2, 0, None)]
    out = {r["instance"]: r["satisfiable"] for r in solve_all(spark.createDataFrame(rows, "instance long, rule long, lit long")).collect()}
    assert out == {0: False, 1: True, 2: False}


def test_inference(spark):
    none = spark.createDataFrame([], "atom long, lit long")
    got = sat_graph.infer(clauses(spark, [[1, 2], [-1, -2], [3], [-3, 4], [5, -5]]), none)
    assert not got.root_conflict
    assert values(got.singletons) == [3, 4]
    assert [p for p in values(got.implication) if p[0] != p[1]] == [(-2, 1), (-1, 2), (1, -2), (2, -1)]
    assert values(got.discovered_equivalences) == [(2, -1)]
    assert sat_graph.infer(clauses(spark, [[1], [-1]]), none).root_conflict
    assert values(sat_graph.infer(clauses(spark, [[1, 2], [1, -2]]), none).discovered_singletons) == [1]


def test_equivalences_follow_chains(spark):
    pairs = spark.createDataFrame([(3, -2), (2, 1)], "atom long, lit long")
    got = dict(values(sat_graph.equivalence_closure(pairs)))
    assert got == {3: -1, -3: 1, 2: 1, -2: -1}
    _, rules = sat_graph.represented(clauses(spark, [[3, 1], [3, 4]]), pairs)
    assert values(rules) == [(1, -1), (1, 4)]  # the first has become a tautology


def test_implications_agree_with_models(spark):
    rng = random.Random(5)
    rules = [[rng.choice((-1, 1)) * rng.randint(1, 6) for _ in range(2)] for _ in range(7)]
    got = sat_graph.infer(clauses(spark, rules), spark.createDataFrame([], "atom long, lit long"))
    holds = list(models(rules, 6))
    for x, y in values(got.implication):
        assert all(m[abs(y) - 1] == (y > 0) for m in holds if m[abs(x) - 1] == (x > 0))


def test_probe(spark):
    rules = [[1, 2, 3], [-1, 4], [-2, 4], [-3, 4]]
    got = sat_graph.infer(clauses(spark, rules), spark.createDataFrame([], "atom long, lit long"))
    whole, short = sat_graph.probe(got.reduced, got.implication, got.used)
    assert values(whole) == [4]
    got = sat_graph.infer(clauses(spark, rules[:3]), spark.createDataFrame([], "atom long, lit long"))
    whole, short = sat_graph.probe(got.reduced, got.implication, got.used)
    assert values(whole) == [] and values(short) == [(-3, 4)]
    assert values(sat_graph.innermost(short, got.implication)) == [(-3, 4)]


def test_propagation_and_conflict(spark):
    rules = clauses(spark, [[-1, 2], [-2, 3], [-2, -3]])
    chosen = spark.createDataFrame([(1, 0, 0, 1)], "lit long, kind int, rule long, level long")
    assigned, violated = sat_graph.propagate(rules, chosen, 1)
    bad = values(violated)
    assert bad and set(bad) <= {1, 2}
    assert values(sat_graph.conflict_clause(rules, assigned, bad[0])) == [-1]
    assert tuple(sat_graph.next_literal(rules).first()) == (-2, 2)


def test_translated_proof(spark):
    base, proof = [[1, 2], [-1, -2], [2, 3]], ["= 2 -1 0", "3 -1 0", "d 3 -1 0", "0", "9 0"]
    lines = list(translate(base, proof))
    assert lines == ["-2 -1 0", "2 1 0", "d -1 -2 0", "d 1 2 0", "-1 3 0", "d 2 3 0", "d -2 -1 0", "d 2 1 0", "3 -1 0", "d -1 3 0", "0"]
    rules = spark.createDataFrame([(7, i, x) for i, r in enumerate(base) for x in r], "instance long, rule long, lit long")
    steps = spark.createDataFrame([(7, i, line) for i, line in enumerate(proof)], "instance long, step long, line string")
    assert [r["line"] for r in translate_all(rules, steps).orderBy("step").collect()] == lines


@pytest.mark.parametrize("seed", [2])
def test_relational_search(spark, seed):
    rng = random.Random(seed)
    rules = [[rng.choice((-1, 1)) * rng.randint(1, 4) for _ in range(rng.choice((2, 3)))] for _ in range(12)]
    model = sat_graph.SatGraph(clauses(spark, rules)).solve()
    assert (model is not None) == any(True for _ in models(rules, 4))
    if model:
        assert all(set(r) & set(model) for r in rules)


def test_search_with_equivalence_and_conflict(spark):
    rules = [[1, 2], [-1, -2], [1, 3, 4], [-3, -4, 5], [-5, 3, 2], [-1, 4, -5]]
    model = sat_graph.SatGraph(clauses(spark, rules)).solve()
    assert all(set(r) & set(model) for r in rules)
    assert sat_graph.SatGraph(clauses(spark, [[1], [-1]])).solve() is None


def test_empty_clause_of_a_file_cannot_be_satisfied(spark):
    rows = read_cnf(spark, "p cnf 1 2\n1 0\n0\n").df
    assert sorted((r.rule, r.lit or 0) for r in rows.collect()) == [(0, 1), (1, 0)]
    assert sat_graph.SatGraph(rows).solve() is None
    assert [r.satisfiable for r in solve_all(rows.selectExpr("0L AS instance", "rule", "lit")).collect()] == [False]
    assert sat_graph.SatGraph(read_cnf(spark, "p cnf 1 1\n1 0\n").df).solve() == [1]
