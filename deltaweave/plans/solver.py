"""Satisfiability search with learned clauses, many instances in parallel, and proofs as rows.

The search itself is a walk that each step decides anew, so one instance is one group's work; instances are spread over
the cluster. A proof is a table (step, line): ``lits 0`` adds a clause, ``= atom lit 0`` substitutes, ``0`` ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

from ..relation import Relation


def literal_order(lit: int) -> tuple[int, bool]:
    return abs(lit), lit > 0


def sanitize(clause: Iterable[int]) -> tuple[tuple[int, ...] | None, int | None]:
    """(literals, each once, in order; None), or (None, atom) if the clause holds an atom with both signs."""
    own = sorted(set(clause), key=literal_order)
    if 0 in own:
        raise ValueError("0 is no literal")
    for x in own:
        if x > 0 and -x in own:
            return None, x
    return tuple(own), None


class Solver:
    def __init__(self, clauses: Iterable[Iterable[int]]):
        self.proof: list[str] = []
        self.atoms: set[int] = set()
        self.rules: list[tuple[int, ...]] = []
        self.known: set[tuple[int, ...]] = set()
        self.failed = False
        for clause in clauses:
            own, _ = sanitize(clause)
            self.atoms |= {abs(x) for x in clause}
            if own is not None and own not in self.known:
                self.known.add(own)
                self.rules.append(own)
                self.failed |= not own
        self.value: dict[int, bool] = {}
        self.trail: list[int] = []
        self.cause: dict[int, tuple[int, tuple[int, ...] | None]] = {}
        self.watch: dict[int, list[int]] = {}
        for i, rule in enumerate(self.rules):
            self._watch(i, rule)

    def _watch(self, i: int, rule: tuple[int, ...]) -> None:
        for x in rule:
            self.watch.setdefault(x, []).append(i)

    def _holds(self, x: int) -> bool | None:
        v = self.value.get(abs(x))
        return None if v is None else v == (x > 0)

    def _assign(self, x: int, level: int, rule: tuple[int, ...] | None) -> None:
        self.value[abs(x)] = x > 0
        self.cause[abs(x)] = level, rule
        self.trail.append(x)

    def _propagate(self, at: int, level: int) -> tuple[int, ...] | None:
        """Unit propagation from a place in the trail on; the rule that is violated, if one is."""
        if at == 0:
            for rule in self.rules:
                free = [x for x in rule if self._holds(x) is None]
                if not any(self._holds(x) for x in rule):
                    if not free:
                        return rule
                    if len(free) == 1:
                        self._assign(free[0], level, rule)
        while at < len(self.trail):
            for i in self.watch.get(-self.trail[at], ()):
                rule, free, done = self.rules[i], None, False
                for x in rule:
                    holds = self._holds(x)
                    if holds or (holds is None and free is not None):
                        done = True
                        break
                    if holds is None:
                        free = x
                if done:
                    continue
                if free is None:
                    return rule
                self._assign(free, level, rule)
            at += 1
        return None

    def _learn(self, rule: tuple[int, ...], level: int) -> tuple[int, ...]:
        """Resolves with the causes of what this level propagated until one literal of the level is left."""
        clause = set(rule)
        for x in reversed(self.trail):
            here = [y for y in clause if self.cause[abs(y)][0] == level]
            if len(here) <= 1:
                break
            if -x in clause and (cause := self.cause[abs(x)])[0] == level and cause[1] is not None:
                clause = (clause | set(cause[1])) - {x, -x}
        return tuple(sorted(clause, key=literal_order))

    def _back(self, level: int) -> None:
        while self.trail and self.cause[abs(self.trail[-1])][0] > level:
            x = self.trail.pop()
            del self.value[abs(x)], self.cause[abs(x)]

    def solve(self) -> list[int] | None:
        """A model, one literal for each atom that occurs, in literal order; None: there is none, and the proof says why."""
        level, at = 0, 0
        if self.failed:
            self.proof.append("0")
            return None
        while True:
            if (bad := self._propagate(at, level)) is not None:
                if level == 0:
                    self.proof.append("0")
                    return None
                clause = self._learn(bad, level)
                self.proof.append(" ".join(map(str, clause)) + " 0" if clause else "0")
                level = max([self.cause[abs(x)][0] for x in clause if self.cause[abs(x)][0] < level], default=0)
                self._back(level)
                if clause not in self.known:
                    self.known.add(clause)
                    self.rules.append(clause)
                    self._watch(len(self.rules) - 1, clause)
                at = len(self.trail)
                free = [x for x in clause if self._holds(x) is None]
                if len(free) == 1 and not any(self._holds(x) for x in clause):
                    self._assign(free[0], level, clause)
                continue
            counts: Counter = Counter()
            for rule in self.rules:
                if not any(self._holds(x) for x in rule):
                    counts.update(x for x in rule if self._holds(x) is None)
            if not counts:
                return sorted(((a if self.value.get(a, False) else -a) for a in self.atoms), key=literal_order)
            level, at = level + 1, len(self.trail)
            self._assign(max(counts, key=lambda x: (counts[x], literal_order(x))), level, None)


RESULT = "instance long, satisfiable boolean, model array<long>, proof array<string>"


def solve_all(clauses: DataFrame | Relation) -> DataFrame:
    """(instance, satisfiable, model, proof) of clauses (instance, rule, lit); instances are solved side by side.

    A rule with a null literal is an empty clause. One instance is held by one task.
    """
    df = clauses.df if isinstance(clauses, Relation) else clauses

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rules = [[int(x) for x in own.dropna()] for _, own in rows.groupby("rule")["lit"]]
        solver = Solver(rules)
        model = solver.solve()
        return pd.DataFrame({"instance": [key[0]], "satisfiable": [model is not None], "model": [model or []], "proof": [solver.proof]})

    return df.select("instance", "rule", "lit").groupBy("instance").applyInPandas(one, RESULT)


def report(model: list[int] | None) -> list[str]:
    """The lines of a solution."""
    if model is None:
        return ["v UNSATISFIABLE"]
    return ["v SATISFIABLE", *map(str, model), "0"]


def rup_valid(clauses: Iterable[Iterable[int]], proof: Iterable[str]) -> bool:
    """Whether every added clause follows by unit propagation, and the empty clause at the end."""
    rules = [set(c) for c in clauses]
    for line in proof:
        clause = [int(x) for x in line.split()[:-1]]
        true = {-x for x in clause}
        while True:
            new, empty = set(), False
            for r in rules:
                if not r & true:
                    free = {x for x in r if -x not in true}
                    empty |= not free
                    if len(free) == 1:
                        new |= free
            if empty or any(-x in new | true for x in new):
                break
            if not new - true:
                return False
            true |= new
        rules.append(set(clause))
        if not clause:
            return True
    return False
