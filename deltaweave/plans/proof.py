"""Rewrites proofs that substitute equivalent literals into ones that only add and delete clauses."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .solver import literal_order, sanitize


def _line(clause: Iterable[int], mark: str = "") -> str:
    return mark + " ".join([*map(str, clause), "0"])


def translate(base: Iterable[Iterable[int]], proof: Iterable[str]) -> Iterator[str]:
    """Lines of additions and deletions. Each line depends on the clauses that those before it have left.

    ``lits 0`` adds, as it is written; ``d lits 0`` deletes; ``= atom lit 0`` puts the literal for the atom everywhere:
    the two clauses that say so stand around, and each clause is added in its new form before its old one goes; a new
    form that is a tautology or is there already is not added. ``0`` ends.
    """
    clauses = dict.fromkeys(c for c, _ in map(sanitize, base) if c is not None)
    for line in proof:
        words = line.split()
        if not words:
            continue
        if words[0] == "0":
            yield "0"
            return
        if words[0] == "d":
            own, _ = sanitize(map(int, words[1:-1]))
            yield _line(own, "d ")
            del clauses[own]
        elif words[0] == "=":
            atom, lit = int(words[1]), int(words[2])
            links = (-atom, lit), (atom, -lit)
            yield from map(_line, links)
            for old_lit, new_lit in ((-atom, -lit), (atom, lit)):
                for old in [c for c in clauses if old_lit in c]:
                    new, _ = sanitize(new_lit if x == old_lit else x for x in old)
                    if new is not None and new not in clauses:
                        clauses[new] = None
                        yield _line(new)
                    del clauses[old]
                    yield _line(old, "d ")
            yield from (_line(c, "d ") for c in links)
        else:
            given = [int(x) for x in words[:-1]]
            yield _line(given)
            own, _ = sanitize(given)
            clauses[own] = None


def translate_all(clauses: DataFrame, proofs: DataFrame) -> DataFrame:
    """(instance, step, line) of clauses (instance, rule, lit) and proofs (instance, step, line), instances side by side."""

    def one(key: tuple, rules: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        base = [[int(x) for x in own.dropna()] for _, own in rules.groupby("rule")["lit"]]
        out = list(translate(base, lines.sort_values("step")["line"]))
        return pd.DataFrame({"instance": [key[0]] * len(out), "step": range(len(out)), "line": out})

    return clauses.groupBy("instance").cogroup(proofs.groupBy("instance")).applyInPandas(one, "instance long, step long, line string")
