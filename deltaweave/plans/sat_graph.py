"""Inference on clauses as relational rules: equivalences, single literals, implications, and propagation of a choice.

Clauses are rows (rule, lit); a literal is a signed long. Every rule is a DataFrame; what is recursive runs by
``semi_naive`` or until nothing changes, each state written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import literal_key
from ..operators import random_ns
from ..relation import Relation
from ..sources.tables import scratch
from .fixpoint import closure

#: The seed by which literals of long clauses are picked for probing.
SEED = 20


def _least(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(F.struct(literal_key(F.col(value)).alias("o"), F.col(value).alias("v"))).alias("m")).select(by, F.col("m.v").alias(value))


def equivalence_closure(pairs: DataFrame) -> DataFrame:
    """(x, y) of fed pairs (atom, lit): each literal of the atom and the least literal it stands for, chains followed."""
    base = pairs.select(F.col("atom").alias("x"), F.col("lit").alias("y")).unionByName(pairs.select((-F.col("atom")).alias("x"), (-F.col("lit")).alias("y")))
    now = scratch(_least(base, "x", "y"), "eq")
    while True:
        on = now.alias("a").join(now.alias("b"), F.col("a.y") == F.col("b.x")).select(F.col("a.x").alias("x"), F.col("b.y").alias("y"))
        new = scratch(_least(now.unionByName(on), "x", "y"), "eq")
        if new.join(now, ["x", "y"], "left_anti").isEmpty():
            return new
        now = new


@dataclass
class Inferred:
    """What the clauses alone entail; each a set of rows."""

    equivalences: DataFrame  # (x, y), identity included
    rules: DataFrame  # (rule, lit): representatives, tautologies left out
    singletons: DataFrame  # (lit)
    reduced: DataFrame  # (rule, lit): rules without a singleton, less literals that are false
    root_conflict: bool
    used: DataFrame  # (lit)
    implication: DataFrame  # (x, y)
    discovered_singletons: DataFrame  # (lit)
    discovered_equivalences: DataFrame  # (atom, lit)


def represented(clauses: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, y) equivalences with identity on used literals, and the clauses in representatives without tautologies."""
    eq = equivalence_closure(pairs)
    used = clauses.select(F.explode(F.array(F.col("lit"), -F.col("lit"))).alias("x")).distinct().join(eq.select("x"), "x", "left_anti")
    all_eq = scratch(eq.unionByName(used.select("x", F.col("x").alias("y"))), "equivalences")
    named = clauses.join(all_eq, clauses["lit"] == all_eq["x"]).select("rule", F.col("y").alias("lit")).distinct()
    both = named.groupBy("rule", F.abs("lit")).agg(F.count("*").alias("signs")).where("signs = 2").select("rule").distinct()
    return all_eq, scratch(named.join(both, "rule", "left_anti"), "rules")


def reduce_rules(rules: DataFrame, true: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules that no literal of ``true`` (lit) satisfies: (rule, lit) of what isn't false in them, and (rule) of all of them."""
    satisfied = rules.join(true, "lit").select("rule").distinct()
    open_ = rules.join(satisfied, "rule", "left_anti")
    false = true.select((-F.col("lit")).alias("lit"))
    return open_.join(false, "lit", "left_anti").select("rule", "lit"), open_.select("rule").distinct()


def single_literals(rules: DataFrame) -> DataFrame:
    """(rule, lit) of rules of one literal."""
    return rules.groupBy("rule").agg(F.count("*").alias("n"), F.first("lit").alias("lit")).where("n = 1").select("rule", "lit")


def base_implication(rules: DataFrame) -> DataFrame:
    """(x, y) of rules of two literals: a or b says that not a implies b and not b implies a."""
    two = rules.groupBy("rule").agg(F.collect_list("lit").alias("l")).where("size(l) = 2")
    return two.select(F.explode(F.array(F.struct((-F.col("l")[0]).alias("x"), F.col("l")[1].alias("y")), F.struct((-F.col("l")[1]).alias("x"), F.col("l")[0].alias("y")))).alias("p")).select("p.*").distinct()


def infer(clauses: DataFrame, pairs: DataFrame, known: DataFrame | None = None) -> Inferred:
    """clauses (rule, lit), pairs (atom, lit) of known equivalences, known (lit) of single literals."""
    spark = clauses.sparkSession
    all_eq, rules = represented(clauses, pairs)
    singles = scratch(known if known is not None else spark.createDataFrame([], "lit long"), "singletons")
    while True:  # single literals until none is new
        reduced, open_ = reduce_rules(rules, singles)
        fresh = scratch(single_literals(reduced).select("lit").distinct().join(singles, "lit", "left_anti"), "fresh")
        if fresh.isEmpty():
            break
        singles = scratch(singles.unionByName(fresh), "singletons")
    empty = not open_.join(reduced, "rule", "left_anti").isEmpty()
    conflict = empty or not singles.join(singles.select((-F.col("lit")).alias("lit")), "lit").isEmpty()
    reduced = scratch(reduced, "reduced")
    used0 = all_eq.where("x = y").select(F.col("x").alias("lit"))
    fixed = singles.unionByName(singles.select((-F.col("lit")).alias("lit")))
    used = scratch(used0.join(fixed, "lit", "left_anti"), "used")
    implication = closure(base_implication(reduced), "x", "y").df.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    found = implication.where("x = -y").select(F.col("y").alias("lit"))
    mutual = implication.alias("a").join(implication.alias("b"), (F.col("a.x") == F.col("b.y")) & (F.col("a.y") == F.col("b.x"))).where(literal_key(F.col("a.x")) < literal_key(F.col("a.y")))
    equal = mutual.select(F.abs(F.col("a.y")).alias("atom"), F.when(F.col("a.y") > 0, F.col("a.x")).otherwise(-F.col("a.x")).alias("lit")).where("atom <> abs(lit)").distinct()
    return Inferred(all_eq, rules, singles, reduced, conflict, used, implication, found, equal)


def probe(reduced: DataFrame, implication: DataFrame, used: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What all literals of a long rule imply: (lit) that must hold; what all but one imply: (x, y), not that one implies y.

    Candidates come from two literals of each rule that a hash picks; pairs that are implied already are left out.
    """
    sizes = reduced.groupBy("rule").agg(F.count("*").alias("size")).where("size > 2")
    long = reduced.join(sizes, "rule")
    self_ = implication.unionByName(used.select(F.col("lit").alias("x"), F.col("lit").alias("y"))).distinct()
    picked = random_ns(Relation.of(long.select("rule", "lit")), "rule", "lit", 2, seed, exploded=True).df.select("rule", "lit")
    candidates = picked.join(self_, picked["lit"] == self_["x"]).select("rule", "y").distinct()
    implied = long.join(self_, long["lit"] == self_["x"]).select("rule", "size", "lit", "y").join(candidates, ["rule", "y"])
    counted = implied.groupBy("rule", "size", "y").agg(F.countDistinct("lit").alias("n"))
    whole = counted.where("n = size").select(F.col("y").alias("lit")).distinct()
    implied_by_other = whole.alias("a").join(implication.alias("i"), F.col("a.lit") == F.col("i.y")).join(whole.alias("b"), F.col("b.lit") == F.col("i.x")).where("a.lit <> b.lit").select(F.col("a.lit").alias("lit"))
    short = counted.where("n = size - 1").select("rule", "y")
    missing = long.join(short, "rule").join(implied.select("rule", "lit", "y"), ["rule", "lit", "y"], "left_anti")
    pairs = missing.select((-F.col("lit")).alias("x"), "y").where("x <> y").distinct().join(implication, ["x", "y"], "left_anti")
    return whole.join(implied_by_other, "lit", "left_anti"), pairs


def innermost(pairs: DataFrame, implication: DataFrame) -> DataFrame:
    """Discovered implications that no other one gives through known ones."""
    p, i = pairs, implication
    after = p.alias("p").join(i.alias("i"), F.col("p.y") == F.col("i.x")).select(F.col("p.x").alias("x"), F.col("i.y").alias("y"))
    before = p.alias("p").join(i.alias("i"), F.col("i.y") == F.col("p.x")).select(F.col("i.x").alias("x"), F.col("p.y").alias("y"))
    return p.join(after.unionByName(before).distinct(), ["x", "y"], "left_anti")


def propagate(rules: DataFrame, assigned: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Unit propagation from ``assigned`` (lit, kind, rule, level) to its end: all assignments, and violated rules (rule)."""
    assigned = scratch(assigned, "assigned")
    while True:
        reduced, open_ = reduce_rules(rules, assigned.select("lit"))
        violated = open_.join(reduced, "rule", "left_anti")
        units = single_literals(reduced).groupBy("lit").agg(F.max("rule").alias("rule"))
        clash = units.select((-F.col("lit")).alias("lit")).join(units, "lit").limit(1)
        fresh = scratch(units.select("lit", F.lit(1).cast("int").alias("kind"), "rule", F.lit(level).cast("long").alias("level")).join(assigned.select("lit"), "lit", "left_anti"), "units")
        if not violated.isEmpty() or fresh.isEmpty():
            return assigned, scratch(violated, "violated")
        stop = not clash.isEmpty()
        assigned = scratch(assigned.unionByName(fresh), "assigned")
        if stop:  # both signs: the rule of one is violated by the other
            both = assigned.join(assigned.select((-F.col("lit")).alias("lit")), "lit")
            return assigned, scratch(both.where("kind = 1").select("rule").distinct(), "violated")


def conflict_clause(rules: DataFrame, assigned: DataFrame, violated: int) -> DataFrame:
    """(lit): the clause that resolution of a violated rule with its causes gives; what the last level propagated is expanded."""
    causes = assigned.select("lit", "kind", F.col("rule").alias("cause"), "level")
    frontier = scratch(rules.where(F.col("rule") == violated).select((-F.col("lit")).alias("lit")).distinct(), "frontier")
    seen = frontier
    top = frontier.join(causes, "lit").agg(F.max("level")).first()[0]
    while True:
        inner = frontier.join(causes, "lit").where((F.col("kind") == 1) & (F.col("level") == top))
        more = inner.join(rules, inner["cause"] == rules["rule"]).where(rules["lit"] != inner["lit"]).select((-rules["lit"]).alias("lit")).distinct()
        frontier = scratch(more.join(seen, "lit", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = scratch(seen.unionByName(frontier), "seen")
    kept = seen.join(causes, "lit").where((F.col("kind") == 0) | (F.col("level") < top))
    return kept.select((-F.col("lit")).alias("lit")).distinct()


def next_literal(reduced: DataFrame) -> DataFrame:
    """The literal that occurs most in open rules; of ties the greatest."""
    counted = reduced.groupBy("lit").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.desc(F.abs("lit")), F.desc("lit")).limit(1)


class SatGraph:
    """The rules as a host sees them: clauses and equivalences go in, assignments and learned clauses come out.

    One instance, every step a few jobs over all its clauses; for many small instances: ``solver.solve_all``.
    """

    def __init__(self, clauses: DataFrame):
        spark = clauses.sparkSession
        given = scratch(clauses.select("rule", "lit").distinct(), "clauses")
        self.clauses = given.where("lit is not null")
        self.pairs = spark.createDataFrame([], "atom long, lit long")
        self.known = spark.createDataFrame([], "lit long")
        self.assigned = spark.createDataFrame([], "lit long, kind int, rule long, level long")
        self.level = 0
        self.next_rule = (self.clauses.agg(F.max("rule")).first()[0] or 0) + 1
        self.empty = not given.where("lit is null").isEmpty()  # an empty clause is a row with a null literal

    def add_rule(self, literals: list[int]) -> int:
        """A clause; its number."""
        rule, self.next_rule = self.next_rule, self.next_rule + 1
        self.empty |= not literals
        more = self.clauses.sparkSession.createDataFrame([(rule, x) for x in literals], "rule long, lit long")
        self.clauses = scratch(self.clauses.unionByName(more), "clauses")
        return rule

    def add_equivalence(self, atom: int, lit: int) -> None:
        self.pairs = scratch(self.pairs.unionByName(self.pairs.sparkSession.createDataFrame([(atom, lit)], "atom long, lit long")), "pairs")

    def simplify(self) -> bool:
        """Takes in what the clauses entail until nothing more is found; False: they can't be satisfied."""
        while not self.empty:
            self.inferred = infer(self.clauses, self.pairs, self.known)
            if self.inferred.root_conflict:
                return False
            self.known = scratch(self.inferred.singletons, "known")
            whole, _ = probe(self.inferred.reduced, self.inferred.implication, self.inferred.used)
            fresh = self.inferred.discovered_singletons.unionByName(whole).distinct().join(self.known, "lit", "left_anti").orderBy(literal_key(F.col("lit"))).first()
            if fresh:
                self.add_rule([fresh["lit"]])
                continue
            equal = self.inferred.discovered_equivalences.orderBy("atom", F.abs("lit")).first()
            if not equal:
                return True
            self.add_equivalence(equal["atom"], equal["lit"])
        return False

    def select_literal(self, lit: int) -> None:
        self.level += 1
        self.assigned = self.assigned.unionByName(self.assigned.sparkSession.createDataFrame([(lit, 0, 0, self.level)], self.assigned.schema))

    def propagate(self) -> int | None:
        """The least violated rule, if propagation ends in one."""
        self.assigned, violated = propagate(self.inferred.reduced, self.assigned, self.level)
        return violated.agg(F.min("rule")).first()[0]

    def derive_conflict_rule(self, violated: int) -> list[int]:
        return sorted((r["lit"] for r in conflict_clause(self.inferred.reduced, self.assigned, violated).collect()), key=lambda x: (abs(x), x > 0))

    def next_literal(self) -> int | None:
        best = next_literal(reduce_rules(self.inferred.reduced, self.assigned.select("lit"))[0]).first()
        return best["lit"] if best else None

    def pop_to(self, level: int) -> None:
        self.level = level
        self.assigned = scratch(self.assigned.where(F.col("level") <= level), "assigned")

    def all_assignments(self) -> DataFrame:
        """(lit): chosen, propagated and single literals, and the literals that these stand for."""
        own = self.assigned.select("lit").unionByName(self.known).distinct()
        eq = self.inferred.equivalences
        return own.join(eq, own["lit"] == eq["y"]).select(F.col("x").alias("lit")).distinct()

    def solve(self) -> list[int] | None:
        """A model in literal order, or None. Atoms that nothing decides are false."""
        atoms = {r["atom"] for r in self.clauses.select(F.abs("lit").alias("atom")).distinct().collect()}
        if not self.simplify():
            return None
        while True:
            violated = self.propagate()
            if violated is not None:
                if self.level == 0:
                    return None
                clause = self.derive_conflict_rule(violated)
                levels = {r["lit"]: r["level"] for r in self.assigned.collect()}
                below = sorted({levels[-x] for x in clause} - {self.level})
                self.add_rule(clause)
                self.pop_to(below[-1] if below else 0)
                if not self.simplify():
                    return None
                if not clause or self.level == 0:
                    self.pop_to(0)
                continue
            lit = self.next_literal()
            if lit is None:
                break
            self.select_literal(lit)
        true = {r["lit"] for r in self.all_assignments().collect()}
        value = {a: a if a in true else -a for a in atoms}
        for r in self.inferred.equivalences.where("x > 0 and x <> y").collect():  # what stands for an undecided literal follows it
            if r["x"] not in true and -r["x"] not in true:
                value[r["x"]] = r["x"] if value.get(abs(r["y"]), -abs(r["y"])) == r["y"] else -r["x"]
        return sorted(value.values(), key=lambda x: (abs(x), x > 0))
