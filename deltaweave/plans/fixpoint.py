"""Recursion: inputs that feed on rules until nothing changes, stop conditions, and frames that undo.

A round evaluates the rules in the order in which they were registered. The first one that adds rows to its input
starts the order anew, so a rule runs only when those before it have nothing to add; a stop condition stands in the
same order. Each addition is written and read beside those before it; every few of them are written together, which
keeps plans short however many rounds there are and doesn't rewrite all that is known each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import same
from ..relation import Relation
from ..sources.tables import scratch

Rule = Callable[["Loop"], DataFrame]
#: Written additions that are read side by side; one more, and they are written together.
PARTS = 8


class _Known:
    """Rows that only grow, as a union of written tables."""

    def __init__(self, df: DataFrame, name: str):
        self.df, self.name, self.parts = df, name, 1

    def add(self, more: DataFrame) -> None:
        self.df, self.parts = self.df.unionByName(more), self.parts + 1
        if self.parts > PARTS:
            self.df, self.parts = scratch(self.df, self.name), 1


class _Input:
    """A set of rows with the frame they came in; ``keys``: one row a key, the first; ``frames``: whether they can be undone."""

    def __init__(self, schema: T.StructType, keys: list[str] | None, frames: bool):
        self.schema, self.keys, self.frames = schema, keys or schema.names, frames
        self.keyed = keys is not None
        self.known: _Known | None = None

    @property
    def df(self) -> DataFrame:
        return self.known.df


class Loop:
    """``name -> set input``; rules read inputs by ``loop["name"]`` and must be functions of them alone."""

    def __init__(self, spark: SparkSession, max_rounds: int = 10_000):
        self.spark, self.max_rounds, self.depth = spark, max_rounds, 0
        self.inputs: dict[str, _Input] = {}
        self.steps: list[tuple[str | None, Rule]] = []

    def _new(self, name: str, schema: str, keys: list[str] | None, frames: bool) -> None:
        own = _Input(T.StructType.fromDDL(schema), keys, frames)
        own.known = _Known(self.spark.createDataFrame([], T.StructType([*own.schema.fields, T.StructField("frame", T.IntegerType(), False)])), name)
        self.inputs[name] = own

    def new_input(self, name: str, schema: str) -> None:
        self._new(name, schema, None, True)

    def new_first_occurrences_input(self, name: str, schema: str, keys: list[str]) -> None:
        """The first value of a key stays; of several in one round the greatest."""
        self._new(name, schema, keys, True)

    def new_frameless_input(self, name: str, schema: str) -> None:
        """Rows that no frame takes back."""
        self._new(name, schema, None, False)

    def set_feedback(self, name: str, rule: Rule) -> None:
        self.steps.append((name, rule))

    def set_interrupt(self, condition: Rule) -> int:
        """Stops a commit while ``condition`` has rows; its number, which ``commit`` returns."""
        self.steps.append((None, condition))
        return sum(target is None for target, _ in self.steps) - 1

    def __getitem__(self, name: str) -> DataFrame:
        return self.inputs[name].df.drop("frame")

    def output(self, rule: Rule) -> DataFrame:
        """A view as a set: the distinct rows of a plan over the inputs."""
        return rule(self).distinct()

    def is_empty(self, rule: Rule) -> bool:
        return rule(self).isEmpty()

    def insert(self, name: str, rows: DataFrame | list[tuple]) -> bool:
        """Whether any of the rows was new."""
        own = self.inputs[name]
        if isinstance(rows, list):
            rows = self.spark.createDataFrame(rows, own.schema)
        rows = rows.select(*own.schema.names).distinct()
        if own.keyed:
            values = [c for c in own.schema.names if c not in own.keys]
            rows = rows.groupBy(*own.keys).agg(F.max(F.struct(*values)).alias("v")).select(*own.keys, *[F.col("v")[c].alias(c) for c in values])
        fresh = rows.join(own.df, same(rows, own.df, own.keys), "left_anti").withColumn("frame", F.lit(self.depth if own.frames else 0))
        fresh = scratch(fresh, name)
        if fresh.isEmpty():
            return False
        own.known.add(fresh)
        return True

    def commit(self) -> int | None:
        """Runs to the fixpoint: None, or the number of the interrupt that stopped it."""
        for _ in range(self.max_rounds):
            interrupts = -1
            for target, rule in self.steps:
                if target is None:
                    interrupts += 1
                    if not rule(self).isEmpty():
                        return interrupts
                elif self.insert(target, rule(self)):
                    break
            else:
                return None
        raise RuntimeError(f"no fixpoint after {self.max_rounds} rounds")

    def push_frame(self) -> None:
        self.depth += 1

    def pop_frame_(self) -> None:
        """Takes back what came since the frame was opened, by hand or by rule, without a commit."""
        if not self.depth:
            raise RuntimeError("no frame is open")
        for own in self.inputs.values():
            if own.frames:
                own.known.df = own.df.where(F.col("frame") < self.depth)
                own.known.parts += 1  # a step of the plan, too
        self.depth -= 1

    def pop_frame(self) -> int | None:
        self.pop_frame_()
        return self.commit()

    @contextmanager
    def with_frame(self, commit: bool = True) -> Iterator[Loop]:
        self.push_frame()
        try:
            yield self
        finally:
            self.pop_frame_()
            if commit:
                self.commit()


def semi_naive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000) -> DataFrame:
    """The least set that holds ``seed`` and is closed under the linear rule ``step``; each round joins only new rows."""
    delta = scratch(seed.distinct(), "delta")
    known = _Known(delta, "known")
    for _ in range(max_rounds):
        found = step(delta).distinct()
        delta = scratch(found.join(known.df, same(found, known.df, found.columns), "left_anti"), "delta")
        if delta.isEmpty():
            return known.df
        known.add(delta)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def closure(edges: Relation | DataFrame, src: str = "src", dst: str = "dst") -> Relation:
    """(src, dst): all pairs with a way of one edge or more.

    Paths double each round, so rounds grow as their logarithm; a round joins only pairs of which one is new.
    """
    df = edges.df if isinstance(edges, Relation) else edges
    then = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    delta = scratch(df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "closure")
    known, more = _Known(delta, "closure"), then(delta, delta)
    while True:
        found = more.distinct()
        delta = scratch(found.join(known.df, same(found, known.df, ["src", "dst"]), "left_anti"), "closure")
        if delta.isEmpty():
            return Relation.of(known.df, distinct=True)
        old = known.df
        known.add(delta)
        more = then(delta, known.df).unionByName(then(old, delta))


def shortest_paths(edges: DataFrame, start, max_rounds: int = 10_000) -> Relation:
    """(node, d) from ``start`` over edges (src, dst, w >= 0): each round relaxes the edges of nodes that got nearer."""
    kind = edges.schema["src"].dataType
    known = delta = edges.sparkSession.createDataFrame([(start, 0)], T.StructType([T.StructField("node", kind), T.StructField("d", T.LongType())]))
    for _ in range(max_rounds):
        offers = edges.join(delta, edges["src"] == delta["node"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("d") + F.col("w")).cast("long").alias("d"))
        old = known.select(F.col("node").alias("node_"), F.col("d").alias("d_"))
        delta = scratch(offers.join(old, F.col("node") == F.col("node_"), "left").where("d_ is null or d < d_").select("node", "d"), "delta")
        if delta.isEmpty():
            return Relation.of(known, distinct=True)
        known = scratch(known.unionByName(delta).groupBy("node").agg(F.min("d").alias("d")), "known")
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def settled_distance(spark: SparkSession, edges: list[tuple[str, str, int]], start: str, end: str) -> int | None:
    """The shortest way by a ``Loop``: nodes settle nearest first, and an interrupt stops it at ``end``."""
    loop = Loop(spark)
    loop.new_frameless_input("edge", "src string, dst string, w long")
    loop.new_first_occurrences_input("distance", "node string, d long", ["node"])

    def next_nodes(at: Loop) -> DataFrame:
        known, edge = at["distance"], at["edge"]
        offers = known.join(edge, known["node"] == edge["src"]).select(F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        offers = offers.join(known.select("node"), "node", "left_anti").groupBy("node").agg(F.min("d").alias("d"))
        least = offers.agg(F.min("d").alias("least"))
        return offers.crossJoin(F.broadcast(least)).where("d = least").select("node", "d")  # one row of one number

    loop.set_interrupt(lambda at: at["distance"].where(F.col("node") == end).limit(1))
    loop.set_feedback("distance", next_nodes)
    loop.insert("edge", edges)
    loop.insert("distance", [(start, 0)])
    if loop.commit() is None:
        return None
    return loop["distance"].where(F.col("node") == end).first()["d"]
