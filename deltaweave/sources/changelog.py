"""Commit-stamped inputs and outputs that tell what has changed since they were last read.

An input is an append-only changelog: value columns, ``n`` and ``commit_id``. A relation at a commit is what the log
holds up to it; an output is a function of the commit, so that Catalyst plans the whole of it each time, and a pull is
the net difference of two such snapshots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import concat
from ..relation import N, Relation, net

Plan = Callable[[int], Relation]


class Engine:
    """Inputs and outputs of one session that share a commit counter, which starts at 0."""

    def __init__(self, spark: SparkSession):
        self.spark, self.commit_id, self.begun = spark, 0, False

    def new_input(self, schema: str | T.StructType) -> Input:
        return Input(self, schema)

    def constant(self, rows: Iterable[tuple], schema: str | T.StructType) -> Input:
        """(row, multiplicity) pairs that are there from the first commit on."""
        out = Input(self, schema)
        for row, n in rows:
            out._add(row, n, 1)
        return out

    def output(self, plan: Plan, *inputs: Input) -> Output:
        for i in inputs:
            if not self.matches(i):
                raise ValueError("an input of another engine")
        return Output(self, plan)

    def matches(self, other: Input | Output) -> bool:
        return other.engine is self

    def begin(self) -> Engine:
        self.begun = True
        return self

    def commit(self) -> int:
        """Makes what has been sent visible; nothing is computed before a pull."""
        self.commit_id += 1
        return self.commit_id


class Input:
    def __init__(self, engine: Engine, schema: str | T.StructType):
        self.engine = engine
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.rows: list[tuple] = []
        self.logs: list[DataFrame] = []

    def _add(self, row: tuple, n: int, commit_id: int) -> None:
        if n:  # a change of nothing is none
            self.rows.append((*row, n, commit_id))

    def update(self, row: tuple, n: int = 1) -> None:
        """One change, for the next commit. Many changes at once: ``append``."""
        self._add(row if isinstance(row, tuple) else (row,), n, self.engine.commit_id + 1)

    def append(self, df: DataFrame) -> None:
        """Changes for the next commit: the value columns and, where it isn't 1, ``n``."""
        if N not in df.columns:
            df = df.withColumn(N, F.lit(1).cast("long"))
        self.load(df.withColumn("commit_id", F.lit(self.engine.commit_id + 1).cast("long")))

    def load(self, log: DataFrame) -> None:
        """A changelog with ``n`` and ``commit_id`` of its own."""
        self.logs.append(log.select(*self.schema.names, F.col(N).cast("long").alias(N), F.col("commit_id").cast("long").alias("commit_id")).where(F.col(N) != 0))

    @property
    def log(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(N, T.LongType(), False), T.StructField("commit_id", T.LongType(), False)])
        logs = list(self.logs)
        if self.rows or not logs:
            logs.append(self.engine.spark.createDataFrame(self.rows, full))
        df = logs[0]
        for log in logs[1:]:
            df = df.unionByName(log)
        return df

    def at(self, commit_id: int) -> Relation:
        """The changes up to a commit; the filter reaches the scan of a stored log."""
        return Relation(self.log.where(F.col("commit_id") <= commit_id).drop("commit_id"))


class Output:
    def __init__(self, engine: Engine, plan: Plan):
        self.engine, self.plan, self.pulled = engine, plan, 0

    def snapshot(self, commit_id: int | None = None) -> Relation:
        return net(self.plan(self.engine.commit_id if commit_id is None else commit_id))

    def changes(self, old: int, new: int) -> Relation:
        """What was added and taken back between two commits."""
        if old == 0:
            return self.snapshot(new)
        return net(concat(net(self.plan(new)), net(self.plan(old)).negated()))

    def pull(self) -> Relation:
        """The net changes since the last pull, over however many commits."""
        old, self.pulled = self.pulled, self.engine.commit_id
        return self.changes(old, self.pulled)

    def dump_to_map(self, view: dict) -> dict:
        """The changes since the last pull folded into a map of the caller's: row -> multiplicity, zeros left out."""
        for row in self.pull().df.toLocalIterator():
            key, n = tuple(row)[:-1], row[N]
            key = key[0] if len(key) == 1 else key
            view[key] = view.get(key, 0) + n
            if not view[key]:
                del view[key]
        return view
