"""The operators over streams of changes: rows with ``n``, of which a consolidated result is the sum.

Projections, filters, ``concat`` and the joins of ``deltaweave.operators`` take streams as they are: an inner join of two
streams in append mode meets each pair of changes once, with the product of their multiplicities. What must take back
what it said before (presence, counts, order statistics, anti-join) keeps each key's net rows as state and emits the
change of its view. Integers cross to Python as decimals, so that those beside nulls stay whole; a NaN counts as null.
A null is less than all other values for ``top_ns`` and ``maxes``, and the least of a key only where it has no other.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..relation import N, Relation

View = Callable[[dict], dict]
_STATE = T.StructType([T.StructField("rows", T.BinaryType())])


def changes(df: DataFrame) -> Relation:
    """A stream of changes; without ``n`` each row is one that comes."""
    return Relation(df if N in df.columns else df.withColumn(N, F.lit(1).cast("long")))


def consolidated(stream: Relation) -> DataFrame:
    """Net multiplicities as a view, for output modes complete and update; read it with ``n <> 0``."""
    return stream.df.groupBy(*stream.columns).agg(F.sum(N).alias(N))


def keyed_changes(stream: Relation, on: list[str], view: View, values: T.StructType) -> Relation:
    """The changes of ``view``, a function of a key's net rows (value tuple -> n) to rows of ``values`` (tuple -> n)."""
    own = [c for c in stream.columns if c not in on]
    schema = stream.df.schema
    out = T.StructType([*[schema[c] for c in on], *values.fields, T.StructField(N, T.LongType())])
    whole = {c for c in own if isinstance(schema[c].dataType, T.IntegralType)}

    def plain(v, integer: bool):
        if v is None or v is pd.NaT or v != v:
            return None
        if integer:
            return int(v)
        return v.item() if hasattr(v, "item") else v

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        net = pickle.loads(state.get[0]) if state.exists else {}
        before = view(net)
        for batch in batches:
            rows = zip(*(batch[c] for c in own)) if own else [()] * len(batch)
            for row, n in zip(rows, batch[N]):
                row = tuple(plain(v, c in whole) for c, v in zip(own, row))
                net[row] = net.get(row, 0) + int(n)
                if not net[row]:
                    del net[row]
        if net:
            state.update((pickle.dumps(net),))
        elif state.exists:
            state.remove()
        diff = Counter(view(net))
        diff.subtract(before)
        rows = [(*key, *row, n) for row, n in diff.items() if n]
        if rows:
            yield pd.DataFrame(rows, columns=out.names, dtype=object)

    df = stream.df.select(*on, *[F.col(c).cast("decimal(20,0)").alias(c) if c in whole else c for c in own], N).groupBy(*on).applyInPandasWithState(run, out, _STATE, "append", GroupStateTimeout.NoTimeout)
    return Relation(df)


def _order(row: tuple) -> tuple:
    return row[0] is not None, row[0] if row[0] is not None else 0


def _least(net: dict) -> tuple:
    return min([row for row in net if row[0] is not None], default=(None,))


def distinct(stream: Relation) -> Relation:
    return keyed_changes(stream, stream.columns, lambda net: {(): 1} if net else {}, T.StructType([]))


def counts(stream: Relation, name: str = "count") -> Relation:
    return keyed_changes(stream, stream.columns, lambda net: {(net[()],): 1} if net else {}, T.StructType([T.StructField(name, T.LongType())]))


def top_ns(stream: Relation, on: list[str], value: str, n: int) -> Relation:
    """(key, value, rank) of each key's greatest distinct values."""
    narrow = Relation(stream.df.select(*on, value, N))
    kinds = T.StructType([stream.df.schema[value], T.StructField("rank", T.IntegerType())])
    return keyed_changes(narrow, on, lambda net: {(v, i): 1 for i, (v,) in enumerate(sorted(net, key=_order, reverse=True)[:n], 1)}, kinds)


def maxes(stream: Relation, on: list[str], value: str) -> Relation:
    narrow = Relation(stream.df.select(*on, value, N))
    return keyed_changes(narrow, on, lambda net: {max(net, key=_order): 1} if net else {}, T.StructType([stream.df.schema[value]]))


def mins(stream: Relation, on: list[str], value: str) -> Relation:
    narrow = Relation(stream.df.select(*on, value, N))
    return keyed_changes(narrow, on, lambda net: {_least(net): 1} if net else {}, T.StructType([stream.df.schema[value]]))


def antijoin(left: Relation, right: Relation, on: list[str]) -> Relation:
    """Left's changes while their key is absent from right; both sides are one stream, keyed by ``on``."""
    own = [c for c in left.columns if c not in on]
    a = left.df.select(*on, F.lit(0).alias("side"), *own, N)
    b = right.df.select(*on, F.lit(1).alias("side"), *[F.lit(None).cast(left.df.schema[c].dataType).alias(c) for c in own], N)

    def view(net: dict) -> dict:
        if any(row[0] == 1 for row in net):
            return {}
        return {row[1:]: n for row, n in net.items()}

    return keyed_changes(Relation(a.unionByName(b)), on, view, T.StructType([left.df.schema[c] for c in own]))
