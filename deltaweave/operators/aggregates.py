"""Consolidation, counts and order statistics of a key's present values; what they return has multiplicity 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..relation import N, Relation, net

consolidate = net


def unconsolidate(relation: Relation) -> Relation:
    """The same rows, as ones that may be netted again."""
    return Relation(relation.df)


def counts(relation: Relation, name: str = "count") -> Relation:
    """(row, net count), negative counts too."""
    return Relation(net(relation).df.withColumnRenamed(N, name).withColumn(N, F.lit(1).cast("long")), distinct=True)


def distinct(relation: Relation) -> Relation:
    """Present rows, once."""
    if relation.distinct:
        return relation
    return Relation(net(relation).df.withColumn(N, F.lit(1).cast("long")), distinct=True)


def _ranked(relation: Relation, on: list[str], n: int, order: list) -> Relation:
    """The first ``n`` present rows of each key by ``order``; partial limits come before the shuffle."""
    if n < 1:
        raise ValueError("n must be at least 1")
    best = Window.partitionBy(*on).orderBy(*order)
    return Relation(distinct(relation).df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n))


def _arrays(ranked: Relation, on: list[str], value: str) -> Relation:
    listed = ranked.df.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("rank", value))).getField(value).alias(value))
    return Relation(listed.withColumn(N, F.lit(1).cast("long")), distinct=True)


def top_ns(relation: Relation, on: str | list[str], value: str, n: int, *, exploded: bool = False) -> Relation:
    """Each key's ``n`` greatest distinct values, descending, as an array; or, ``exploded``, a row each with its rank."""
    on = relation.keys(on)
    ranked = _ranked(Relation(relation.df.select(*on, value, N), consolidated=relation.consolidated, distinct=relation.distinct), on, n, [F.desc(value)])
    return Relation(ranked.df.select(*on, value, "rank", N), distinct=True) if exploded else _arrays(ranked, on, value)


def random_ns(relation: Relation, on: str | list[str], value: str, n: int, seed: int, *, exploded: bool = False) -> Relation:
    """``n`` of each key's distinct values that a hash of seed, key and value picks: the same ones each time."""
    on = relation.keys(on)
    order = [F.desc(F.xxhash64(F.lit(seed), *on, value)), F.desc(value)]
    ranked = _ranked(Relation(relation.df.select(*on, value, N), consolidated=relation.consolidated, distinct=relation.distinct), on, n, order)
    return Relation(ranked.df.select(*on, value, "rank", N), distinct=True) if exploded else _arrays(ranked, on, value)


def _present(relation: Relation) -> DataFrame:
    """Its present rows, some more than once where that saves the netting's shuffle of whole rows."""
    relation.keys(relation.columns)
    return relation.df if relation.positive else net(relation).df


def _extreme(relation: Relation, on: list[str], pick, order=None) -> Relation:
    values = [c for c in relation.columns if c not in on]
    if len(values) == 1 and order is None:
        df = _present(relation).groupBy(*on).agg(pick(F.col(values[0])).alias(values[0]))
    else:  # several values, in the order of their columns, or by an order of their own
        value = F.struct(*([order.alias("order")] if order is not None else []), *values)
        df = _present(relation).groupBy(*on).agg(pick(value).alias("best")).select(*on, *[F.col("best")[c].alias(c) for c in values])
    return Relation(df.withColumn(N, F.lit(1).cast("long")), distinct=True)


def maxes(relation: Relation, on: str | list[str], order=None) -> Relation:
    """Each key's greatest present value; ``order``: a column to compare by first."""
    return _extreme(relation, relation.keys(on), F.max, order)


def mins(relation: Relation, on: str | list[str], order=None) -> Relation:
    return _extreme(relation, relation.keys(on), F.min, order)


def _global(relation: Relation, pick, order) -> Relation:
    """The extreme row; of an empty relation no row, where SQL has a null."""
    columns = relation.columns
    value = F.struct(*([order.alias("order")] if order is not None else []), *columns)
    best = _present(relation).agg(pick(value).alias("best")).where("best is not null")
    return Relation(best.select(*[F.col("best")[c].alias(c) for c in columns], F.lit(1).cast("long").alias(N)), distinct=True)


def global_max(relation: Relation, order=None) -> Relation:
    return _global(relation, F.max, order)


def global_min(relation: Relation, order=None) -> Relation:
    return _global(relation, F.min, order)
