"""Equi-joins whose multiplicities multiply. Null keys equal each other; Spark picks the physical join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..relation import N, Relation, net


def same(left, right, on: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in on])


def join(left: Relation, right: Relation, on: str | list[str]) -> Relation:
    """Key, left's values, right's values; a right value whose name is taken gets ``_right`` behind it."""
    on = left.keys(on)
    right.keys(on)
    l, r = left.df.alias("l"), right.df.alias("r")
    own = [c for c in left.columns if c not in on]
    other = [c for c in right.columns if c not in on]
    named = [F.col(f"r.{c}").alias(f"{c}_right" if c in left.columns else c) for c in other]
    condition = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
    df = l.join(r, condition).select(*[F.col(f"l.{c}") for c in on], *[F.col(f"l.{c}") for c in own], *named, (F.col(f"l.{N}") * F.col(f"r.{N}")).alias(N))
    return Relation(df, consolidated=left.consolidated and right.consolidated, distinct=left.distinct and right.distinct)


def join_values(left: Relation, right: Relation, on: str | list[str]) -> Relation:
    """``join`` without its key; nothing is deduplicated."""
    joined = join(left, right, on)
    on = [on] if isinstance(on, str) else on
    return Relation(joined.df.drop(*on))


def semijoin(left: Relation, right: Relation, on: str | list[str]) -> Relation:
    """Left rows with a key of right, multiplicities multiplied; a plain left semi-join only where right is distinct."""
    on = left.keys(on)
    keys = net(Relation(right.df.select(*on, N), consolidated=right.consolidated and right.columns == on, distinct=right.distinct and right.columns == on))
    if keys.distinct:
        return Relation(left.df.join(keys.df, same(left.df, keys.df, on), "left_semi"), consolidated=left.consolidated, distinct=left.distinct)
    return join(left, keys, on)


def antijoin(left: Relation, right: Relation, on: str | list[str]) -> Relation:
    """Left rows whose key is absent from right, with their own multiplicity; a negative net count is present."""
    on = left.keys(on)
    keys = net(Relation(right.df.select(*on, N), consolidated=right.consolidated and right.columns == on, distinct=right.distinct and right.columns == on))
    df = left.df.join(keys.df, same(left.df, keys.df, on), "left_anti")
    return Relation(df, consolidated=left.consolidated, distinct=left.distinct)


def cartesian_product(left: Relation, right: Relation) -> Relation:
    """Every pair, multiplicities multiplied: for relations of a few rows. Taken names get ``_right`` behind them."""
    r = right.df.select(*[F.col(c).alias(f"{c}_right" if c in left.columns else c) for c in right.columns], F.col(N).alias("n_right"))
    df = left.df.crossJoin(r).withColumn(N, F.col(N) * F.col("n_right")).drop("n_right")
    return Relation(df.select(*[c for c in df.columns if c != N], N), consolidated=left.consolidated and right.consolidated, distinct=left.distinct and right.distinct)
