"""Projections, filters and explosions: narrow, and none merges rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..relation import N, Relation


def map(relation: Relation, **values: Column | str) -> Relation:  # noqa: A001
    """Each row to the row of ``values``, with its multiplicity."""
    return Relation(relation.df.select(*[(F.expr(v) if isinstance(v, str) else v).alias(name) for name, v in values.items()], N))


map_h = map


def flat_map(relation: Relation, rows: Column | str, **values: Column | str) -> Relation:
    """Each row to as many as the array ``rows`` has elements, which ``values`` call ``it``; each with the row's multiplicity."""
    exploded = relation.df.withColumn("it", F.explode(F.expr(rows) if isinstance(rows, str) else rows))
    return map(Relation(exploded), **values)


flat_map_h = flat_map


def filter(relation: Relation, condition: Column | str) -> Relation:  # noqa: A001
    return Relation(relation.df.where(condition), consolidated=relation.consolidated, distinct=relation.distinct)


def flatten(relation: Relation, column: str, name: str | None = None) -> Relation:
    """A row for each element of an array column; empty and null arrays give none."""
    others = [c for c in relation.columns if c != column]
    return Relation(relation.df.select(*others, F.explode(column).alias(name or column), N))


flatten_h = flatten


def fsts(relation: Relation, on: str | list[str]) -> Relation:
    """The key columns alone; nothing is deduplicated."""
    return Relation(relation.df.select(*([on] if isinstance(on, str) else on), N))


def snds(relation: Relation, on: str | list[str]) -> Relation:
    """All but the key columns."""
    on = [on] if isinstance(on, str) else on
    return Relation(relation.df.select(*[c for c in relation.columns if c not in on], N))


def swaps(relation: Relation, k: str = "k", v: str = "v") -> Relation:
    """Key and value change places."""
    return Relation(relation.df.select(F.col(v).alias(k), F.col(k).alias(v), N), consolidated=relation.consolidated, distinct=relation.distinct)


def split(relation: Relation, on: str | list[str]) -> tuple[Relation, Relation]:
    return fsts(relation, on), snds(relation, on)


def partition(relation: Relation, is_left: Column | str, left: dict[str, Column | str], right: dict[str, Column | str]) -> tuple[Relation, Relation]:
    """Rows where ``is_left`` as ``left``'s values, the others as ``right``'s; a null test is not left."""
    test = F.coalesce(F.expr(is_left) if isinstance(is_left, str) else is_left, F.lit(False))
    return map(filter(relation, test), **left), map(filter(relation, ~test), **right)
