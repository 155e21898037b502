"""Addition, weighted intersection and difference of relations of the same columns."""

from __future__ import annotations

from ..relation import Relation, net
from .joins import antijoin, join


def concat(*relations: Relation) -> Relation:
    """Multiplicities add: all rows of all."""
    df = relations[0].df
    for r in relations[1:]:
        df = df.unionByName(r.df)
    return Relation(df, consolidated=len(relations) == 1 and relations[0].consolidated)


def intersection(left: Relation, right: Relation) -> Relation:
    """Rows of both, net multiplicities multiplied."""
    return join(net(left), net(right), left.columns)


def set_minus(left: Relation, right: Relation) -> Relation:
    """Left rows that are absent from right, with their own multiplicity."""
    return antijoin(left, right, left.columns)
