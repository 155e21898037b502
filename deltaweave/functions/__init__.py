"""Scalar functions over literals: signed longs, of which 0 is none; order is by atom, then negative before positive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def negation(lit: Column) -> Column:
    return -lit


def atom(lit: Column) -> Column:
    return F.abs(lit)


def sign(lit: Column) -> Column:
    return lit > 0


def with_sign(atom_: Column, positive: Column) -> Column:
    return F.when(positive, atom_).otherwise(-atom_)


def literal_key(lit: Column) -> Column:
    """What to compare literals by; plain numeric order is another."""
    return F.struct(F.abs(lit).alias("atom"), (lit > 0).alias("sign"))


def literal_min(a: Column, b: Column) -> Column:
    return F.when(literal_key(a) <= literal_key(b), a).otherwise(b)


def literal_max(a: Column, b: Column) -> Column:
    return F.when(literal_key(a) <= literal_key(b), b).otherwise(a)


def decision(level: Column) -> Column:
    """The cause of a chosen literal; it is before any propagated one."""
    return F.struct(F.lit(0).cast("tinyint").alias("kind"), F.lit(0).cast("long").alias("rule"), level.cast("long").alias("level"))


def propagated(rule: Column, level: Column) -> Column:
    return F.struct(F.lit(1).cast("tinyint").alias("kind"), rule.cast("long").alias("rule"), level.cast("long").alias("level"))


def sanitized(clause: Column) -> Column:
    """A clause's literals, each once, in literal order."""
    keyed = F.transform(F.array_distinct(clause), lambda x: F.struct(F.abs(x).alias("atom"), (x > 0).alias("sign"), x.alias("lit")))
    return F.transform(F.array_sort(keyed), lambda s: s["lit"])


def tautology_atom(clause: Column) -> Column:
    """The least atom that a clause holds with both signs; null if none."""
    return F.array_min(F.transform(F.filter(clause, lambda x: (x > 0) & F.array_contains(clause, -x)), lambda x: F.abs(x)))


def formatted(clause: Column) -> Column:
    """The clause as a line of a proof: its literals, then 0."""
    return F.concat_ws(" ", F.transform(clause, lambda x: x.cast("string")), F.lit("0"))
