"""A relation: a DataFrame whose rows carry a signed multiplicity in column ``n``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N = "n"


class Relation:
    """Value columns and ``n`` (long, never null).

    Rows of net multiplicity zero are absent, those of any other are present, negative ones too. ``consolidated``: each
    row occurs once, with its net multiplicity, so that no second aggregation is planned; ``distinct``: moreover n is 1;
    ``positive``: every n is above 0, so that each row is present and what only asks for presence needs no netting.
    """

    def __init__(self, df: DataFrame, *, consolidated: bool = False, distinct: bool = False, positive: bool = False):
        self.df, self.consolidated, self.distinct, self.positive = df, consolidated or distinct, distinct, positive or distinct

    @classmethod
    def of(cls, df: DataFrame, *, distinct: bool = False) -> Relation:
        """A plain DataFrame, each of its rows once."""
        return cls(df.withColumn(N, F.lit(1).cast("long")), distinct=distinct, positive=True)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != N]

    @property
    def spark(self):
        return self.df.sparkSession

    def keys(self, on: str | list[str]) -> list[str]:
        """Key columns, checked: they exist, and none is of a floating type, which has no reliable equality."""
        on = [on] if isinstance(on, str) else list(on)
        for c in on:
            if isinstance(self.df.schema[c].dataType, (T.FloatType, T.DoubleType)):
                raise TypeError(f"{c} is {self.df.schema[c].dataType.simpleString()}: cast it to decimal to use it as a key")
        return on

    def negated(self) -> Relation:
        return Relation(self.df.withColumn(N, -F.col(N)), consolidated=self.consolidated)


def net(relation: Relation) -> Relation:
    """Each row once with its net multiplicity, absent rows left out; a relation that is so already is returned as it is."""
    if relation.consolidated:
        return relation
    columns = relation.keys(relation.columns)
    if not columns:
        df = relation.df.agg(F.coalesce(F.sum(N), F.lit(0)).cast("long").alias(N))
    else:
        df = relation.df.groupBy(*columns).agg(F.sum(N).alias(N))
    return Relation(df.where(F.col(N) != 0), consolidated=True)
