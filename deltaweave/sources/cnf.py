"""CNF files: blank and comment lines, a header ``p cnf atoms clauses``, then that many clauses, each ended by 0."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..relation import Relation


def parse_cnf(lines: Iterable[str]) -> Iterator[list[int]]:
    """The clauses. Comments stand before the header only; what doesn't fit raises ValueError."""
    lines = iter(lines)
    for line in lines:
        if line.strip() and not line.startswith("c"):
            break
    else:
        raise ValueError("no header")
    head = line.split()
    if head[:2] != ["p", "cnf"] or len(head) != 4:
        raise ValueError(f"not a header: {line!r}")
    left = int(head[3])
    clause: list[int] = []
    for line in lines:
        for word in line.split():
            if not left:
                return
            if (lit := int(word)) == 0:
                yield clause
                clause, left = [], left - 1
            else:
                clause.append(lit)
    if left:
        raise ValueError(f"{left} clauses are missing")


CLAUSE = T.StructType([T.StructField("rule", T.LongType(), False), T.StructField("lit", T.LongType(), True)])


def read_cnf(spark: SparkSession, text: str) -> Relation:
    """(rule, lit) of a CNF text; clauses are numbered from 0, an empty clause is one row with a null literal."""
    rows = [(i, lit) for i, clause in enumerate(parse_cnf(text.splitlines())) for lit in clause or [None]]
    return Relation.of(spark.createDataFrame(rows, CLAUSE))
