"""Connected components by contraction, in rounds that shrink the graph whatever its shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): for each vertex of ``links`` the smallest vertex it reaches.

    In a round each vertex goes over to that one of itself and its neighbours whose hash, another each round, is
    least; links inside a merged vertex go. A clique or star ends in one round, a path in a number of rounds that
    grows with the logarithm of its length. Each round's table is written, so no lineage grows and nothing is
    collected.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        n = F.lit(len(maps))
        choice = edges.groupBy("a").agg(F.min(F.struct(F.xxhash64(n, F.col("b")).alias("h"), F.col("b"))).alias("m"))
        own = F.struct(F.xxhash64(n, F.col("a")).alias("h"), F.col("a").alias("b"))
        moves = written(choice.select(F.col("a").alias("id"), F.least(own, F.col("m"))["b"].alias("to")), "moves")
        maps.append(moves)
        half = edges.join(moves, edges["a"] == moves["id"]).select(F.col("to").alias("a"), "b")
        before, edges = edges, written(half.join(moves, half["b"] == moves["id"]).select("a", F.col("to").alias("b")).where("a <> b").distinct(), "edges")
        discard(before)
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    roots = maps[0]
    for later in maps[1:]:
        later = later.select(F.col("id").alias("via"), F.col("to").alias("then"))
        roots = roots.join(later, roots["to"] == later["via"], "left").select("id", F.coalesce("then", "to").alias("to"))
    least = roots.groupBy("to").agg(F.min("id").alias("component_id"))
    found = written(roots.join(least, "to").select("id", "component_id"), "components")
    discard(edges, *maps)
    return found
