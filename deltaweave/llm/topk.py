"""Exact top-k by inner product with vector-approximation files.

Vectors lie in blocks; a block has, beside its exact rows, a file of quantised cells on a grid of its own. A block of
queries scans the cells: the middle of a cell gives a score, half its width a bound on the error. Exact rows are read
in the order of their upper bounds until the k-th result is certain. Blocks of queries meet blocks of vectors; no
row meets another outside a block pair, and each pair gives k rows a query at most, merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, trimmed, written

BLOCK = "dim int, ids binary, exact binary, cells binary, low binary, step binary"
#: Exact vectors that are read at a time, in the order of the bounds.
READ = 64


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, components as doubles), without rows that are null or hold null or non-finite components, or have no id."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
    finite = F.forall("x", lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)


def blocks(rows: DataFrame, size: int, scale: int, bits: int) -> DataFrame:
    """Rows of ``vectors`` as blocks of up to ``size`` of one dimension: ids, floor(scale * x), and their cells."""

    def block(ids: list, x: np.ndarray) -> tuple:
        exact = np.floor(x * scale)
        low, high = (exact.min(0), exact.max(0)) if exact.size else (np.zeros(exact.shape[1]), np.zeros(exact.shape[1]))
        step = np.maximum((high - low) / (1 << bits), np.finfo(np.float64).tiny)
        cells = np.minimum((exact - low) / step, (1 << bits) - 1).astype(np.uint8)
        return exact.shape[1], np.asarray(ids, np.int64).tobytes(), exact.tobytes(), cells.tobytes(), low.tobytes(), step.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            column = batch.column(1)
            at = np.asarray(column.offsets)
            flat = column.values.to_numpy(zero_copy_only=False)
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                ids, xs = held.setdefault(int(at[i + 1] - at[i]), ([], []))
                ids.append(vec_id)
                xs.append(flat[at[i] : at[i + 1]])
                if len(ids) >= size:
                    yield arrow(BLOCK, [[v] for v in block(ids, np.array(xs))])
                    ids.clear()
                    xs.clear()
        for ids, xs in held.values():
            if ids:
                yield arrow(BLOCK, [[v] for v in block(ids, np.array(xs))])

    return rows.mapInArrow(trimmed(run), BLOCK)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held to the range of a long."""
    most = max(np.abs(q).max(initial=0), np.abs(v).max(initial=0))
    if most * most * max(q.shape[-1], 1) < 2.0**53:
        return (v @ q).astype(np.int64)
    own = [int(x) for x in q]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * int(b) for a, b in zip(own, row)))) for row in v], np.int64)


def _search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, exact: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    middle = low + (cells + 0.5) * step
    near = queries @ middle.T
    # the error of a score: half a cell's width a dimension, and what rounding may add
    slack = np.abs(queries) @ (step / 2)
    slack = slack + 1e-9 * (np.abs(queries) @ np.abs(middle).max(0, initial=0) + slack) + 1e-6
    for i, query_id in enumerate(query_ids):
        upper = near[i] + slack[i]
        own = np.flatnonzero(ids == query_id)
        upper[own] = -np.inf
        left = len(ids) - len(own)
        if not left:
            continue
        if left > k:  # the k-th best lower bound: what lies under it by its upper bound is out
            sure = np.partition(near[i] - slack[i] if not len(own) else np.delete(near[i], own) - slack[i], left - k)[left - k]
            order = np.flatnonzero(upper >= sure)
        else:
            order = np.flatnonzero(upper > -np.inf)
        order = order[np.argsort(-upper[order], kind="stable")]
        found, scores, to = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while to < len(order) and (len(scores) < k or upper[order[to]] >= scores[k - 1]):
            read = order[to : to + READ]
            to += READ
            found = np.concatenate([found, read])
            scores = np.concatenate([scores, _scores(queries[i], exact[read])])
            best = np.lexsort((ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
        yield query_id, ids[found], scores


def top_k(df: DataFrame, queries: DataFrame, *, k: int = 20, scale: int = 64, bits: int = 6, query_block: int = 512, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k rows of ``df`` with the highest integer inner product, exactly.

    Components count as floor(scale * x). Ties go to the smaller id; a query's own id is no candidate. Fewer than k
    candidates: all. Vectors that are null or hold null or non-finite components, and null ids, take no part; vectors
    meet only vectors of their length. Repeated rows are candidates each; a repeated query gives its rows once.
    """
    bounded_batches(df.sparkSession)
    stored = written(blocks(vectors(df, id_col, vector_col), block, scale, bits), "va-files")
    asked = written(blocks(vectors(queries, id_col, vector_col).dropDuplicates(["vec_id"]), query_block, scale, bits).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact")), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if (d := row["dim"]) != row["q_dim"]:
                    continue
                ids, query_ids = (np.frombuffer(row[c], np.int64) for c in ("ids", "q_ids"))
                exact, q = np.frombuffer(row["exact"]).reshape(len(ids), d), np.frombuffer(row["q_exact"]).reshape(len(query_ids), d)
                cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), d)
                out = list(_search(query_ids, q, ids, exact, cells, np.frombuffer(row["low"]), np.frombuffer(row["step"]), k))
                if out:
                    yield arrow("query_id long, vec_id long, score long", (np.repeat([x[0] for x in out], [len(x[1]) for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        stored.crossJoin(asked)
        .mapInArrow(trimmed(run), "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op4_topk(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(df, df.where(F.col("vec_id") % 20 == 0))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
