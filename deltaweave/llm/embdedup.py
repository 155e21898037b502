"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation, learned on a bounded sample so that the signs of the rotated components are balanced and lose little,
gives every vector a code of as many bits as it has dimensions, 64 at most. Codes are cut into chunks, each with a
table of its own: of two codes that differ in at most the radius, some chunk differs in no more than the radius divided
by the number of chunks, so each vector looks up its own chunk and those that near. With more vectors of a label the
chunks are fewer and wider, so that a lookup meets about as many rows at every size; what is found stays the same. What
the tables bring within the radius is compared by its vectors. Equal vectors are one entry with a multiplicity, so copies don't meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, hash_sample, trimmed, written
from .components import components

#: Rows that the rotation is learned on, about; chosen by the hash of their id.
SAMPLE = 10_000
#: Bits in which the codes of a pair may differ.
RADIUS = 11


def learn_rotation(x: np.ndarray, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation d x bits) of unit vectors: principal axes, then alternately the nearest codes and the best rotation."""
    d = x.shape[1]
    bits = min(64, d)
    mean = x.mean(0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    projected = centred @ axes
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
        rotation = (u @ v).T
    return mean, axes @ rotation


def _codes(units: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    signs = ((units - mean) @ rotation >= 0).astype(np.uint64)
    return (signs << np.arange(signs.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)


def tables_of(rows: int, bits: int, radius: int) -> tuple[int, int, int]:
    """(chunks, bits of a chunk, bits that a lookup may be off): the cheapest that find every pair within ``radius``.

    A row costs its lookups and what they meet in a table of ``rows``.
    """

    def cost(chunks: int) -> float:
        width, off = -(-bits // chunks), radius // chunks
        return chunks * sum(comb(width, j) for j in range(off + 1)) * (1 + rows / 2**width)

    fit = [c for c in range(-(-bits // 24), min(bits, radius + 1) + 1) if (c - 1) * -(-bits // c) < bits]  # no chunk is empty
    chunks = min(fit or [-(-bits // 24)], key=cost)
    return chunks, -(-bits // chunks), radius // chunks


def near_duplicates(df: DataFrame, *, threshold: float = 0.93, radius: int = RADIUS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row a row of ``df``.

    Vectors link when their labels are equal and not null, their lengths equal, and their cosine in double precision
    at least ``threshold``. A vector that is null, zero or holds null or non-finite components, or has no label, links
    with nothing and is its own component. Of the pairs that link, those whose codes differ in at most ``radius`` bits
    are found, every one of them; none is capped. Ids are taken as unique; a null id is a row by itself.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: F.coalesce((v > float("-inf")) & (v < float("inf")), F.lit(False))) & F.exists("x", lambda v: v != 0)
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    classes = usable.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    sample = [np.array(r["x"]) for r in hash_sample(classes.select("x", "rep"), "rep", SAMPLE).collect()]
    models = {}
    for d in {len(x) for x in sample}:
        x = np.array([v for v in sample if len(v) == d])
        models[d] = learn_rotation(x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(3).offsets)
            flat = batch.column(3).values.to_numpy(zero_copy_only=False)
            code, unit = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            for d in np.unique(np.diff(at)):
                own = np.flatnonzero(np.diff(at) == d)
                x = flat[at[own][:, None] + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                if d not in models:
                    models[d] = np.zeros(d), np.linalg.qr(np.random.default_rng(int(d)).standard_normal((d, d)))[0][:, : min(64, d)]
                code[own] = _codes(x, *models[d])
                for i, u in zip(own, x, strict=True):
                    unit[i] = u.tobytes()
            yield arrow("label string, rep long, copies long, dim int, code long, unit binary", (batch.column(0), batch.column(1), batch.column(2), np.diff(at).astype(np.int32), code, unit))

    coded = written(classes.select("label", "rep", "copies", "x").mapInArrow(trimmed(run), "label string, rep long, copies long, dim int, code long, unit binary"), "codes")
    size = coded.groupBy("label", "dim").count().agg(F.max("count").alias("rows"), F.max("dim").alias("dim")).first()
    chunks, width, off = tables_of(size["rows"] or 0, min(64, size["dim"] or 1), radius)
    flips = [sum(1 << j for j in flipped) for n in range(off + 1) for flipped in combinations(range(width), n)]
    chunk = lambda i: F.shiftrightunsigned(F.col("code"), i * width).bitwiseAND(F.lit((1 << width) - 1))
    tables = coded.select("label", "dim", "rep", "code", F.posexplode(F.array(*[chunk(i) for i in range(chunks)])).alias("t", "value"))
    probes = tables.select("label", "dim", F.col("rep").alias("a"), F.col("code").alias("code_a"), "t", F.explode(F.transform(F.lit(flips).cast("array<long>"), lambda f: F.col("value").bitwiseXOR(f))).alias("value"))
    apart = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code"))) <= radius
    index = tables.withColumnRenamed("rep", "b")
    pairs = probes.join(index, ["label", "dim", "t", "value"]).where((F.col("a") < F.col("b")) & apart).select("a", "b").distinct()

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ua, ub = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cosine = np.array([np.frombuffer(x) @ np.frombuffer(y) for x, y in zip(ua, ub, strict=True)])
            links = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(links) for i in (0, 1, 4, 5)], ["a", "b", "copies_a", "copies_b"])

    left = coded.select(F.col("rep").alias("a"), F.col("unit").alias("ua"), F.col("copies").alias("copies_a"))
    right = coded.select(F.col("rep").alias("b"), F.col("unit").alias("ub"), F.col("copies").alias("copies_b"))
    links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub", "copies_a", "copies_b").mapInArrow(trimmed(rerank), "a long, b long, copies_a long, copies_b long"), "vector-links")
    linked = links.select(F.col("a").alias("rep"), F.col("copies_b").alias("n")).unionByName(links.select(F.col("b").alias("rep"), F.col("copies_a").alias("n"))).groupBy("rep").agg(F.sum("n").alias("n"))
    reached = components(links).select(F.col("id").alias("rep"), "component_id")
    per_class = coded.select("label", "rep", "copies").join(linked, "rep", "left").join(reached, "rep", "left")
    per_class = per_class.select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    member = usable.join(classes.select("label", "x", "rep"), ["label", "x"]).select("vec_id", "rep").join(per_class, "rep").select(F.col("vec_id").alias("v"), "n_links", "component_id")
    out = rows.select("vec_id").join(member, F.col("vec_id") == F.col("v"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda c: c * c))) AS norm FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
n AS (SELECT a, count(*)::BIGINT AS n FROM link GROUP BY a), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
