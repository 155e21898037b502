"""Exact Jaccard join of word-shingle sets by grouped prefixes, for links and their components.

Documents of one set are one class. A class's prefix is its rarest shingles: any partner shares one of them. How rare
a shingle is comes from a sketch of counts over all documents, of fixed size; any order gives the same links, a good
one fewer candidates. Classes of one prefix and size are a group, and groups stand for their members until a pair of
groups has passed the filters by size and position.

Candidates come in two rounds. First each shingle's group with the earliest position is its pivot and meets the other
groups there, and a group's first member the others: in a crowd of near copies that is enough to link it, at one pair a
member. Then only members of different components that share a prefix shingle, or are of one group, meet. So a crowd
never makes all its pairs, and no pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, may_hold
from .common import arrow, discard, free_tools, grams, mix, sliced, texts, trimmed, words, written
from .common import utf8 as bytes_of
from .components import components

SLICE = 1 << 20
#: Cells of the sketch of counts: 4 MB a task, 4 MB to each worker.
SKETCH_BITS = 22
SKETCH = "chunk int, share int, counts binary"
PROFILE = "doc_id long, n long, k1 long, k2 long, counts binary, prefix array<long>"
#: Buckets of the counts that bound an intersection, and the most that one counts to.
BUCKETS, MOST = 64, (1 << 16) - 1
_LOW = (1 << 43) - 1


def shingle_sets(part: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles, as sorted 64-bit hashes; with fewer words, their sequence as one."""
    hashed, _, _, first = words(*bytes_of(part.column(1)))
    shingles = grams(hashed, k)
    for i, j in zip(first[:-1], first[1:], strict=True):
        if j - i >= k:
            yield np.unique(shingles[i : j - k + 1])
        elif j > i:
            own = np.full(1, j - i, np.uint64)
            for h in hashed[i:j]:
                own = mix(own * np.uint64(31) + h)
            yield own
        else:
            yield np.zeros(0, np.uint64)


def count_levels(rows: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of each cell of the sketch are, on a scale of half powers of two; over all documents."""
    cells, chunk = 1 << SKETCH_BITS, 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tools()
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                np.add.at(counts, (grams(words(*bytes_of(part.column(1)))[0], k) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if counts.any():  # of one task, 255 is as common as any
            n = cells // chunk
            yield arrow(SKETCH, (np.arange(n, dtype=np.int32), np.full(n, TaskContext.get().partitionId() % 64, np.int32), [c.tobytes() for c in np.minimum(counts, 255).astype(np.uint8).reshape(-1, chunk)]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, counts in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                totals.setdefault(c, np.zeros(chunk, np.uint32))[:] += np.frombuffer(counts.as_buffer(), np.uint8 if len(counts.as_buffer()) == chunk else np.uint32)
        if totals:
            yield arrow(SKETCH, (np.array([*totals], np.int32), np.zeros(len(totals), np.int32), [t.tobytes() for t in totals.values()]))

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in add(batches):
            totals = (np.frombuffer(counts.as_buffer(), np.uint32).astype(np.float64) for counts in batch.column(2))
            yield arrow(SKETCH, (batch.column(0), batch.column(1), [(2 * np.log2(total + 1)).astype(np.uint8).tobytes() for total in totals]))

    # sums of the tasks' sketches stream by in two levels: by chunk and a share of the tasks, then by chunk
    sums = rows.mapInArrow(trimmed(run), SKETCH).repartition("chunk", "share").mapInArrow(trimmed(add), SKETCH).repartition("chunk").mapInArrow(trimmed(level), SKETCH)
    out = np.zeros(cells, np.uint8)
    for row in sums.collect():  # 4 MB, whatever the corpus: levels, not counts
        out[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = np.frombuffer(row["counts"], np.uint8)
    return out


def _needed(a, b, percent: int):
    """The least intersection of sets of sizes a and b that link, for columns."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def profiles(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, counts, prefix): size, sums that stand for the set, its counts by bucket, and its rarest shingles."""
    levels = count_levels(rows, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                n, k1, k2, counts, prefix = [], [], [], [], []
                for own in shingle_sets(part, k):
                    size = len(own)
                    n.append(size)
                    k1.append(int(own.sum(dtype=np.uint64).view(np.int64)) if size else 0)
                    k2.append(int(mix(own ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if size else 0)
                    counts.append(np.minimum(np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=BUCKETS), MOST).astype(np.uint16).tobytes())
                    keep = size - -(-size * percent // 100) + 1 if size else 0
                    order = np.argsort(levels[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:keep]
                    prefix.append(own[order].view(np.int64))
                lengths = np.cumsum([0, *map(len, prefix)])
                flat = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
                yield arrow(PROFILE, (part.column(0), n, k1, k2, counts, pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)))

    return rows.mapInArrow(trimmed(run), PROFILE)


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose counts by bucket allow an intersection that links; the others can't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS).astype(np.int64) for i in (2, 3))
            least = np.where((x == MOST) & (y == MOST), 1 << 40, np.minimum(x, y)).sum(1)
            sizes = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            fits = pa.array(least * (100 + percent) >= sizes * percent)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fits), batch.column(1).filter(fits)], ["a", "b"])

    one, two = (classes.select(F.col("rep").alias(v), F.col("counts").alias(f"counts_{v}"), F.col("n").alias(f"n_{v}")) for v in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "counts_a", "counts_b", "n_a", "n_b").mapInArrow(trimmed(run), "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets link. Sets are made anew for the documents that occur, found by a Bloom filter."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = bloom(ids, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(wanted, batch.column(0).to_numpy(zero_copy_only=False))))
            for part in sliced(batch, 1, SLICE):
                yield arrow("id long, own binary", (part.column(0), [s.tobytes() for s in shingle_sets(part, k)]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, links = batch.column(0), batch.column(1), []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                links.append(100 * same >= percent * (len(x) + len(y) - same))
            links = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(links), b.filter(links)], ["a", "b"])

    made = written(rows.mapInArrow(trimmed(sets), "id long, own binary"), "sets")
    found = made.dropDuplicates(["id"])
    left = found.select(F.col("id").alias("a"), F.col("own").alias("x"))
    right = found.select(F.col("id").alias("b"), F.col("own").alias("y"))
    links = written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(trimmed(compare), "a long, b long"), "links")
    discard(made)
    return links


def jaccard_components(docs: DataFrame, *, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a row of ``docs``.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. A set holds the distinct shingles of ``k`` words; with
    fewer words the whole sequence is the one shingle; without words, or with a null text, it is empty and links with
    nothing. Two documents link when 100 * intersection >= percent * union. ``component_id`` is the least id reachable.
    Shingles count as equal by 64-bit hashes. Rows of one id must be repeats of one document; null ids link with
    nothing and have a null component.
    """
    rows = texts(docs, id_col, text_col)
    profile = written(profiles(rows, k, percent), "profiles")
    rows = rows.where("doc_id is not null")
    set_key = ["n", "k1", "k2"]
    classes = written(profile.where("n > 0 and doc_id is not null").groupBy(*set_key).agg(F.min(F.struct("doc_id", "counts", "prefix")).alias("s")).select(*set_key, F.col("s.doc_id").alias("rep"), "s.counts", "s.prefix"), "classes")
    grouped = classes.select("rep", "n", "prefix", F.xxhash64("n", "prefix").alias("g"))
    members = grouped.select("rep", "n", "g")
    groups = grouped.groupBy("g").agg(F.min(F.struct("rep", "n", "prefix")).alias("s"), F.count("*").alias("size")).select("g", "s.*", "size")
    groups = written(groups.withColumn("tag", F.xxhash64("rep").bitwiseAND(F.lit(_LOW))), "groups")

    # a shingle's pivot, as one long: position, then a tag of the group
    places = groups.select("g", "tag", F.posexplode("prefix").alias("pos", "h"))
    packed = F.shiftleft(F.least(F.col("pos"), F.lit((1 << 20) - 1)).cast("long"), 43).bitwiseOR(F.col("tag"))
    shared = written(places.groupBy("h").agg(F.min(packed).alias("pivot"), F.count("*").alias("groups")).where("groups > 1").select("h", "pivot"), "shared-shingles")
    filter_ = bloom(shared, "h")

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            at = np.asarray(column.offsets)
            values = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            lengths = np.diff(at)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            pos = np.arange(len(values)) - np.repeat(at[:-1] - at[0], lengths)
            keep = np.flatnonzero(may_hold(filter_, values))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), batch.column(1).take(pa.array(row[keep])), pa.array(pos[keep], pa.int32()), pa.array(values[keep])], ["g", "n", "pos", "h"])

    entries = written(groups.select("g", "n", "prefix").mapInArrow(trimmed(shared_only), "g long, n long, pos int, h long").join(shared, "h"), "entries")

    # the first round
    met = entries.groupBy("g", "n", F.col("pivot").bitwiseAND(F.lit(_LOW)).alias("tag")).agg(F.min("pos").alias("pos"), F.min(F.shiftright("pivot", 43)).alias("pivot_pos"))
    pivots = groups.select("tag", F.col("g").alias("pg"), F.col("n").alias("pn"), F.col("rep").alias("pivot"))
    fits = lambda n, m: (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    group_pairs = met.join(pivots, "tag").where((F.col("g") != F.col("pg")) & fits(F.col("n"), F.col("pn")) & (F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("pivot_pos")) >= _needed(F.col("n"), F.col("pn"), percent))).select("g", "pivot")
    inside = groups.where("size > 1").select("g", F.col("rep").alias("pivot"))
    first = group_pairs.unionByName(inside).join(members.select("g", "rep"), "g").where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    first = written(_possible(first, classes, percent), "pairs")
    links = _verified(first, rows, k, percent)
    reached = components(links)

    # the second round: members that share a shingle and are not yet together; those of one group share all of its prefix
    part = members.join(reached, members["rep"] == reached["id"], "left").select("rep", "n", "g", F.coalesce("component_id", "rep").alias("c"))
    parts = written(part.groupBy("g", "n", "c").agg(F.count("*").alias("size")), "parts")
    spread = entries.select("g", "pos", "h").join(parts, "g")
    mixed = spread.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("h")
    spread = written(spread.join(mixed, "h").select("h", "pos", "g", "n", "c"), "spread")
    x, y = (spread.select("h", *[F.col(c).alias(f"{c}{i}") for c in ("pos", "g", "n", "c")]) for i in (1, 2))
    near = x.join(y, "h").where((F.col("c1") < F.col("c2")) & (F.col("g1") != F.col("g2")) & fits(F.col("n1"), F.col("n2")) & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= _needed(F.col("n1"), F.col("n2"), percent))).select("g1", "c1", "g2", "c2").distinct()
    own = parts.select(F.col("g").alias("g1"), F.col("c").alias("c1")).join(parts.select(F.col("g").alias("g2"), F.col("c").alias("c2")), (F.col("g1") == F.col("g2")) & (F.col("c1") < F.col("c2")))
    near = near.unionByName(own)
    one, two = (part.select(F.col("rep").alias(v), F.col("g").alias(f"g{i}"), F.col("c").alias(f"c{i}")) for i, v in ((1, "p"), (2, "q")))
    second = near.join(one, ["g1", "c1"]).join(two, ["g2", "c2"]).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    second = written(_possible(second, classes, percent).join(first, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        links = links.unionByName(_verified(second, rows, k, percent))
        reached = components(links)

    of_class = classes.join(reached, classes["rep"] == reached["id"], "left").select(*set_key, F.coalesce("component_id", "rep").alias("c"))
    return profile.select("doc_id", *set_key).join(of_class, set_key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
