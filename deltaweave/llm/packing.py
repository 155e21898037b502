"""Packing documents into sequences by cutting-stock column generation.

A document is cut at multiples of the sequence length; what remains is one piece, so a piece's ids and checksum are
known before the plan. The plan needs only the histogram of the pieces' lengths, in classes of ``GRAIN`` tokens: a
linear program over patterns (how many pieces of each class share a sequence), whose columns a knapsack dynamic
program prices until none improves it. Whole multiples of the patterns are kept; what rounding leaves, a number that
the classes bound whatever the input, is packed best-fit. Pieces are ranked in their class by counts of range
partitions, and a piece's rank says its sequence.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, local_rows, shuffle_partitions, sliced, spread, texts, trimmed, worker_tools, written
from .common import utf8 as bytes_of
from .pieces import UnitEncoder, joinable

VOCABULARY = "byte_bpe_50k.json"
#: The id that ends a document.
END = 1
#: Tokens by which lengths are classed; a power of two.
GRAIN = 4
#: Columns after which the linear program is taken as it is; it is then as right, only less tight.
COLUMNS = 3000
#: Share of sequences by which the linear program may miss its bound.
TIGHT = 5e-4
#: Bytes of texts that are encoded at a time: what a worker holds besides its tables is some hundred times that.
SLICE = 1 << 18
#: Units that each of the two generations of a worker's table holds at most, of about 36 bytes.
KEPT = 200_000
#: Units that the library gets in one text; what it holds of a text is a hundred times the text.
JOINED = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Units:
    """Units to ids by the library's tokenizer, as it stands in the file: its added tokens are found in texts, too."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token takes in what lies around it, so words can't be encoded one by one")
        if any(c.isspace() for content in added.values() for c in content):
            raise ValueError("an added token holds white space, so words can't be encoded one by one")
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.sizes = np.zeros(size, np.int64)  # bytes: a letter of the byte-level alphabet is one
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.sizes[i] = len(added[i].encode()) if i in added else len(token)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        said = [u.decode("utf-8", "replace") for u in units]
        plain = np.fromiter(map(joinable, said), bool, len(said))
        many = np.zeros(len(units), np.int64)
        rows = np.flatnonzero(plain)
        ids = np.zeros(0, np.int32)
        if len(rows):  # behind each other in one text, so many at a time: a unit ends where its bytes do
            parts = [rows[i : i + JOINED] for i in range(0, len(rows), JOINED)]
            ids = np.concatenate([np.array(self._ids(["".join(said[i] for i in own)])[0], np.int32) for own in parts])
            behind = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(units[i]) for i in rows])) + 1
            many[rows] = np.diff(behind, prepend=0)
        rest = np.flatnonzero(~plain)
        if not len(rest):
            return ids, many
        others = self._ids([said[i] for i in rest.tolist()])
        many[rest] = [len(x) for x in others]
        ids = np.concatenate([ids, *(np.array(x, np.int32) for x in others)])
        starts = np.zeros(len(units), np.int64)
        order = np.concatenate([rows, rest])
        starts[order] = np.cumsum(many[order]) - many[order]
        return ids[spread(starts, many)], many


def token_ids(path: str | None = None) -> UnitEncoder:
    """Concatenated texts to ids, as the library gives them for each whole text."""
    return worker_tools(("packing", path), lambda: UnitEncoder(_Units(path or public_tokenizers.path(VOCABULARY)), KEPT))


def pieces(docs: DataFrame, *, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut at multiples of ``length``, ids and END counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(vocabulary)
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                ids, first = encoder(*bytes_of(part.column(1)))
                n = np.diff(first) + 1  # with END
                whole = np.full(int(n.sum()), END, "<u4")
                ends = np.cumsum(n)
                own = np.ones(len(whole), bool)
                own[ends - 1] = False
                whole[own] = ids
                cut = -(-n // length)
                start = spread(np.zeros(len(n), np.int64), cut) * length
                size = np.minimum(np.repeat(n, cut) - start, length)
                begin = np.repeat(ends - n, cut) + start
                view = memoryview(whole.tobytes())
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
                yield arrow(PIECES, (part.column(0).take(pa.array(np.repeat(np.arange(len(n)), cut))), start, size, sums, np.repeat(n, cut)))

    return texts(docs, id_col, text_col).mapInArrow(trimmed(run), PIECES)


def _knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value, as counts of each size (ascending); any number of each."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            with_ = value[:k] + best[c - sizes[:k]]
            if (i := int(with_.argmax())) is not None and with_[i] > best[c] + 1e-12:
                best[c], took[c] = with_[i], i
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), counts


def _first_basis(s: np.ndarray, d: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their numbers to begin with: the largest size left and what fills it best, until one size is used up.

    No later pattern holds that size, so the patterns in this order are a triangular basis.
    """
    left, basis, x, unused = d.copy(), np.zeros((len(s), len(s))), np.zeros(len(s)), np.ones(len(s), bool)
    for j in range(len(s)):
        alive = np.flatnonzero(unused)
        large = alive[-1]
        counts = np.zeros(len(s))
        counts[large] = 1
        counts[alive] += _knapsack(s[alive].astype(float), s[alive], capacity - s[large])[1]
        held = np.flatnonzero(counts)
        out = held[(left[held] / counts[held]).argmin()]
        basis[:, j], x[j] = counts, left[out] / counts[out]
        left = np.maximum(left - x[j] * counts, 0)
        unused[out] = False
    return basis, x


def cutting_stock(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {size: pieces}) patterns that hold at least ``demand`` pieces of each size; sizes are distinct.

    Revised simplex with the inverse basis; a column is a pattern, priced by ``_knapsack``, or takes back a surplus.
    """
    if not sizes:
        return []
    order = np.argsort(sizes)
    s, d = np.asarray(sizes)[order], np.asarray(demand, float)[order]
    m = len(s)
    basis, x, cost = *_first_basis(s, d, capacity), np.ones(m)
    inverse = np.linalg.inv(basis)
    bound = s @ d / capacity
    for step in range(COLUMNS):
        price = cost @ inverse
        if price.min() < -1e-9:
            enter, c = np.zeros(m), 0.0
            enter[int(price.argmin())] = -1
        else:
            worth, enter = _knapsack(np.maximum(price, 0), s, capacity)
            c = 1.0
            if worth <= 1 + TIGHT or cost @ x <= bound * (1 + TIGHT):
                break
        way = inverse @ enter
        rising = way > 1e-9
        if not rising.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rising] = x[rising] / way[rising]
        out = int(ratio.argmin())
        by = max(ratio[out], 0.0)
        x = np.maximum(x - by * way, 0)
        x[out] = by
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        basis[:, out], cost[out] = enter, c
        if step % 500 == 499:  # against rounding
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ d, 0)
    plan, left = [], d.astype(int)
    for j in np.flatnonzero(cost > 0):
        counts = np.minimum(basis[:, j].astype(int), left)  # no more pieces than there are
        held = np.flatnonzero(counts)
        often = min([int(x[j] + 1e-9), *(left[i] // counts[i] for i in held)]) if len(held) else 0
        if often > 0:
            plan.append((int(often), {int(s[i]): int(counts[i]) for i in held}))
            left = left - often * counts
    plan += _best_fit({int(a): int(n) for a, n in zip(s, left, strict=True) if n > 0}, capacity)
    return plan


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over what rounding has left."""
    rooms: list[tuple[int, int]] = []
    bins: list[dict[int, int]] = []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            at = bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, i = rooms.pop(at)
            else:
                room, i = capacity, len(bins)
                bins.append({})
            bins[i][size] = bins[i].get(size, 0) + 1
            insort(rooms, (room - size, i))
    return [(1, b) for b in bins]


def pack(docs: DataFrame, *, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset: where each piece lies, gapless from 0, at most ``length`` a sequence.

    A null or empty text is one piece, END alone. Repeated rows are documents each. An empty table has no pieces.
    Sequences are to be padded to ``length``.
    """
    spark = docs.sparkSession
    capacity = -(-length // GRAIN)
    cut = pieces(docs, length=length, id_col=id_col, text_col=text_col, vocabulary=vocabulary)
    cut = written(cut.withColumn("class", F.expr(f"cast((length + {GRAIN - 1}) div {GRAIN} as int)")), "pieces")
    ranged = cut.repartitionByRange(shuffle_partitions(spark), "class", "doc_id", "start").sortWithinPartitions("class", "doc_id", "start")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "ranked")  # fixes which rows are in which part
    counts = ranged.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("class", "part", F.coalesce(before, F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "start")) - 1
    ranks = ranged.withColumn("local", local).join(bases, ["class", "part"]).withColumn("rank", F.col("base") + F.col("local"))

    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    full = histogram.pop(capacity, 0)
    plan = cutting_stock(list(histogram), list(histogram.values()), capacity)
    plan += [(full, {capacity: 1})] if full else []
    rows, used, first = [], {}, 0
    for often, pattern in plan:
        for size, n in pattern.items():
            rows.append((size, used.get(size, 0), n, often * n, first))
            used[size] = used.get(size, 0) + often * n
        first += often
    places = local_rows(spark, rows, "class int, from long, each long, held long, first long")  # bounded by the classes
    placed = ranks.join(F.broadcast(places), (ranks["class"] == places["class"]) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("from") + F.col("held"))).drop(places["class"])
    placed = placed.withColumn("sequence_id", F.col("first") + F.expr("(rank - `from`) div each"))
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(offset, F.lit(0))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
