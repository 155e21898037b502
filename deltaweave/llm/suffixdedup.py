"""Repeated passages by sparse suffix arrays.

Of every window of ``least`` words the k-gram of least hash, its minimiser, marks a position; equal passages have
equal marks, so only suffixes at marks are kept. Marks whose k-gram occurs once are dropped (their hashes are counted,
combined before the shuffle). The others carry, as hashes of words, what follows and what precedes; they are sorted by
k-gram and following words, and again by k-gram and preceding words, dealt out by ranges so that a passage that a third
of all documents share lies over many tasks. Neighbours are compared: matches are extended to the right and to the
left, and where they are ``least`` words or longer, the later occurrence is a repeat of the earlier.

Rows of one k-gram that may not all have met (more than the window, or at the border of a batch) are settled exactly:
for each split of the words that a k-gram lacks into some before and the rest behind, a hash of the k-gram and those words
is a key, and what isn't the first occurrence of its key is a repeat. Rows that share all they have with an earlier one
are left out there, as that one stands for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import bloom, may_hold
from .common import arrow, discard, free_tools, grams, local_rows, mix, shuffle_partitions, sliced, small_range_sample, texts, trimmed, words, written
from .common import utf8 as bytes_of

SLICE = 1 << 20
#: So many rows on are compared as well in either order.
NEIGHBOURS = 4
#: Ids, of 8 bytes, that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
MARK = "h long, doc_id long, at int, after binary, before binary"
#: What a task says: a span to drop and the document it repeats (kind 0), rows at its borders (kinds 1 to 4), or a row to settle by keys (kind 5).
FOUND = "kind int, part int, h long, doc_id long, at int, after binary, before binary, start int, stop int, other long"
KEYS = "key long, doc_id long, at int, left int"
SPANS = "doc_id long, starts array<int>, stops array<int>, others array<long>"


def minimisers(g: np.ndarray, first: np.ndarray, n_words: int, k: int, least: int) -> np.ndarray:
    """Positions, ascending, of the k-grams ``g`` that are least in some window of ``least`` words of one text.

    A gram's high bits and its position are one number, so the least of a window says where it is; spans double.
    """
    width = least - k + 1
    if len(g) < width:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(len(g)).bit_length()))
    low, span = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64), 1
    whole = np.repeat(first[1:], np.diff(first)) - np.arange(n_words) >= least  # windows that lie in one text
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    m = len(g) - width + 1
    low = np.minimum(low[:m], low[width - span : width - span + m])
    return np.unique(low[whole[:m]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _marks(part: pa.RecordBatch, k: int, least: int) -> tuple:
    """Word hashes, first words of the texts, marks, the texts they are in, and their k-grams."""
    hashed, _, _, first = words(*bytes_of(part.column(1)))
    g = grams(hashed, k)
    at = minimisers(g, first, len(hashed), k, least)
    return hashed, first, at, np.searchsorted(first, at, "right") - 1, g[at].view(np.int64)


def _context(hashed: np.ndarray, first: np.ndarray, at: np.ndarray, doc: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the ``reach`` words after each k-gram and before it, nearest first; 0 beyond the text."""
    short = np.concatenate([np.maximum((hashed >> np.uint64(32)).astype(np.uint32), np.uint32(1)), np.zeros(1, np.uint32)])
    steps = np.arange(reach)
    after, before = (at + k)[:, None] + steps, (at - 1)[:, None] - steps
    after = np.where(after < first[doc + 1][:, None], after, len(hashed))
    before = np.where(before >= first[doc][:, None], before, len(hashed))
    return short[after], short[before]


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words two rows of contexts share from the near end on."""
    differ = (x != y) | (x == 0)
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


class _Rows:
    """Marks in their order, as arrays."""

    def __init__(self, h, doc, at, after, before):
        self.h, self.doc, self.at, self.after, self.before = h, doc, at, after, before

    @classmethod
    def of(cls, batch: pa.RecordBatch, reach: int) -> _Rows:
        numbers = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("h", "doc_id", "at"))
        return cls(*numbers, *(np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint32).reshape(-1, reach) for n in ("after", "before")))

    def pick(self, rows) -> _Rows:
        return _Rows(*(v[rows] for v in vars(self).values()))

    def join(self, other: _Rows) -> _Rows:
        return _Rows(*(np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values(), strict=True)))

    def __len__(self) -> int:
        return len(self.h)


def _match(x: _Rows, y: _Rows, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row: whether they share ``least`` words or more around their k-gram, and how many words right and left."""
    right, left = _same(x.after, y.after) + k, _same(x.before, y.before)
    return (x.h == y.h) & (right + left >= least), right, left


def _later(x: _Rows, y: _Rows) -> np.ndarray:
    return (x.doc > y.doc) | ((x.doc == y.doc) & (x.at > y.at))


def _spans(ok: np.ndarray, x: _Rows, y: _Rows, right: np.ndarray, left: np.ndarray) -> Iterator[tuple]:
    """(document, start, stop, the other document) of the later of each matching pair."""
    for which, of, other in ((ok & _later(x, y), x, y), (ok & _later(y, x), y, x)):
        i = np.flatnonzero(which)
        if len(i):
            yield of.doc[i], of.at[i] - left[i], of.at[i] + right[i], other.doc[i]


def _all_of(x: _Rows, y: _Rows) -> np.ndarray:
    """Whether the earlier y has all the words that x has around the same k-gram, so that it stands for x in any window."""
    held = [((a == b) | (a == 0)).all(1) for a, b in ((x.after, y.after), (x.before, y.before))]
    return (x.h == y.h) & held[0] & held[1] & _later(x, y)


def _compare(rows: _Rows, k: int, least: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Spans to drop, for each row the earliest row of its run of matching neighbours, and the rows that another stands for."""
    x, y = rows.pick(slice(1, None)), rows.pick(slice(0, -1))
    ok, right, left = _match(x, y, k, least)
    run = np.concatenate([[0], np.cumsum(~ok)])
    order = np.lexsort((rows.at, rows.doc, run))
    best = order[np.concatenate([[True], run[order][1:] != run[order][:-1]])][run]
    spans = list(_spans(ok, x, y, right, left))
    top = rows.pick(best)
    ok, right, left = _match(rows, top, k, least)
    spans += _spans(ok, rows, top, right, left)
    stood = _all_of(rows, top)
    stood[1:] |= _all_of(rows.pick(slice(1, None)), rows.pick(slice(0, -1)))
    for away in range(2, NEIGHBOURS + 1):  # one that shares more on one side may stand between two that share more in all
        x, y = rows.pick(slice(away, None)), rows.pick(slice(0, -away))
        spans += _spans(*(m := _match(x, y, k, least))[:1], x, y, *m[1:])
    return spans, best, stood


def _unmet(h: np.ndarray) -> np.ndarray:
    """The rows of a batch whose k-gram has more rows than the window, or may go on in another batch."""
    begins = np.concatenate([[True], h[1:] != h[:-1]])
    sizes = np.diff(np.append(np.flatnonzero(begins), len(h)))
    return (sizes > NEIGHBOURS + 1)[np.cumsum(begins) - 1] | (h == h[0]) | (h == h[-1])


def _keys(rows: _Rows, reach: int) -> Iterator[tuple]:
    """(key, document, at, words on the left) of each window around the k-grams that lies in its text."""
    behind, ahead = [rows.h.view(np.uint64)], [np.zeros(len(rows), np.uint64)]
    for i in range(reach):
        behind.append(mix(behind[-1] * np.uint64(31) + rows.after[:, i]))
        ahead.append(mix(ahead[-1] * np.uint64(31) + rows.before[:, i] + np.uint64(1)))
    for left in range(reach + 1):
        own = np.ones(len(rows), bool)
        if left:
            own &= rows.before[:, left - 1] != 0
        if left < reach:
            own &= rows.after[:, reach - left - 1] != 0
        i = np.flatnonzero(own)
        key = mix(behind[reach - left][i] ^ mix(ahead[left][i] + np.uint64(left)))
        yield key.view(np.int64), rows.doc[i], rows.at[i].astype(np.int32), np.full(len(i), left, np.int32)


def _settled(rows: DataFrame, k: int, least: int) -> DataFrame:
    """Spans of those rows that aren't the first occurrence of a window of ``least`` words, and the document of the first."""

    rows = rows.select("h", "doc_id", "at", "after", "before")

    def keys(seen: np.ndarray | None) -> DataFrame:
        """All keys, or those that may be in the filter ``seen``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for columns in _keys(_Rows.of(batch, least - k), least - k) if batch.num_rows else ():
                    own = slice(None) if seen is None else may_hold(seen, columns[0])
                    yield arrow(KEYS, [c[own] for c in columns])

        return rows.mapInArrow(trimmed(run), KEYS)

    first = written(keys(None).groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"), "firsts")
    later = F.struct("doc_id", "at") > F.col("first")
    return keys(bloom(first, "key")).join(first, "key").where(later).select("doc_id", (F.col("at") - F.col("left")).alias("start"), (F.col("at") - F.col("left") + least).alias("stop"), F.col("first.doc_id").alias("other"))


def _scan(batches: Iterator[pa.RecordBatch], k: int, least: int, settle: bool) -> Iterator[pa.RecordBatch]:
    """Compares the rows of one task, a batch at a time; before a batch stand the last row so far and its run's earliest.

    At the borders: the first row (kind 1), the last (2), the earliest of the first row's run (3) and of the last's (4).
    With ``settle``, rows that may not have met all others of their k-gram (kind 5).
    """
    part, carry = TaskContext.get().partitionId(), None

    def say(kind: int, rows: _Rows) -> pa.RecordBatch:
        n = len(rows)
        return arrow(FOUND, ([kind] * n, [part] * n, rows.h, rows.doc, rows.at.astype(np.int32), [a.tobytes() for a in rows.after], [b.tobytes() for b in rows.before], [0] * n, [0] * n, [0] * n))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = _Rows.of(batch, least - k)
        begins = carry is None
        if not begins:
            rows = carry.join(rows)
        spans, best, stood = _compare(rows, k, least)
        for doc, start, stop, other in spans:
            n = len(doc)
            yield arrow(FOUND, ([0] * n, [part] * n, [0] * n, doc, [0] * n, [b""] * n, [b""] * n, start.astype(np.int32), stop.astype(np.int32), other))
        if begins:
            yield say(1, rows.pick([0]))
            yield say(3, rows.pick([best[0]]))
        if settle:
            fresh = rows.pick(slice(0 if begins else 2, None))
            yield say(5, fresh.pick(_unmet(fresh.h) & ~stood[0 if begins else 2 :]))
        carry = rows.pick([best[-1], len(rows) - 1])
    if carry is not None:
        yield say(2, carry.pick([1]))
        yield say(4, carry.pick([0]))


def _borders(rows: list, k: int, least: int) -> list[tuple]:
    """Spans that only rows at the borders of neighbouring tasks show; four rows a task."""
    by: dict[int, dict[int, _Rows]] = {}
    for r in rows:
        context = [np.frombuffer(r[n], np.uint32).reshape(1, least - k) for n in ("after", "before")]
        by.setdefault(r["part"], {})[r["kind"]] = _Rows(*(np.array([r[n]], np.int64) for n in ("h", "doc_id", "at")), *context)
    out: list[tuple] = []
    before: list[_Rows] = []
    for _, own in sorted(by.items()):
        for x in (own[1], own[3]):
            for y in before:
                ok, right, left = _match(x, y, k, least)
                out += [tuple(int(v[0]) for v in s) for s in _spans(ok, x, y, right, left)]
        going_on = [y for y in before if _match(own[2], y, k, least)[0][0]][-1:]  # a run over more than two tasks
        before = [*going_on, own[4], own[2]]
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's spans, sorted by start, as spans that don't touch; on arrays, as a batch may hold millions of spans."""
    for batch in batches:
        lists = batch.column(1)
        start, stop = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        ahead = np.maximum.accumulate(stop + (doc << 32))  # the farthest stop so far; no document reaches into the next one
        first = np.ones(len(start), bool)
        first[1:] = (start + (doc << 32))[1:] > ahead[:-1]
        last = np.append(first[1:], True)[: len(first)]
        at = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(lists)))]).astype(np.int32)
        starts, stops = start[first].astype(np.int32), (ahead[last] & 0xFFFFFFFF).astype(np.int32)
        yield arrow(SPANS, (batch.column(0), *(pa.ListArray.from_arrays(at, x) for x in (starts, stops)), batch.column(2)))


def repeated_spans(docs: DataFrame, *, least: int = 50, k: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, starts, stops, others): the words, counted from 0, that repeat an earlier passage of ``least`` words or more.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. Earlier: in a document of smaller id, or before in the same
    one. Spans are merged; ``others``: documents they repeat. Documents without repeats have no row. An id stands for
    one document: repeated rows are no repeats of each other; rows without id or text have none. Words match by
    hashes: k-grams of 64 bits, words around them of 32.
    """
    rows = texts(docs, id_col, text_col).where("doc_id is not null")
    n, reach = shuffle_partitions(docs.sparkSession), least - k

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tools()
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                yield arrow("h long", (_marks(part, k, least)[4],))

    seen = bloom(rows.mapInArrow(trimmed(hashes), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                hashed, first, at, doc, h = _marks(part, k, least)
                keep = np.flatnonzero(may_hold(seen, h))
                for i in range(0, len(keep), 20_000):
                    own = keep[i : i + 20_000]
                    after, before = _context(hashed, first, at[own], doc[own], k, reach)
                    yield arrow(MARK, (h[own], part.column(0).take(pa.array(doc[own])), (at[own] - first[doc[own]]).astype(np.int32), [a.tobytes() for a in after], [b.tobytes() for b in before]))

    kept = written(rows.mapInArrow(trimmed(marks), MARK), "marks")
    found = []
    for near, far in (("after", "before"), ("before", "after")):
        order = ["h", near, far, "doc_id", "at"]
        dealt = kept.repartitionByRange(n, *order).sortWithinPartitions(*order)
        with small_range_sample(docs.sparkSession, n, 8 * reach + 80):  # two contexts of 4 bytes a word, numbers and lengths
            said = written(dealt.mapInArrow(trimmed(lambda batches, settle=near == "after": _scan(batches, k, least, settle)), FOUND), "spans")
        found.append(said.where("kind = 0").select("doc_id", "start", "stop", "other"))
        if near == "after":
            found.append(_settled(said.where("kind = 5"), k, least))
        borders = _borders(said.where("kind between 1 and 4").collect(), k, least)
        if borders:
            found.append(local_rows(docs.sparkSession, borders, "doc_id long, start int, stop int, other long"))
    discard(kept)
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = spans.groupBy("doc_id", "start", "stop").agg(F.min("other").alias("other"))
    spans = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.sort_array(F.collect_set("other")).alias("others"))
    return spans.mapInArrow(trimmed(_merged), SPANS)


def drop_repeats(docs: DataFrame, *, least: int = 50, k: int = 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, the words of ``repeated_spans`` cut out of their texts with the white space behind them.

    Other columns pass through; texts without repeats stay as they are.
    """
    spans = written(repeated_spans(docs, least=least, k=k, id_col=id_col, text_col=text_col), "repeats").select(F.col("doc_id").alias("__id"), F.col("starts").alias("__starts"), F.col("stops").alias("__stops"))
    ids = spans.select("__id")
    if ids.count() <= BROADCAST_IDS:  # only texts that are cut are shuffled to their spans
        ids = F.broadcast(ids)

    names = docs.columns
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, a, b in zip(batch.column(text_col), batch.column("__starts").to_pylist(), batch.column("__stops").to_pylist(), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                _, begin, _, _ = words(data, np.array([0, len(data)]))
                begin = np.append(begin, len(data))
                parts, at = [], 0
                for i, j in zip(a, b, strict=True):
                    parts.append(data[at : begin[i]].tobytes())
                    at = begin[j]
                out.append(b"".join([*parts, data[at:].tobytes()]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text_col else batch.column(n) for n in names], names)

    own = F.col(f"`{id_col}`").cast("long") == F.col("__id")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    touched = docs.join(ids, own, "left_semi").join(spans, own).withColumn(text_col, text)
    return docs.join(ids, own, "left_anti").unionByName(touched.mapInArrow(trimmed(cut), schema))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    spans = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    dropped = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return spans.select("doc_id", F.size("starts").cast("long").alias("n_spans"), dropped.alias("n_words_dropped"), "starts", "stops", F.col("others").alias("repeats_doc_ids"))
