"""Toxicity by a subsequence string kernel and a support vector machine with Nystroem landmarks.

The kernel counts shared subsequences of three symbols, each weighted by a decay to the power of its span, so that
inserted characters and gaps cost a little and don't hide a word; spans are bounded. Landmarks are words that labelled
sentences suggest; kernel values to them, whitened, are the features of a word, and a squared-hinge machine learns from
the worst word of each toxic text against words of clean texts (multiple instances). The learned function is a weighted
sum over subsequences, so a word is scored by looking its own up in one table. A text's score is that of its worst
word, calibrated; letters spelt out one by one are read as a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, hash_sample, sliced, texts, trimmed, words
from .common import utf8 as bytes_of

#: Labelled texts that the machine is fitted on, about; chosen by the hash of their id.
SAMPLE = 5000
LANDMARKS = 96
NEGATIVES = 30_000
ROUNDS = 4
DECAY, SPAN, LONGEST = 0.6, 8, 24
SLICE = 1 << 20
KNOWN = 2_000_000


def _symbols() -> np.ndarray:
    """Byte -> symbol below 64; 0: none. Case is folded; digits and signs that often stand for letters are those letters."""
    out = np.zeros(256, np.int32)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1):
        out[ord(c)] = out[ord(c.upper())] = i
    for sign, letter in zip("0134578@$!", "oieastbasi", strict=True):
        out[ord(sign)] = out[ord(letter)]
    for b in range(128, 256):
        out[b] = 27 + b % 37
    return out


SYMBOLS = _symbols()


def matrix(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of symbols, and their lengths: signs at the ends are left out, those within stay as gaps."""
    solid = np.concatenate([[0], np.flatnonzero(SYMBOLS[data] > 0) + 1, [len(data) + 1]])
    begin = np.minimum(solid[np.searchsorted(solid, begin + 1)] - 1, end)
    end = np.maximum(solid[np.searchsorted(solid, end, "right") - 1], begin)
    length = np.minimum(end - begin, LONGEST)
    if len(data) == 0:
        return np.zeros((len(begin), LONGEST), np.int32), length
    at = np.minimum(begin[:, None] + np.arange(LONGEST), len(data) - 1)
    return np.where(np.arange(LONGEST) < length[:, None], SYMBOLS[data[at]], 0), length


#: A word's normaliser by its length: the root of the sum of its squared weights.
_NORM = np.sqrt(np.maximum([sum(DECAY ** (2 * (k - i + 1)) * (k - i - 1) for i in range(n) for k in range(i + 2, min(n, i + SPAN))) for n in range(LONGEST + 1)], DECAY**6))


def weigh(rows: np.ndarray, length: np.ndarray, table: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """Of each word, the decayed sum of the table's values at its subsequences, normalised.

    table: 64^3 rows (x columns), or fewer, then ``place`` has the row of each subsequence.
    """
    order = np.argsort(-length, kind="stable")
    rows, upto = rows[order], -length[order]
    out = np.zeros((len(rows), *table.shape[1:]), np.float32)
    for i in range(LONGEST - 2):
        for k in range(i + 2, min(LONGEST, i + SPAN)):
            n = int(np.searchsorted(upto, -k, "left"))  # words that are longer than k
            if not n:
                continue
            ends = rows[:n, i] * 4096 + rows[:n, k]
            solid = (rows[:n, i] > 0) & (rows[:n, k] > 0)
            for j in range(i + 1, k):
                own = solid & (rows[:n, j] > 0)
                code = ends + rows[:n, j] * 64
                value = table[code if place is None else place[code]] * np.float32(DECAY ** (k - i + 1))
                out[:n] += value * (own if value.ndim == 1 else own[:, None])
    out /= _NORM[np.maximum(-upto, 0)].reshape(-1, *[1] * (out.ndim - 1)).astype(np.float32)
    back = np.empty_like(out)
    back[order] = out
    return back


def _own_tables(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column z: the subsequences of word z with their weights, so that ``weigh`` with it is the kernel to that word.

    Only subsequences that occur have a row; the second array has its number, or that of row 0, which is empty.
    """
    place, found, rows_used = np.zeros(64**3, np.int32), [], 0
    for z, (row, n) in enumerate(zip(rows, length, strict=True)):
        for i in range(n):
            for k in range(i + 2, min(n, i + SPAN)):
                for j in range(i + 1, k):
                    if row[i] and row[j] and row[k]:
                        code = row[i] * 4096 + row[j] * 64 + row[k]
                        if not place[code]:
                            rows_used += 1
                            place[code] = rows_used
                        found.append((place[code], z, DECAY ** (k - i + 1) / _NORM[n]))
    table = np.zeros((rows_used + 1, len(rows)), np.float32)
    for at, z, weight in found:
        table[at, z] += weight
    return table, place


def _packed(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [w.encode("utf-8", "replace") for w in found]
    at = np.cumsum([0, *map(len, data)])
    return matrix(np.frombuffer(b"".join(data), np.uint8), at[:-1], at[1:])


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * worst + offset))), worst: the largest weighted sum of a text's words."""

    table: np.ndarray
    slope: float
    offset: float

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30)))


def _bent(word: str, rng: np.random.Generator) -> str:
    """The word with a sign or letter put in, as one that hides it would be."""
    i = int(rng.integers(1, max(2, len(word))))
    return word[:i] + "-*._xj"[int(rng.integers(6))] + word[i:]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps; the last feature is the constant."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    v = np.zeros(x1.shape[1])
    penalty = np.full(len(v), ridge)
    penalty[-1] = 1e-9
    for _ in range(30):
        active = y * (x1 @ v) < 1
        xa, wa = x1[active], weight[active]
        new = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(penalty), (xa * wa[:, None]).T @ y[active])
        if np.abs(new - v).max() < 1e-6:
            break
        v = new
    return v[:-1], float(v[-1])


def train(rows: list[tuple[str | None, int]], seed: int = 5) -> Model:
    """rows: (text, label). Without both labels every text scores the share of label 1, or 0."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    bags: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for text, label in rows:
        if own := {number.setdefault(w, len(number)) for w in (text or "").lower().split()}:
            bags[1 if label == 1 else 0].append(np.fromiter(own, np.int64))
    del rows
    vocabulary = list(number)
    del number
    toxic, clean = bags[1], bags[0]
    if not toxic or not clean:
        return Model(np.zeros(64**3, np.float32), 1.0, -20.0 if not toxic else 0.1)
    a, b = (np.bincount(np.concatenate(side), minlength=len(vocabulary)) for side in (toxic, clean))
    long_enough = np.array([len(w) > 2 for w in vocabulary])
    # log odds of a word, less their standard error: what few occurrences suggest counts for little
    odds = np.log((a + 0.5) / (len(toxic) + 1)) - np.log((b + 0.5) / (len(clean) + 1)) - np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    gain = np.where(long_enough, a * np.maximum(odds, 0), 0)
    landmarks = np.argsort(-gain, kind="stable")[:LANDMARKS]
    packed = lambda found: _packed([vocabulary[i] for i in found])
    tables, at = _own_tables(*packed(landmarks))
    gram = weigh(*packed(landmarks), tables, at).astype(float)
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-4 * values.max()
    whiten = axes[:, keep] / np.sqrt(values[keep])  # Nystroem: features whose inner products are the kernel

    def features(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
        parts = [weigh(rows[i : i + 4000], length[i : i + 4000], tables, at).astype(float) @ whiten for i in range(0, len(rows), 4000)]
        return np.concatenate(parts) if parts else np.zeros((0, keep.sum()))

    plain = np.flatnonzero((b > 0) & long_enough)
    rows_, length = packed(plain)
    near = weigh(rows_, length, tables[:, : min(40, len(landmarks))].sum(1), at)
    chosen = np.zeros(len(plain), bool)
    chosen[np.argsort(-near, kind="stable")[: NEGATIVES // 2]] = True
    chosen[rng.choice(len(plain), min(len(plain), NEGATIVES // 4), replace=False)] = True
    no = features(rows_[chosen], length[chosen])
    candidates = np.unique(np.concatenate(toxic))
    candidates = candidates[(odds[candidates] > 0) & long_enough[candidates]]
    if not len(candidates):
        return Model(np.zeros(64**3, np.float32), 1.0, -0.1)
    place = np.full(len(vocabulary), -1)
    place[candidates] = np.arange(len(candidates))
    of = features(*packed(candidates))
    witness = [own[gain[own].argmax()] for own in toxic]
    surely = [w for w in landmarks if a[w] > 50 * b[w]]  # so that an insult that always comes with a worse one is learned too
    v = np.zeros(keep.sum())
    for _ in range(ROUNDS):
        found = [w for w in witness if place[w] >= 0] + 4 * surely
        if not found:
            break
        yes = np.concatenate([of[place[found]], features(*_packed([_bent(vocabulary[w], rng) for w in found]))])
        y = np.concatenate([np.ones(len(yes)), -np.ones(len(no))])
        weight = np.concatenate([np.full(len(found), 1 / len(found)), np.full(len(found), 0.3 / len(found)), np.full(len(no), 10 / len(no))])
        v, base = _svm(np.vstack([yes, no]), y, weight)
        value = np.append(of @ v, -9.0)
        witness = [own[value[place[own]].argmax()] for own in toxic]
        wrong = weigh(rows_, length, tables @ (whiten @ v).astype(np.float32), at) + base > -0.5
        fresh = wrong & ~chosen  # clean words too near the border join the examples
        chosen |= fresh
        no = np.concatenate([no, features(rows_[fresh], length[fresh])])
    table = (tables @ (whiten @ v).astype(np.float32))[at]
    everything = np.concatenate([weigh(*_packed(vocabulary[i : i + 50_000]), table) for i in range(0, len(vocabulary), 50_000)])

    def worst(side: list[np.ndarray]) -> np.ndarray:
        return np.array([everything[own].max() for own in side])

    x = np.concatenate([worst(toxic), worst(clean)])
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    scale = max(float(x.std()), 1e-6)
    slope, offset = 4.0, -4.0 * float((np.median(x[y == 1]) + np.median(x[y == 0])) / 2 / scale)
    for _ in range(2000):  # calibration, with a prior that keeps the slope finite
        p = 1 / (1 + np.exp(-np.clip(slope * x / scale + offset, -30, 30)))
        slope -= 0.5 * (float(((p - y) * x / scale).mean()) + 1e-4 * slope)
        offset -= 0.5 * float((p - y).mean())
    return Model(table, slope / scale, offset)


def _spelt(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> list[tuple[int, bytes]]:
    """(text, letters) of runs of three or more words of one letter."""
    single = np.concatenate([[0], (end - begin == 1) & (SYMBOLS[data[begin]] > 0), [0]]).astype(np.int8)
    step = np.diff(single)
    out = []
    for i, j in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
        while i < j:
            doc = int(np.searchsorted(first, i, "right")) - 1
            stop = min(j, int(first[doc + 1]))
            if stop - i >= 3:
                letters = data[begin[i:stop]].tobytes()
                out += [(doc, letters[a : a + LONGEST]) for a in range(0, max(1, len(letters) - LONGEST // 2), LONGEST // 2)]
            i = stop
    return out


class _Scorer:
    """Worst words of texts; words seen before are looked up by their hash in a table of bounded size."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def _value(self, data: np.ndarray, hashed: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        unique, at, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        new = self.hashes[place] != unique if len(self.hashes) else np.ones(len(unique), bool)
        out = np.zeros(len(unique), np.float32)
        out[~new] = self.values[place[~new]] if len(self.hashes) else 0
        fresh = at[new]
        out[new] = np.concatenate([weigh(*matrix(data, begin[f], end[f]), self.table) for f in np.array_split(fresh, len(fresh) // 50_000 + 1)]) if len(fresh) else 0
        long = np.flatnonzero(end[at] - begin[at] > LONGEST)  # longer words: windows that overlap by half
        for i in long:
            starts = np.arange(begin[at[i]], end[at[i]], LONGEST // 2)
            out[i] = weigh(*matrix(data, starts, np.minimum(starts + LONGEST, end[at[i]])), self.table).max()
        if len(fresh):
            if len(self.hashes) + len(fresh) > KNOWN:
                self.hashes, self.values = unique, out.copy()
            else:
                merged = np.concatenate([self.hashes, unique[new]])
                order = np.argsort(merged, kind="stable")
                self.hashes, self.values = merged[order], np.concatenate([self.values, out[new]])[order]
        return out[inverse]

    def __call__(self, part: pa.RecordBatch) -> np.ndarray:
        data, at = bytes_of(part.column(1))
        hashed, begin, end, first = words(data, at)
        worst = np.full(part.num_rows, -1.0, np.float32)
        if len(hashed):
            value = self._value(data, hashed, begin, end)
            held = np.flatnonzero(first[1:] > first[:-1])
            worst[held] = np.maximum.reduceat(value, first[:-1][held])
            for doc, letters in _spelt(data, begin, end, first):
                row = np.frombuffer(letters, np.uint8)
                worst[doc] = max(worst[doc], weigh(*matrix(row, np.array([0]), np.array([len(row)])), self.table)[0])
        return worst


def sample(docs: DataFrame, labels: DataFrame, *, most: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """About ``most`` labelled texts, chosen by the hash of their id; null labels and ids are none."""
    chosen = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = hash_sample(chosen.dropDuplicates(["doc_id"]), "doc_id", most)
    found = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").toArrow().sort_by("doc_id")
    return list(zip(found["text"].to_pylist(), found["label"].to_pylist(), strict=True))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row a row of ``docs``; empty and null texts have the score of no evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = _Scorer(model.table)
        for batch in batches:
            for part in sliced(batch, 1, SLICE):
                yield arrow("doc_id long, score double", (part.column(0), model.score(scorer(part).astype(float))))

    return texts(docs, id_col, text_col).mapInArrow(trimmed(run), "doc_id long, score double")


def held_out(column):
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = train(sample(docs, labels, most=SAMPLE, id_col="doc_id", text_col="text", label_col="toxic"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
