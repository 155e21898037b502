"""What the operators share: the shared folder, written tables and Arrow text columns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that is unset and one machine does everything (local mode, as in tests) is a local folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="deltaweave-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so that a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/deltaweave-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, [table.written_path])
        _written.remove(table.written_path)


@contextmanager
def tracked() -> Iterator[list[str]]:
    """The paths that ``written`` makes within and ``discard`` doesn't take back, in the list at the end."""
    start, made = len(_written), []
    yield made
    made += _written[start:]
    del _written[start:]


#: Bytes of an Arrow batch that goes to a Python worker, about; Spark's own default is 64 MB.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Batches bounded in bytes, for rows of any size. A setting of the session, which changes no result; one that is set stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_tools: dict = {}


def worker_tools(key: tuple, make: Callable):
    """What ``make`` gives, once a Python worker: an operator's tools stay for its next task and go when another one's are made."""
    if key not in _tools:
        free_tools()
        _tools[key] = make()
    return _tools[key]


def free_tools() -> None:
    """Gives back what other operators have left in this Python worker."""
    if _tools:
        _tools.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def trimmed(run: Callable) -> Callable:
    """A function of Arrow batches whose worker gives freed memory back to the system as a task ends; idle workers are then small."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # only where the C library has it
                trim(0)

    return whole


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds, without tasks that start Python workers to read it."""
    kinds = T.StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, kinds.names), kinds)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) alone, so that other columns, whatever their names, can't clash; a null text is empty."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the rows, about, whose order tells Spark where to cut a range partitioning; they come to the driver.
RANGE_SAMPLE = 4 << 20


@contextmanager
def small_range_sample(spark: SparkSession, n: int, width: int) -> Iterator[None]:
    """Within, the sample for ranges over ``n`` partitions, whose keys take ``width`` bytes, is about RANGE_SAMPLE.

    Spark takes 100 rows a partition, and three times that for good measure, whatever a row's width. Fewer rows make
    partitions less even and change no result; 10 is the least. A setting that has been changed stays.
    """
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    if spark.conf.get(name) != "100":
        yield
        return
    spark.conf.set(name, min(100, max(10, RANGE_SAMPLE // (3 * n * width))))
    try:
        yield
    finally:
        spark.conf.unset(name)


def hash_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df``, twice as many at the very most: those whose key's hash is below a bound.

    The bound follows from one count, so no task sends more than its share, and the same rows give the same sample.
    Rows of a null key are left out.
    """
    df = df.where(F.col(key).isNotNull())
    n = df.count()
    if n > most:
        df = df.where(F.shiftrightunsigned(F.xxhash64(key), 33) < int(most / n * (1 << 31)))
    return df.limit(2 * most)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column without nulls, and the n + 1 offsets of its rows in them; no copy."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    n = len(column)
    if at is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(at, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def sliced(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of that text column, one row at least: bounds what a step holds."""
    for i, j in groups(utf8(batch.column(column))[1], most):
        yield batch.slice(i, j - i)


def arrow(schema: str, columns: Iterable) -> pa.RecordBatch:
    """A batch from "name type, ..." and its columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for (_, k), c in zip(fields, columns, strict=True)], [n for n, _ in fields])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x (uint64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Powers of an odd number and their inverses, modulo 2^64, for windows of bytes.
_R = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_R, -1, 1 << 64)
#: Bytes that are hashed at a time; only a longer word takes more.
WINDOW = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers and inverse powers; no more than a window's are kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, min(WINDOW, 1 << max(16, (n - 1).bit_length())))
    made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, r, np.uint64)])) for r in (_R, _INVERSE))
    if size <= WINDOW:
        _powers = made
    return made


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then the same of the next."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def groups(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(i, j): consecutive texts of about ``most`` bytes together, one at least; ``at``: n + 1 offsets."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[begin[i]:end[i]]``: polynomials over randomised bytes, from one running sum, then finalised.

    They depend on the bytes alone, not on where those stand.
    """
    n = len(data)
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _words(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    solid = ~_SPACE[data]
    head = np.zeros(n + 1, bool)
    head[at[:-1]] = True  # a text ends a word
    head = head[:n]
    start = solid.copy()
    start[1:] &= ~solid[:-1] | head[1:]
    begin = np.flatnonzero(start)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | head[1:]
    end = np.flatnonzero(last) + 1
    return hash_spans(_LOWER[data] if lower else data, begin, end), begin, end


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated texts: 64-bit hash, first byte, end byte, and each text's first word (n + 1).

    Long texts are read in windows that end in white space, so what a byte takes is bounded whatever the text's length.
    """
    none = np.zeros(0, np.int64)
    parts: list[tuple] = [(np.zeros(0, np.uint64), none, none)]
    for i, j in groups(at, WINDOW):
        a, stop = int(at[i]), int(at[j])
        while a < stop:
            b, size = min(a + WINDOW, stop), WINDOW
            while b < stop:  # only within one long text
                spaces = np.flatnonzero(_SPACE[data[a:b]])
                if len(spaces):
                    b = a + int(spaces[-1]) + 1
                    break
                size *= 2
                b = min(a + size, stop)
            hashed, begin, end = _words(data[a:b], at[i : j + 1] - a if j > i + 1 else np.array([0, b - a]), lower)
            parts.append((hashed, begin + a, end + a))
            a = b
    hashed, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashed, begin, end, np.searchsorted(begin, at).astype(np.int64)


def grams(hashed: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of k consecutive words, from each word on, those that run over the end left out."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_R) + hashed[i : i + n]
    return mix(out)
