"""Bloom filters of longs, of a size that is given and not found: made by grouped aggregation, sent to Python workers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 8 MB. More rows mean more false positives, which cost time and change no result.
BITS = 26
_SEEDS = (0x51, 0xA7)


def _place(column, seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 64 - BITS)


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """The filter of a long column, as 2^BITS bits in longs; at most 2^BITS / 64 rows come to the driver."""
    places = df.select(F.explode(F.array(*[_place(F.col(column), s) for s in _SEEDS])).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.int64)
    found = words.toArrow()
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out


# Spark's xxhash64 of (int seed, long value), step by step, on arrays: the same places without the JVM.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def _xxhash64(seed: int, values: np.ndarray) -> np.ndarray:
    one = np.full(1, 42, np.uint64) + _P5 + np.uint64(4)
    one = one ^ (np.full(1, seed, np.uint64) * _P1)
    start = _finish(_rotate(one, 23) * _P2 + _P3)
    x = start + _P5 + np.uint64(8)
    x = x ^ (_rotate(values.astype(np.uint64) * _P2, 31) * _P1)
    return _finish(_rotate(x, 27) * _P1 + _P4)


def may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for seed in _SEEDS:
        at = _xxhash64(seed, values.view(np.uint64) if values.dtype == np.int64 else values) >> np.uint64(64 - BITS)
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out
