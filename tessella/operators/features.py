"""Windows and hashed features of token sequences, one text a row: vectorised over pieces of an Arrow batch."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessella.operators import brackets as B

FEATURES = ArrayType(StructType([StructField("bucket", IntegerType()), StructField("w", DoubleType())]))
WINDOWS = StructType([*[StructField(n, LongType()) for n in ("before_n", "after_n", "n")], StructField("first_before", StringType())])
SLOTS = StructType([*[StructField(n, LongType()) for n in ("n", "first_slot", "last_slot")], StructField("top", StringType())])


def placed(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the texts, the text of each token, its place there)."""
    off = B.offsets(tokens)
    row = B.rows_of(off)
    return off, row, np.arange(off[-1]) - off[row]


def greatest(values: pa.Array, row: np.ndarray, rows: int, sign: int = 1) -> pa.Array:
    """By row, the greatest of its values, the least if sign is -1; null without any. Rows come in order."""
    held = values.dictionary_encode()
    order = pc.sort_indices(held.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(rows, -1, np.int64)
    if len(row):
        of = rank[held.indices.to_numpy(zero_copy_only=False)] * sign
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        best[row[at]] = np.maximum.reduceat(of, at) * sign
    return pc.take(held.dictionary, pa.array(order[best] if len(order) else np.zeros(rows, np.int64), mask=best < 0))


def summed(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.bincount(row, values, rows).astype(np.int64))


def window_totals(before: int, after: int):
    """A function of token arrays: before_n, after_n, n and first_before of each text's windows."""

    def of(tokens: pa.Array) -> pa.Array:
        off, row, place = placed(tokens)
        n, rows = np.diff(off), len(tokens)
        held, ahead = np.minimum(place, before), np.minimum(n[row] - 1 - place, after)
        start = np.concatenate([[0], np.cumsum(held)])
        at = np.arange(start[-1]) - np.repeat(start[:-1] - np.arange(len(place)) + held, held)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pc.take(tokens.flatten(), pa.array(at))), " ")
        cols = [summed(row, held, rows), summed(row, ahead, rows), pa.array(n), greatest(text, row, rows, -1)]
        return pa.StructArray.from_arrays(cols, WINDOWS.names)

    @F.arrow_udf(WINDOWS)
    def run(tokens: pa.Array) -> pa.Array:
        return B.by_pieces(of, tokens)

    return run


def slot_totals(size: int):
    """A function of token arrays: n, first_slot, last_slot and top of each text's right-aligned slots."""

    def of(tokens: pa.Array) -> pa.Array:
        off, row, place = placed(tokens)
        rows, last = len(tokens), np.flatnonzero(place >= 1)
        top = greatest(pc.take(tokens.flatten(), pa.array(last - 1)), row[last], rows)
        cols = [pa.array(np.diff(off)), summed(row, place >= size, rows), summed(row, place >= 1, rows), top]
        return pa.StructArray.from_arrays(cols, SLOTS.names)

    @F.arrow_udf(SLOTS)
    def run(tokens: pa.Array) -> pa.Array:
        return B.by_pieces(of, tokens)

    return run


@lru_cache(1 << 16)
def buckets_of(token: str, offsets: tuple[int, ...], n: int) -> tuple[int, ...]:
    """The bucket of a token at each offset, as functions.hashing.bucket has it."""
    return tuple(int(hashlib.md5(f"tok@{d}:{token}".encode()).hexdigest()[:8], 16) % n for d in offsets)


def weights(buckets: int, before: int, after: int):
    """A function of token arrays: (bucket, weight) of each text, buckets without a feature left out."""
    offsets = tuple(d for d in range(-before, after + 1) if d)

    def of(tokens: pa.Array) -> pa.Array:
        off, row, place = placed(tokens)
        n = np.diff(off)[row]
        held = tokens.flatten().dictionary_encode()
        code = held.indices.to_numpy(zero_copy_only=False)
        known = np.array([buckets_of(t, offsets, buckets) for t in held.dictionary.to_pylist()], np.int64).reshape(-1, len(offsets))
        w = np.zeros(len(tokens) * buckets)
        for k, d in enumerate(offsets):
            at = np.flatnonzero((place >= d) & (place - d < n))
            w += np.bincount(row[at] * buckets + known[code[at], k], minlength=len(w)) / (1 + abs(d))
        some = np.flatnonzero(w)
        cols = [pa.array((some % buckets).astype(np.int32)), pa.array(w[some])]
        return B.listed(pa.StructArray.from_arrays(cols, ["bucket", "w"]), np.searchsorted(some // buckets, np.arange(len(tokens) + 1)))

    @F.arrow_udf(FEATURES)
    def run(tokens: pa.Array) -> pa.Array:
        return B.by_pieces(of, tokens)

    return run
