"""Bracket structure of token sequences, one text a row: vectorised over an Arrow batch, nothing is shuffled.

Input is an array of codes a text (OPEN, CLOSE, EQUALS, COMMA or 0); all kernels
work on the flat codes of a batch and the offsets of its texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from tessella.functions import text as T

OPENS, CLOSES, EQUALS, COMMA = 1, -1, 2, 3


def codes(tokens: Column) -> Column:
    of = lambda t: F.when(t.isin(*T.OPEN), OPENS).when(t.isin(*T.CLOSE), CLOSES).when(t == "=", EQUALS).when(t == ",", COMMA).otherwise(0)
    return F.transform(tokens, of).cast("array<tinyint>")


#: Codes, or bytes of text, that a kernel takes at once: what it holds is some 100 times as many bytes, however large a batch is.
PIECE = 1 << 18


def offsets(v: pa.Array) -> np.ndarray:
    """Where each list or text of a column starts, from 0; nulls are empty."""
    size = pc.list_value_length(v) if pa.types.is_list(v.type) or pa.types.is_large_list(v.type) else pc.binary_length(v)
    return np.concatenate([[0], np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def by_pieces(kernel: Callable[[pa.Array], pa.Array], v: pa.Array) -> pa.Array:
    """kernel over runs of whole rows of PIECE at most, a longer row by itself."""
    off, out, i = offsets(v), [], 0
    while i < len(v):
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, side="right")) - 1)
        out.append(kernel(v.slice(i, j - i)))
        i = j
    return pa.concat_arrays(out) if out else kernel(v)


def pieced(kernel: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """A kernel that takes a batch by pieces."""

    def run(v: pa.Array) -> pa.Array:
        return by_pieces(kernel, v)

    # what arrow_udf reads to tell its kind
    run.__annotations__ = {"v": pa.Array, "return": pa.Array}
    run.__name__, run.__doc__ = kernel.__name__, kernel.__doc__
    return run


def flat(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column; a null list is empty."""
    n = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    return v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def listed(values: pa.Array, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)


def rows_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def steps(code: np.ndarray) -> np.ndarray:
    return np.where(np.abs(code) == 1, code, 0).astype(np.int64)


def running(step: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the steps before each place of a text."""
    total = np.concatenate([[0], np.cumsum(step)])
    return total[:-1] - np.repeat(total[off[:-1]], np.diff(off))


def clamped(step: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Open brackets before each place, never under 0 however many close: the running sum less its running minimum."""
    before = running(step, off)
    wide = 2 * len(step) + 2  # texts are kept apart by more than any sum
    low = np.minimum.accumulate(before - rows_of(off) * wide) + rows_of(off) * wide if len(step) else before
    return before - np.minimum(low, 0)


def matched(step: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(open, close, level) of the brackets that close, as flat places in order of the opening ones: neighbours on one level."""
    at = np.flatnonzero(step)
    depth = clamped(step, off)[at]
    level = np.where(step[at] > 0, depth, depth - 1)
    order = np.lexsort((at, level, rows_of(off)[at]))
    at, level, row = at[order], level[order], rows_of(off)[at][order]
    ok = np.flatnonzero((step[at[:-1]] > 0) & (step[at[1:]] < 0) & (level[1:] == level[:-1]) & (row[1:] == row[:-1]))
    first = np.argsort(at[ok], kind="stable")
    return at[ok][first], at[ok + 1][first], level[ok][first]


def last_before(group: np.ndarray, at: np.ndarray, of: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The last place in `at` (of group `group`) before each place `where` (of group `of`), or -1."""
    n = int(max(at.max(initial=0), where.max(initial=0))) + 2
    key = np.sort(group * n + at)
    if not len(key):
        return np.full(len(where), -1)
    q = np.searchsorted(key, of * n + where) - 1
    found = key[np.maximum(q, 0)]
    return np.where((q >= 0) & (found >= of * n), found - of * n, -1)


def grouped(row: np.ndarray, level: np.ndarray) -> np.ndarray:
    return row * (int(level.max(initial=0)) + 2) + level


@F.arrow_udf(ArrayType(IntegerType()))
@pieced
def depth(code: pa.Array) -> pa.Array:
    value, off = flat(code)
    return listed(pa.array(clamped(steps(value), off).astype(np.int32)), off)


@F.arrow_udf(ArrayType(IntegerType()))
@pieced
def unclamped(code: pa.Array) -> pa.Array:
    """Brackets opened less closed before each token; closing ones count themselves, so both of a pair have one level."""
    value, off = flat(code)
    step = steps(value)
    return listed(pa.array((running(step, off) + np.minimum(step, 0)).astype(np.int32)), off)


@F.arrow_udf(ArrayType(StructType([StructField(n, IntegerType()) for n in ("open_idx", "close_idx", "level")])))
@pieced
def pairs(code: pa.Array) -> pa.Array:
    value, off = flat(code)
    a, b, level = matched(steps(value), off)
    row = rows_of(off)[a]
    cols = [pa.array(x.astype(np.int32)) for x in (a - off[row], b - off[row], level)]
    return listed(pa.StructArray.from_arrays(cols, ["open_idx", "close_idx", "level"]), np.searchsorted(row, np.arange(len(off))))


@F.arrow_udf(ArrayType(IntegerType()))
@pieced
def enclosing(code: pa.Array) -> pa.Array:
    """The opening bracket of the innermost pair around each token, or -1."""
    value, off = flat(code)
    row, place = rows_of(off), np.arange(len(value))
    a, b, _ = matched(steps(value), off)
    own = np.zeros(len(value), np.int64)
    own[a], own[b] = 1, -1
    around = running(own, off)  # pairs open before a token; a closing one is outside of its own pair
    inside = around + np.minimum(own, 0)
    found = last_before(grouped(row[a], around[a]), a, grouped_like(row, inside - 1, around[a]), place)
    return listed(pa.array(np.where((inside > 0) & (found >= 0), found - off[row], -1).astype(np.int32)), off)


def grouped_like(row: np.ndarray, level: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """grouped() by the levels of another column; what it doesn't have is in no group."""
    most = int(levels.max(initial=0)) + 2
    return np.where((level >= 0) & (level < most), row * most + level, -1)


@F.arrow_udf(ArrayType(BooleanType()))
@pieced
def in_value(code: pa.Array) -> pa.Array:
    """Whether on the token's level, since the last comma or opening bracket, an '=' came before."""
    value, off = flat(code)
    row, place = rows_of(off), np.arange(len(value))
    level = clamped(steps(value), off)
    group = grouped(row, level)
    last = lambda sign: last_before(group[value == sign], place[value == sign], group, place)
    opened = last_before(row[value == OPENS], place[value == OPENS], row, place)
    eq = last(EQUALS)
    return listed(pa.array((eq > last(COMMA)) & ((level == 0) | (eq > opened))), off)


@F.arrow_udf(ArrayType(StringType()))
@pieced
def top_level_parts(text: pa.Array) -> pa.Array:
    """A text split at the commas outside brackets; null stays null."""
    held = text.fill_null("").cast(pa.large_string())
    _, where, raw = held.buffers()
    off = np.frombuffer(where, np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
    off = off - off[0]
    sign = np.zeros(256, np.int64)
    sign[[ord(c) for c in T.OPEN]], sign[[ord(c) for c in T.CLOSE]] = 1, -1
    cut = (data == ord(",")) & (clamped(sign[data], off) == 0)
    kept = np.concatenate([[0], np.cumsum(~cut)])
    at = np.flatnonzero(cut)
    # parts lie side by side once the commas between them are gone
    starts = np.sort(np.concatenate([off[:-1], at + 1]))
    n = 1 + np.bincount(rows_of(off)[at], minlength=len(off) - 1)
    ends = np.append(kept[starts], kept[-1]).astype(np.int64)
    parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data[~cut]).tobytes())).cast(pa.string())
    out = listed(parts, np.concatenate([[0], np.cumsum(n)]))
    return pc.if_else(text.is_valid(), out, pa.scalar(None, out.type))
