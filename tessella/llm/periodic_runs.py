"""Periodic runs of words: every maximal stretch that repeats its first words four times or more.

All lags are scanned: the array of word ids is compared with itself shifted by
each lag q up to n / min_exp, and stretches of equality of (min_exp - 1) q words
are runs of period q. The comparison first looks at every q-th word only: a
stretch that long holds min_exp - 1 such words in a row, so none is missed, and
just the surroundings of such rows are compared in full and run-length coded.
Documents of a batch are laid end to end, longest first, with ids of their own,
so that one comparison serves all of them that are long enough for the lag.

A document over `long_bytes` is dealt out: its id array travels to as many tasks
as it has lag ranges, each task scans its range alone, and the runs meet the
text again by key. A stretch found at lag q counts only if q is its smallest
period, which is a divisor of q, so ranges need not know of each other. A known
run hides itself from the multiples of its period.

Defined cases: a null or empty text has no words and no runs; the word ids are
those of one document, so equal words of different documents never match;
repeated rows and null doc_ids are each judged alone; of equal greatest lengths
the least start, then the least period counts; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.spread import map_arrow, parts

#: Words whose ids a task holds at once; a longer document is a batch of its own.
BATCH = 1 << 19
#: Documents of more bytes are dealt out by lag ranges; longer than nearly all, so that few ids travel.
LONG_BYTES = 1 << 16

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start:long,length:long,period:long>>"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]
Run = tuple[int, int, int]


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by its doc_id, goes on repeating p of its words from word a on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p] * ((n - a) // p + 1)
    return words[:a] + again[: n - a]


def smallest_period(ids: np.ndarray, q: int) -> int:
    """Of a stretch with period q and at least 2 q long: the least divisor of q that is a period."""
    for d in range(1, q // 2 + 1):
        if q % d == 0 and ids[d] == ids[0] and np.array_equal(ids[d:], ids[:-d]):
            return d
    return q


def scan_lags(ids: np.ndarray, reach: Callable[[int], int], lags: range, min_exp: int, least: int) -> Iterator[Run]:
    """(start, length, period) of the runs whose period is among the lags; reach(q): how many leading ids can hold one."""
    hidden: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for q in lags:
        upto = reach(q)
        if not upto:
            return
        shortest = max(least, min_exp * q) - q
        probes = shortest // q
        every = ids[:upto:q]
        hit = every[1:] == every[:-1]
        for s, e in hidden.pop(q, ()):
            hit[-(-s // q) : (e - q - 1) // q + 1] = False
        if np.count_nonzero(hit) < probes:
            continue
        row = hit[: len(hit) - probes + 1].copy()
        for k in range(1, probes):
            row &= hit[k : len(hit) - probes + 1 + k]
        at = np.flatnonzero(row)
        if not len(at):
            continue
        edge = np.flatnonzero(np.diff(at) > 1)
        for j, k in zip(at[np.concatenate([[0], edge + 1])].tolist(), at[np.concatenate([edge, [len(at) - 1]])].tolist(), strict=True):
            lo, hi = max((j - 1) * q + 1, 0), min((k + probes) * q, upto - q)
            same = np.zeros(hi - lo + 2, np.int8)
            same[1:-1] = ids[lo:hi] == ids[lo + q : hi + q]
            turn = np.flatnonzero(np.diff(same))
            for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                if b - a < shortest:
                    continue
                s, e = lo + a, lo + b + q
                p = smallest_period(ids[s:e], q)
                for m in range(q - q % p + p, min((e - s) // min_exp, lags.stop - 1) + 1, p):
                    hidden[m].append((s, e))
                if p == q:
                    yield s, e - s, q


def ids_of(words: list[bytes], base: int = 0) -> np.ndarray:
    place = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
    return np.fromiter(map(place.__getitem__, words), np.int64 if base + len(words) > 1 << 31 else np.int32, len(words))


def runs_of(documents: list[list[bytes]], min_exp: int, least: int) -> list[list[Run]]:
    """The runs of each document, by start, then period."""
    order = sorted((d for d, w in enumerate(documents) if len(w) >= least), key=lambda d: -len(documents[d]))
    out: list[list[Run]] = [[] for _ in documents]
    if not order:
        return out
    size = np.array([len(documents[d]) for d in order])
    end = np.cumsum(size)
    ids = np.concatenate([ids_of(documents[d], int(e - n)) for d, e, n in zip(order, end, size, strict=True)])

    def reach(q: int) -> int:
        k = int(np.searchsorted(-size, -max(least, min_exp * q), "right"))
        return int(end[k - 1]) if k else 0

    for s, length, q in scan_lags(ids, reach, range(1, int(size[0]) // min_exp + 1), min_exp, least):
        k = int(np.searchsorted(end, s, "right"))
        out[order[k]].append((s - int(end[k] - size[k]), length, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words outside what follows the first period of any run, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for s, length, q in runs:
            keep[s + q : s + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def _digest(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest(), len(words))


def _runs(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    return doc_id, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], collapsed(words, runs).decode()


DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("n_words", pa.int64())])
RUNS_ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def words_in(batch: pa.RecordBatch, rewrite: Rewrite | None) -> Iterator[tuple[int | None, list[bytes]]]:
    """(doc_id, words) of each row; bytes.split() parts at exactly the blanks of the contract."""
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        words = (text.as_py() or b"").split()
        yield doc_id, rewrite(doc_id, words) if rewrite else words


def _whole(docs: DataFrame, row: Callable[..., tuple], arrow: pa.Schema, schema: str, rewrite: Rewrite | None, min_exp: int, least: int) -> DataFrame:
    """Documents scanned over all lags where they are read."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(held):
            found = runs_of([w for _, w in held], min_exp, least)
            return batch_of([row(d, w, r) for (d, w), r in zip(held, found, strict=True)], arrow)

        for batch in batches:
            held, n = [], 0
            for d, w in words_in(batch, rewrite):
                if n and n + len(w) > BATCH:
                    yield settle(held)
                    held, n = [], 0
                held.append((d, w))
                n += len(w)
            if held:
                yield settle(held)

    return map_arrow(docs, f, schema)


def _dealt(docs: DataFrame, row: Callable[..., tuple], arrow: pa.Schema, schema: str, rewrite: Rewrite | None, min_exp: int, least: int, long_bytes: int) -> DataFrame:
    """Documents whose lag ranges are scanned by tasks of their own."""
    keyed = docs.select("doc_id", "text", F.sha2("text", 256).alias("key"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, (d, w) in zip(batch.column("key").to_pylist(), words_in(batch, rewrite), strict=True):
                lags = len(w) // min_exp
                # so many that both their number and the lags of each grow slower than the document
                step = max(1, -(-lags // (2 + int((len(w) / BATCH) ** 0.5))))
                ids = ids_of(w).tobytes() if lags else b""
                for lo in range(1, lags + 1, step):
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([key]), pa.array([lo]), pa.array([min(lo + step, lags + 1)]), pa.array([ids], pa.binary())], ["doc_id", "key", "lo", "hi", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                d, key, lo, hi = (batch.column(c)[r].as_py() for c in range(4))
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), np.int32)
                reach = lambda q, n=len(ids): n if n >= max(least, min_exp * q) else 0
                found = list(scan_lags(ids, reach, range(lo, hi), min_exp, least))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(found), pa.int64()), pa.array([key] * len(found)), *(pa.array(c) for c in zip(*found, strict=True))], ["doc_id", "key", "start", "length", "period"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (d, w), found in zip(words_in(batch, rewrite), batch.column("runs").to_pylist(), strict=True):
                yield batch_of([row(d, w, sorted(((r["start"], r["length"], r["period"]) for r in found or []), key=lambda r: (r[0], r[2])))], arrow)

    jobs = map_arrow(keyed, ranges, "doc_id long, key string, lo long, hi long, ids binary")
    found = map_arrow(jobs.repartition(parts(docs.sparkSession), "doc_id", "key", "lo"), scan, "doc_id long, key string, start long, length long, period long")
    # a set, as rows that are repeated find the same runs
    told = found.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_set(F.struct("start", "length", "period")).alias("runs"))
    met = keyed.join(told, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").select("doc_id", "text", "runs")
    return map_arrow(met, last, schema)


def _over(docs: DataFrame, row, arrow, schema, rewrite, min_exp, least, long_bytes) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.octet_length("text") > long_bytes
    few = _whole(docs.where(~long | F.col("text").isNull()), row, arrow, schema, rewrite, min_exp, least)
    return few.unionByName(_dealt(docs.where(long), row, arrow, schema, rewrite, min_exp, least, long_bytes))


def periodic_runs(docs: DataFrame, min_exp: int = 4, least: int = 6, rewrite: Rewrite | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Per document: doc_id, runs (start, length and period in words, by start, then period), collapsed (the text without repetitions)."""
    return _over(docs, _runs, RUNS_ARROW, f"doc_id long, runs {RUNS}, collapsed string", rewrite, min_exp, least, long_bytes)


def digest(docs: DataFrame, min_exp: int = 4, least: int = 6, rewrite: Rewrite | None = with_planted_period, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run, and the digests of all runs and of the collapsed text."""
    return _over(docs, _digest, DIGEST_ARROW, DIGEST, rewrite, min_exp, least, long_bytes)
