"""Substring dedup by level-wise doubling of repeated word windows.

`levels` is the loop. Level 0 looks at grams of half the window length (7 words
for 13), at the content-defined anchors that every window must hold. Only what
repeats in two documents is extended to the whole window at level 1. From then
on a window of twice the length is a candidate only where both its halves
repeat, until no candidate survives; texts are not needed for that, as the hash
of a window comes from those of its halves.

`digest` and `deduplicated` remove the words of windows whose word sequence also
starts in a document with a smaller doc_id (`later`). They run the loop to its
end: a later window that is a half of a candidate leaves its words to it, and
they are settled where the doubling ends, as a span of the last window that was
later. So the spans of all levels together are what goes. `longest_repeats` gives
the windows of every level.

Windows of level 1 are named by 96 bits of two hashes over their words' 64-bit
hashes, so equality is by content but for collisions of 64-bit hashes, about
2^-64 a pair; longer ones by 64 bits, and only words of two later halves can go
by them, so a collision there removes nothing that level 1 would not. Places are
(doc, which of its rows, word).

Defined cases: null text has no words; a document shorter than a window keeps
all; a null doc_id neither removes nor loses words; rows that repeat a doc_id
don't remove each other's words; empty tables give empty results; other columns
don't matter; a text of any length is processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import anchors as A
from tessella.llm import kernels as K
from tessella.llm import spread as S

#: Entries that meet by hash: windows, with what is known of them, and spans that are settled.
WINDOWS = {"h": "u8", "g": "u4", "doc": "i8", "row": "u4", "at": "u4", "n": "u4", "kind": "u1"}
#: Answers: windows that repeat, and settled spans.
PLACES = {"h": "u8", "doc": "i8", "row": "u4", "at": "u4", "n": "u4", "later": "u1"}
SPANS = {"doc": "i8", "row": "u4", "at": "u4", "n": "u4"}
#: Kinds: not the least document of its group, so later; the least, with company; a settled span. With them: which half is later.
TOLD, LED, DONE, FIRST, SECOND = 1, 2, 3, 4, 8


def numbered(rows: pa.Table) -> np.ndarray:
    """Which of its document's rows each row is: 0, and by the order of texts where a doc_id is repeated."""
    ids, number = A.ids_of(rows), np.zeros(len(rows), np.uint32)
    known = ids[rows.column("doc_id").is_valid().to_numpy()]
    if len(np.unique(known)) < len(known):
        order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]).to_numpy()
        edges = S.group_edges(ids[order])
        number[order] = np.arange(len(ids)) - np.repeat(edges[:-1], np.diff(edges))
    return number


def kept_words(data: np.ndarray, w: K.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by document) of the kept words, one space between them."""
    start, end, doc = w.start[keep], w.end[keep], w.doc[keep]
    gap = np.zeros(len(doc), np.int64)
    gap[:-1] = doc[1:] == doc[:-1]
    edge = np.zeros(len(data) + 2, np.int8)
    np.add.at(edge, start, 1)
    np.add.at(edge, end + gap, -1)
    chosen = np.cumsum(edge[: len(data)], dtype=np.int8) > 0
    out = data.copy()
    out[end[gap == 1]] = 32
    size = np.zeros(len(w.first) - 1, np.int64)
    np.add.at(size, doc, end - start + gap)
    return out[chosen], np.concatenate([[0], np.cumsum(size)])


def anchor_grams(length: int):
    k = (length + 1) // 2

    def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = K.words(data, off)
        h = K.Prefix(w.hash, K.WORD_BASE).windows(k)
        at, _, _ = K.minimizers(h, w.first, k, length)
        return h[at], w.doc[at]

    return grams


def dealt(x: dict[str, np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Packed: the windows of a group of documents; kind has their halves.

    Of the documents with one window only the least goes to its bucket; the others
    are known to be later and travel by a hash of their own.
    """
    if not len(x["h"]):
        return
    order = np.argsort(x["h"])
    x = {k: v[order] for k, v in x.items()}
    h, g, doc = x["h"], x["g"], x["doc"]
    other = np.ones(len(h), bool)
    other[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])  # were two g to alternate under one h, each run would have its least
    at = np.flatnonzero(other)
    size = np.diff(np.append(at, len(h)))
    told = doc > np.repeat(np.minimum.reduceat(doc, at), size)
    led = np.repeat(np.logical_or.reduceat(told, at), size)
    kind = x["kind"] | np.where(told, TOLD, np.where(led, LED, 0)).astype(np.uint8)
    yield from S.pack(S.bucket_of(np.where(told, K.mix(doc.view(np.uint64).copy()), h), bits), x | {"kind": kind})


def windows(docs: DataFrame, groups: int, replies: DataFrame, length: int) -> DataFrame:
    """Packed: the windows whose anchor repeats."""
    k, bits = (length + 1) // 2, S.bucket_bits(docs.sparkSession)

    def extend(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = A.with_id(rows)
        known = np.unique(S.unpack([told], A.REPLY)["key"])
        held = S.Gather({"h": "u8", "g": "u4", "doc": "i8", "row": "u4", "at": "u4"})
        ids, number = A.ids_of(rows), numbered(rows)
        for i, j, data, off in K.pieces(rows.column("text")) if len(known) else ():
            w = K.words(data, off)
            seq = K.Prefix(w.hash, K.WORD_BASE)
            starts = K.inside(w.first, length)
            if not len(starts):
                continue
            starts = starts[A.among(K.slide_min(seq.windows(k), length - k + 1)[starts], known)]
            doc = w.doc[starts]
            g = (K.Prefix(w.hash, K.BYTE_BASE).spans(starts, starts + length) >> np.uint64(32)).astype(np.uint32)
            held.add(0, h=seq.spans(starts, starts + length), g=g, doc=ids[i:j][doc], row=number[i:j][doc], at=(starts - w.first[doc]).astype(np.uint32))
        x = held.take()
        n = len(x["h"])
        return A.as_table(dealt(x | {"n": np.full(n, length, np.uint32), "kind": np.zeros(n, np.uint8)}, bits), WINDOWS)

    return A.meet_text(docs, groups, replies, extend, S.packed_schema(WINDOWS))


def in_order(x: dict[str, np.ndarray]) -> np.ndarray:
    """The order of places by document, row and word."""
    doc = x["doc"]
    if len(doc) and not x["row"].any() and int(doc.max()) - int(doc.min()) < 1 << 31:
        return np.argsort(((doc - doc.min()) << 32) | x["at"])
    return np.lexsort((x["at"], x["row"], doc))


def doubled(places: DataFrame, length: int) -> DataFrame:
    """Packed: windows of twice the length whose halves repeat, and as settled spans the later windows that are no half of one."""
    bits = S.bucket_bits(places.sparkSession)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = S.Gather(WINDOWS)  # of several groups, so that rows are few
        for x in S.each_bucket(batches, PLACES):
            order = in_order(x)
            h, doc, row, at, later = (x[c][order] for c in ("h", "doc", "row", "at", "later"))
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
            key = (np.cumsum(new) << 32) | at
            to = np.minimum(np.searchsorted(key, key + length), len(key) - 1)
            a = np.flatnonzero(key[to] == key + length)
            b = to[a]
            kind = (later[a] * FIRST + later[b] * SECOND).astype(np.uint8)
            both = K.mix(h[a] * np.uint64(3) ^ K.salted(h[b], 22))
            held.add(len(a) * 33, h=both, g=np.zeros(len(a), np.uint32), doc=doc[a], row=row[a], at=at[a], n=np.full(len(a), 2 * length, np.uint32), kind=kind)
            if held.bytes > S.FLUSH:
                yield from dealt(held.take(), bits)
            left = later.astype(bool)
            left[a] = left[b] = False
            left = np.flatnonzero(left)
            if not len(left):
                continue
            head = np.ones(len(left), bool)
            head[1:] = np.diff(key[left]) > length
            first, last = left[head], left[np.append(np.flatnonzero(head)[1:], len(left)) - 1]
            none = np.zeros(len(first), np.uint8)
            done = {"h": none.astype(np.uint64), "g": none.astype(np.uint32), "doc": doc[first], "row": row[first], "at": at[first], "n": (at[last] - at[first] + length).astype(np.uint32), "kind": none + np.uint8(DONE)}
            yield from S.pack(S.bucket_of(K.mix(doc[first].view(np.uint64).copy()), bits), done)
        yield from dealt(held.take(), bits)

    return S.map_arrow(S.by_bucket(places), pairs, S.packed_schema(WINDOWS))


def repeating(packed: DataFrame, groups: int, half: int) -> DataFrame:
    """Packed by group: the windows that also start in another document; from bucket `groups` on, settled spans.

    later: also in one with a smaller doc_id. half: words of a window's halves, 0 at level 1.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = S.Gather(PLACES | {"bucket": "i8"})

        def put(x: dict[str, np.ndarray], later: np.ndarray, shift: int) -> None:
            held.add(x["doc"].nbytes * 4, **{k: x[k] for k in PLACES if k != "later"}, later=later.astype(np.uint8), bucket=np.mod(x["doc"], groups) + shift)

        for x in S.each_bucket(batches, WINDOWS):
            kind = x["kind"] & 3
            done = {k: v[kind == DONE] for k, v in x.items()}
            put(done, np.ones(len(done["h"])), groups)
            told = {k: v[kind == TOLD] for k, v in x.items()}
            some = np.flatnonzero((kind == 0) | (kind == LED))
            h, g = x["h"][some], x["g"][some]
            some = some[np.lexsort((g, h)) if g.any() else np.argsort(h)]
            met = {k: v[some] for k, v in x.items()}
            h, g, doc = met["h"], met["g"], met["doc"]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            first = np.flatnonzero(new)
            later = repeats = np.zeros(len(h), bool)
            if len(h):
                size = np.diff(np.append(first, len(h)))
                later = doc > np.repeat(np.minimum.reduceat(doc, first), size)
                repeats = np.repeat(np.logical_or.reduceat(later | ((met["kind"] & 3) == LED), first), size)
            x = {k: np.concatenate([v, told[k]]) for k, v in met.items()}
            later = np.append(later, np.ones(len(told["h"]), bool))
            repeats = np.append(repeats, np.ones(len(told["h"]), bool))
            if half:
                later &= (x["kind"] & (FIRST | SECOND)) == (FIRST | SECOND)
                for bit, skip in ((FIRST, 0), (SECOND, half)):  # the doubling ends here: its halves are settled
                    sel = ~later & ((x["kind"] & bit) > 0)
                    part = {k: v[sel] for k, v in x.items()}
                    put(part | {"at": part["at"] + np.uint32(skip), "n": np.full(sel.sum(), half, np.uint32)}, np.ones(sel.sum()), groups)
            else:
                x["h"] ^= K.salted(x["g"].astype(np.uint64), 23)
            put({k: v[repeats] for k, v in x.items()}, later[repeats], 0)
            if held.bytes > S.FLUSH:
                y = held.take()
                yield from S.pack(y.pop("bucket"), y)
        y = held.take()
        yield from S.pack(y.pop("bucket"), y)

    return S.map_arrow(S.by_bucket(packed), meet, S.packed_schema(PLACES))


def levels(docs: DataFrame, groups: int, length: int) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(words of a window, packed places of the windows of that length that repeat, packed spans settled there): length, twice the length and so on.

    The last level is the first one without a place. A level is computed when it
    is asked for, and places go with the next one.
    """
    anchors = S.cut(A.repeated(docs, anchor_grams(length), groups))
    made, half = S.cut(repeating(windows(docs, groups, anchors, length), groups, 0)), 0
    S.drop(anchors)
    while True:
        places = made.where(F.col("bucket") < groups)
        yield length, places, S.cut(made.where(F.col("bucket") >= groups).select((F.col("bucket") - groups).alias("bucket"), *SPANS))
        if places.isEmpty():
            S.drop(made)
            return
        half, length, last = length, 2 * length, made
        made = S.cut(repeating(doubled(places, half), groups, half))
        S.drop(last)


def removal(docs: DataFrame, length: int, f, schema: str) -> DataFrame:
    """f(doc_id column, bytes, offsets, words, which words go) -> RecordBatch, for all documents."""
    groups = A.groups_for(docs)
    settled = [spans for _, _, spans in levels(docs, groups, length)]

    def last(rows: pa.Table, told: pa.Table) -> pa.Table:
        x, out = S.unpack([told], SPANS), []
        column = rows.column("doc_id").combine_chunks()
        ids = A.ids_of(rows)
        own = np.unique(ids)
        code = (np.searchsorted(own, ids) << 32) | numbered(rows)
        order = np.argsort(code)
        row = order[np.searchsorted(code[order], (np.searchsorted(own, x["doc"]) << 32) | x["row"])]
        by_row = np.argsort(row)
        row, at, n = row[by_row], x["at"][by_row].astype(np.int64), x["n"][by_row].astype(np.int64)
        for i, j, data, off in K.pieces(rows.column("text")):
            w = K.words(data, off)
            mine = slice(*np.searchsorted(row, [i, j]))
            gone = K.covered(len(w.start), w.first[row[mine] - i] + at[mine], n[mine])
            out.append(f(column.slice(i, j - i), data, off, w, gone))
        return pa.Table.from_batches(out) if out else None

    def whole(rows: pa.Table, told: pa.Table) -> pa.Table:
        made = last(rows, told)
        return made if made is not None else pa.table({n: pa.array([], t) for n, t in EMPTY[schema].items()})

    return A.meet_text(docs, groups, reduce(DataFrame.unionByName, settled), whole, schema)


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
TEXTS = "doc_id long, kept_text string"
EMPTY = {DIGEST: {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}, TEXTS: {"doc_id": pa.int64(), "kept_text": pa.string()}}


def _digest(ids, data, off, w, gone):
    text, at = kept_words(data, w, ~gone)
    n = np.diff(w.first)
    removed = np.zeros(len(n), np.int64)
    np.add.at(removed, w.doc[gone], 1)
    view = memoryview(np.ascontiguousarray(text))
    sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(removed), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(ids, data, off, w, gone):
    text, at = kept_words(data, w, ~gone)
    held = text.tobytes()
    return pa.RecordBatch.from_arrays([ids, pa.array([held[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())], ["doc_id", "kept_text"])


def digest(docs: DataFrame, length: int = 13) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return removal(docs, length, _digest, DIGEST)


def deduplicated(docs: DataFrame, length: int = 13) -> DataFrame:
    """Per document: doc_id, kept_text (the kept words, one space between them)."""
    return removal(docs, length, _texts, TEXTS)


def longest_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """(level_words, doc_id, start_word): the windows of the greatest doubled lengths that two documents share, level by level.

    A row (L, d, s): the L words of document d from word s on also occur in
    another document; L is length, 2 * length, 4 * length and so on. Rows are
    distinct, also where rows of documents repeat.
    """
    groups, out = A.groups_for(docs), None

    def starts(size: int):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in S.each_bucket(batches, PLACES):
                doc, at = np.unique(np.stack([x["doc"], x["at"].astype(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), size)), pa.array(doc), pa.array(at)], ["level_words", "doc_id", "start_word"])

        return found

    for size, places, _ in levels(docs, groups, length):
        rows = S.cut(S.map_arrow(S.by_bucket(places), starts(size), "level_words long, doc_id long, start_word long"))
        out = rows if out is None else out.unionByName(rows)
    return out
