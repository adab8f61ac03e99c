"""Suffix-array dedup: a logarithmic family of suffix arrays over repeated passages.

The match length L is fixed (50 bytes), so a suffix counts by its first L
bytes. Anchors (16-byte grams that are least in some window) which occur in two
documents, half a window before or after them included, mark the passages that can match at all; each marked passage travels
once, with the suffix starts that the anchor stands for, to the bucket of its
anchor. There passages arrive in batches by doc_id; a passage that came before,
byte for byte, is settled at once, and of the others' suffixes those stay whose hash the
bucket holds again: a text's chance likenesses are many more in a larger corpus,
and go there. A batch gets a suffix array (its suffixes in
the order of their first L bytes; equal ones collapse to the least document), is
scanned in order against the arrays of the existing levels, and becomes a level
itself; while the two last levels are of like size they merge into one, so that
n batches leave about log2(n) levels, each suffix is merged log2(n) times at
most, and a new batch meets log2(n) arrays. Hashes only find passages that may
match: what removes bytes has been compared byte for byte.

A suffix that is found in a level or in its own batch under a smaller doc_id
removes the bytes it covers.

Defined cases: null text is empty; a document shorter than L keeps all; matches
never cross documents; a null doc_id neither removes nor loses bytes; rows that
repeat a doc_id don't remove each other's bytes; empty tables give empty
results; other columns don't matter; texts of any length are processed whole,
cut bytes need not be valid UTF-8 (kept_bytes is binary).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import anchors as A
from tessella.llm import kernels as K
from tessella.llm import spread as S

GRAM = 16
#: Passages of a batch.
BATCH = 1 << 12
#: Bytes of text at a time: their hashes stay in a core's cache.
PIECE = 1 << 16


def passages_fields(length: int) -> dict[str, str]:
    return {"doc": "i8", "at": "u4", "count": "u1", "told": "u1", "text": f"V{2 * length - GRAM}"}


VERDICT = {"doc": "i8", "at": "u4", "mask": "u8"}


def byte_grams(length: int):
    half = (length - GRAM) // 2

    def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seq = K.Prefix(data, K.BYTE_BASE)
        h = seq.windows(GRAM)
        at, _, _ = K.minimizers(h, off, GRAM, length)
        # beyond a document's edge a side is some value: no window reaches there
        before = seq.spans(np.maximum(at - half, 0), at)
        after = seq.spans(at + GRAM, np.minimum(at + GRAM + half, len(data)))
        near = (before & np.uint64(0xFFFF)) | (after & np.uint64(0xFFFF)) << np.uint64(16)
        return h[at], np.searchsorted(off, at, "right") - 1, near.astype(np.uint32)

    return grams


def marked(data: np.ndarray, off: np.ndarray, length: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, K.Prefix]:
    """(first window start, number of starts, anchor key) of the runs of windows with one marked anchor; the bytes' prefix sums."""
    seq = K.Prefix(data, K.BYTE_BASE)
    h = seq.windows(GRAM)
    at, least, ok = K.minimizers(h, off, GRAM, length)
    places = at[A.among(h[at], known)] if len(at) else at
    if not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), seq
    # runs of whole windows whose least gram is the same
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    p = np.flatnonzero(change)
    end = np.append(p[1:], len(least))
    hit = np.flatnonzero(ok[p] & A.among(least[p], known))
    p, end, key = p[hit], end[hit], least[p[hit]]

    def place(p: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The first place at or after p where a gram has this hash."""
        n = np.searchsorted(places, p)
        wrong = h[places[n]] != key
        while wrong.any():
            n[wrong] += 1
            wrong[wrong] = h[places[n[wrong]]] != key[wrong]
        return places[n]

    several = end > place(p, key) + 1
    count = end - p
    if several.any():
        # the gram comes again inside such runs: they are parted by its places
        n = count[several]
        each = np.repeat(p[several] - np.cumsum(n) + n, n) + np.arange(n.sum())
        held = np.repeat(key[several], n)
        at = place(each, held)
        new = np.ones(len(each), bool)
        new[1:] = (at[1:] != at[:-1]) | (each[1:] != each[:-1] + 1)
        first = np.flatnonzero(new)
        p = np.concatenate([p[~several], each[first]])
        count = np.concatenate([count[~several], np.diff(np.append(first, len(each)))])
        key = np.concatenate([key[~several], held[first]])
        order = np.argsort(p)
        p, count, key = p[order], count[order], key[order]
    return p, count, key, seq


def passages(docs: DataFrame, groups: int, replies: DataFrame, length: int) -> DataFrame:
    fields = passages_fields(length)
    width, bits = 2 * length - GRAM, S.bucket_bits(docs.sparkSession)
    # by the number of starts: which bytes are a passage's own
    own = (np.arange(width) < np.arange(length - GRAM + 2)[:, None] + length - 1).astype(np.uint8)

    def extract(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = A.with_id(rows)
        known = np.sort(S.unpack([told], A.REPLY)["key"])
        known = known[S.group_edges(known)[:-1]]
        held = S.Gather({"key": "u8", "same": "u8", "doc": "i8", "at": "u4", "count": "u1", "text": fields["text"]})
        ids = A.ids_of(rows)
        for i, j, data, off in K.pieces(rows.column("text"), PIECE) if len(known) else ():
            p, count, key, seq = marked(data, off, length, known)
            if not len(p):
                continue
            doc = np.searchsorted(off, p, "right") - 1
            text = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)[p] * own[count]
            held.add(0, key=key, same=seq.spans(p, p + count + length - 1), doc=ids[i:j][doc], at=(p - off[doc]).astype(np.uint32), count=count.astype(np.uint8), text=text.view(fields["text"])[:, 0])
        x = held.take()
        if not len(x["key"]):
            return A.as_table(iter(()), fields)
        # of equal passages in the documents of this group those of the least document stand for all
        text = x["text"].view(np.uint8).reshape(-1, width).copy()
        order = np.lexsort((x["doc"], x["same"]))
        edges = S.group_edges(x["same"][order])
        lead = np.empty(len(order), np.int64)
        lead[order] = np.repeat(order[edges[:-1]], np.diff(edges))
        is_told = ((x["doc"] != x["doc"][lead]) & (x["count"] == x["count"][lead]) & (text == text[lead]).all(axis=1)).astype(np.uint8)
        spread = np.where(is_told == 1, K.mix(x["doc"].view(np.uint64).copy()), K.salted(x["key"], 61))
        text[is_told == 1] = 0
        return A.as_table(S.pack(S.bucket_of(spread, bits), {"doc": x["doc"], "at": x["at"], "count": x["count"], "told": is_told, "text": text.view(fields["text"])[:, 0]}), fields)

    return A.meet_text(docs, groups, replies, extract, S.packed_schema(fields), cycles=0)


class Level:
    """A suffix array: distinct suffixes in the order of their bytes, with the least document of each."""

    def __init__(self, suffix: np.ndarray, doc: np.ndarray):
        order = np.argsort(suffix, kind="stable")  # merges runs that are in order already
        s = suffix[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.flatnonzero(new)
        self.suffix = s[at]
        self.doc = np.minimum.reduceat(doc[order], at) if len(at) else doc
        self.of = np.empty(len(s), np.int64)  # which distinct suffix each given one is
        self.of[order] = np.cumsum(new) - 1

    def __len__(self) -> int:
        return len(self.suffix)

    def scan(self, batch: Level) -> np.ndarray:
        """The least document here of each distinct suffix of a batch, or the greatest long; both arrays are passed in order."""
        out = np.full(len(batch), np.iinfo(np.int64).max)
        if len(self):
            at = np.minimum(np.searchsorted(self.suffix, batch.suffix), len(self) - 1)
            hit = self.suffix[at] == batch.suffix
            out[hit] = self.doc[at[hit]]
        return out


class Family:
    """Levels of geometric sizes."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def add(self, suffix: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The least document so far of each suffix of a new batch, which then joins the family."""
        own = Level(suffix, doc)
        least, of = own.doc, own.of
        for level in self.levels:
            least = np.minimum(least, level.scan(own))
        self.levels.append(own)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(Level(np.concatenate([a.suffix, b.suffix]), np.concatenate([a.doc, b.doc])))
        return least[of]


def suffixes(text: np.ndarray, which: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """The first `length` bytes of the suffixes at `start` of passages (rows of bytes)."""
    windows = np.lib.stride_tricks.sliding_window_view(text, length, axis=1)
    # byte strings of one length: their order is that of their bytes, NUL included
    return np.ascontiguousarray(windows[which, start]).view(f"S{length}")[:, 0]


def sums(text: np.ndarray) -> np.ndarray:
    """Prefix sums of each row of bytes, from which spans are hashed."""
    out = np.zeros((len(text), text.shape[1] + 1), np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * K.powers(K.BYTE_BASE, text.shape[1])[0][: text.shape[1]], axis=1, out=out[:, 1:])
    return out


def collapsed(text: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each passage the first one with the same bytes."""
    held = text if text.shape[1] % 4 == 0 else np.pad(text, ((0, 0), (0, -text.shape[1] % 4)))
    held = np.ascontiguousarray(held).view(np.uint32)
    factors = K.salted(np.arange(held.shape[1], dtype=np.uint64), 67)
    same = np.concatenate([np.empty(0, np.uint64), *((held[i : i + BATCH] * factors).sum(axis=1) for i in range(0, len(text), BATCH))])
    order = np.argsort(same)
    edges = S.group_edges(same[order])
    first = np.empty(len(text), np.int64)
    if len(text):
        first[order] = np.repeat(np.minimum.reduceat(order, edges[:-1]), np.diff(edges))
    return np.where((count[first] == count) & (text[first] == text).all(axis=1), first, np.arange(len(text)))


def again(text: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, start) of the suffixes whose hash comes again; all that occur twice are among them."""
    starts = np.arange(text.shape[1] - length + 1)
    inverse = K.powers(K.BYTE_BASE, len(starts))[1][: len(starts)]
    has = starts < count[:, None]
    hashes = []
    for i in range(0, len(text), BATCH):
        x = sums(text[i : i + BATCH])
        hashes.append(((x[:, length:] - x[:, :-length]) * inverse)[has[i : i + BATCH]])
    h = np.concatenate([np.empty(0, np.uint64), *hashes])
    order = np.argsort(h)
    h = h[order]
    twice = order[:-1][h[1:] == h[:-1]], order[1:][h[1:] == h[:-1]]
    some = np.zeros(len(h), bool)
    some[twice[0]] = some[twice[1]] = True
    at = np.flatnonzero(has)[some]
    return at // len(starts), at % len(starts)


def verdicts(packed: DataFrame, groups: int, length: int) -> DataFrame:
    """Packed by group: the suffix starts (from `at`, as a bit mask) that occur in a document with a smaller doc_id."""
    fields = passages_fields(length)
    width = 2 * length - GRAM

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = S.Gather(VERDICT)
        for x in S.each_bucket(batches, fields):
            told = x["told"] == 1
            held.add(0, doc=x["doc"][told], at=x["at"][told], mask=(np.uint64(1) << x["count"][told].astype(np.uint64)) - np.uint64(1))
            mine = np.flatnonzero(~told)
            mine = mine[np.argsort(x["doc"][mine], kind="stable")]
            doc, at = x["doc"][mine], x["at"][mine]
            mask = seen_before(x["text"][mine].view(np.uint8).reshape(len(mine), width), x["count"][mine].astype(np.int64), doc, length)
            some = mask > 0
            held.add(len(doc) * 20, doc=doc[some], at=at[some], mask=mask[some])
            if held.bytes > S.FLUSH:
                y = held.take()
                yield from S.pack(np.mod(y["doc"], groups), y)
        y = held.take()
        yield from S.pack(np.mod(y["doc"], groups), y)

    return S.map_arrow(S.by_bucket(packed), meet, S.packed_schema(VERDICT))


def seen_before(text: np.ndarray, count: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each passage, in the order of doc, the suffix starts (as bits) that an earlier document also has."""
    # a passage that is here already, byte for byte, needs no suffix array: all its suffixes have been seen
    first = collapsed(text, count)
    lead = np.flatnonzero(first == np.arange(len(doc)))
    mask = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    mask[lead] = 0
    family = Family()
    which, start = again(text[lead], count[lead], length)
    edges = np.searchsorted(which, np.arange(0, len(lead) + BATCH, BATCH))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        sel, at = lead[which[a:b]], start[a:b]
        hit = family.add(suffixes(text, sel, at, length), doc[sel]) < doc[sel]
        np.bitwise_or.at(mask, sel[hit], np.uint64(1) << at[hit].astype(np.uint64))
    shared = doc == doc[first]  # the same passage twice in one document shares a verdict
    mask[shared] = mask[first[shared]]
    return mask


def gone_bytes(off: np.ndarray, ids: np.ndarray, v: dict[str, np.ndarray], length: int) -> np.ndarray:
    """Which bytes of a run of documents are removed; v is sorted by doc."""
    edge = np.zeros(int(off[-1]) + 1, np.int32)
    lo, hi = np.searchsorted(v["doc"], ids, "left"), np.searchsorted(v["doc"], ids, "right")
    n = hi - lo
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = np.repeat(off[:-1], n) + v["at"][rows]
    mask = v["mask"][rows]
    # a run of starts covers one range; of masks with gaps run after run is taken
    while len(mask):
        low = mask & (~mask + np.uint64(1))
        rest = (mask + low) & mask
        run = mask ^ rest
        a, b = (np.frexp(x.astype(np.float64))[1] - 1 for x in (low, run + low))
        np.add.at(edge, base + a, 1)
        np.add.at(edge, base + b - 1 + length, -1)
        more = rest > 0
        base, mask = base[more], rest[more]
    return np.cumsum(edge[:-1]) > 0


DIGEST = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
BYTES = {"doc_id": pa.int64(), "kept_bytes": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}


def removal(docs: DataFrame, length: int, f, fields: dict[str, pa.DataType], schema: str) -> DataFrame:
    groups = A.groups_for(docs)
    first = S.cut(A.repeated(docs, byte_grams(length), groups, PIECE, sides=True))
    found = S.cut(verdicts(passages(docs, groups, first, length), groups, length))

    def last(rows: pa.Table, told: pa.Table) -> pa.Table:
        v = S.unpack([told], VERDICT)
        order = np.argsort(v["doc"], kind="stable")
        v = {k: c[order] for k, c in v.items()}
        ids, out = A.ids_of(rows), []
        column = rows.column("doc_id").combine_chunks()
        for i, j, data, off in K.pieces(rows.column("text"), PIECE):
            gone = gone_bytes(off, ids[i:j], v, length)
            start, end = K.bounds(gone, off)
            keep = ~gone
            kept = data[keep]
            at = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[off]
            out.append(pa.Table.from_arrays([column.slice(i, j - i), *f(off, kept, at, start, end)], names=list(fields)))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in fields.items()})

    return A.meet_text(docs, groups, found, last, schema, cycles=0)


def _digest(off, kept, at, start, end):
    doc = np.searchsorted(off, start, "right") - 1
    spans = np.bincount(doc, minlength=len(off) - 1)
    view = memoryview(np.ascontiguousarray(kept))
    sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return [pa.array(np.diff(off)), pa.array(np.diff(off) - np.diff(at)), pa.array(spans.astype(np.int64)), pa.array(sha, pa.string())]


def _bytes(off, kept, at, start, end):
    doc = np.searchsorted(off, start, "right") - 1
    spans: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
        spans[d].append({"start": a - int(off[d]), "end": b - int(off[d])})
    held = kept.tobytes()
    return [pa.array([held[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array(spans, BYTES["spans"])]


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removal(docs, length, _digest, DIGEST, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """Per document: doc_id, kept_bytes, spans (removed byte ranges)."""
    return removal(docs, length, _bytes, BYTES, "doc_id long, kept_bytes binary, spans array<struct<start:long,end:long>>")
