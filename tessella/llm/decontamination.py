"""Benchmark decontamination by template canonicalisation.

Texts become token sequences: maximal runs of letters and digits, ASCII case
folded, with numbers, names (capitalised inside a sentence; neighbours are one
name) and units (known words right after a number) replaced by typed
placeholders. Windows of `length` template tokens of all documents are looked
up among those of the benchmark; a second view leaves names as they are, so a
copy in other letter case is found too, and a third one has no placeholders at
all, so what is mostly numbers, or short, is found where it is copied. Hits of one document and item on one
alignment form a match. Its slots must be consistent: over the match, equal
slot values of the item are equal in the document; different ones may become
equal. Where a value of the item meets several, the one met most often holds (at
a tie the item's own), and only windows with another one are no evidence.
So a question with other numbers or names is caught, and prose that only shares
a pattern isn't. A match counts from half of the item's windows, or from six
windows (13 tokens) on.

The benchmark is looked up in blocks of bounded size (BLOCK_BYTES of text),
each broadcast and met by one scan of the documents; benchmarks fit one block.
Documents are never shuffled.

Defined cases: null texts have no tokens; an item with fewer than `length` tokens
is one window of its own length, with fewer than 4 only without placeholders, so
an item of one word is in every document with that word; an item without tokens
never matches; windows in which placeholders outnumber words are no evidence,
but the same windows without placeholders are; repeated items match alike; rows that repeat a doc_id give a row for each item and
doc_id; a null doc_id is matched, and its row has a null doc_id; empty tables
give empty results; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm import spread as S

LENGTH = 8
SHORTEST = 4
#: What is a placeholder: numbers, units and names; numbers and units; nothing.
NAMES, NUMBERS, LITERAL = VIEWS = range(3)
ENOUGH = 6
BLOCK_BYTES = 8 << 20
#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l cl dl liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents usd eur gbp degree degrees mph kmh hz khz mhz ghz kb mb gb tb w kw v a"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95))

ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    ALNUM[ord(_a) : ord(_b) + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
POINT = np.zeros(256, bool)
POINT[[ord("."), ord(",")]] = True
#: Code points that are capital letters, of any script of the first plane.
UPPER = np.array([chr(c).isupper() for c in range(1 << 16)])
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:;\n\r\"|>([{"]] = True


def unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    off = np.concatenate([[0], np.cumsum([len(u) for u in raw])])
    return np.unique(K.Prefix(np.frombuffer(b"".join(raw), np.uint8), K.BYTE_BASE).spans(off[:-1], off[1:]))


def starts_upper(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the code point at each start is a capital letter (UTF-8 of one to three bytes)."""
    byte = [data[np.minimum(start + i, len(data) - 1)].astype(np.int32) for i in range(3)]
    lead = byte[0]
    two, three = ((lead & 0x1F) << 6) | (byte[1] & 0x3F), ((lead & 0x0F) << 12) | ((byte[1] & 0x3F) << 6) | (byte[2] & 0x3F)
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, 0)))
    return UPPER[point]


class Template:
    """Tokens of a run of documents: word (placeholder or hash), slot (the value's hash, 0 for a word), first (offsets by document)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, view: int, units: np.ndarray):
        flag = ALNUM[data]
        if len(data) > 2:
            digit = DIGIT[data]
            flag[1:-1] |= POINT[data[1:-1]] & digit[:-2] & digit[2:]
        start, end = K.bounds(flag, off)
        n = len(start)
        self.first = np.searchsorted(start, off)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        h = K.Prefix(K.LOWER[data], K.BYTE_BASE).spans(start, end)
        slot = np.zeros(n, np.uint64)
        if not n or view == LITERAL:
            self.word, self.slot = h, slot
            return
        inner = np.zeros(n, bool)
        inner[1:] = doc[1:] == doc[:-1]
        stops = np.concatenate([[0], np.cumsum(STOP[data], dtype=np.int64)])
        joined = inner.copy()
        joined[1:] &= stops[start[1:]] == stops[end[:-1]]
        number = DIGIT[data[start]]
        after = np.zeros(n, bool)
        after[1:] = number[:-1] & inner[1:]
        unit = after & np.isin(h, units) & ~number
        word = h.copy()
        word[number] = NUMBER
        word[unit] = UNIT
        slot[number | unit] = h[number | unit]
        keep = np.ones(n, bool)
        if view == NAMES:
            name = starts_upper(data, start) & joined & ~number & ~unit
            more = name.copy()
            more[1:] &= name[:-1]
            more[0] = False
            word[name] = NAME
            head = np.flatnonzero(name & ~more)
            if len(head):
                which = np.cumsum(name & ~more)[name] - 1
                total = np.zeros(len(head), np.uint64)
                np.add.at(total, which, h[name])
                slot[head] = total
            keep = ~more
        self.word, self.slot = word[keep], slot[keep]
        self.first = np.concatenate([[0], np.cumsum(keep)])[self.first]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows with as many words as placeholders at least."""
        at = K.inside(self.first, length)
        slots = np.concatenate([[0], np.cumsum(self.slot != 0)])
        at = at[2 * (slots[at + length] - slots[at]) <= length]
        return at, K.Prefix(self.word, K.WORD_BASE).spans(at, at + length)


def consistent(q: np.ndarray, length: int, diagonal: int, own: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, int]:
    """(the windows q of an alignment in which each slot value of the item has one value in the document, slots with another value)."""
    at = np.unique((q[:, None] + np.arange(length)).ravel())
    at = at[own[at] != 0]
    pairs, which, n = np.unique(np.stack([own[at], theirs[at + diagonal]], axis=1), axis=0, return_inverse=True, return_counts=True)
    same = pairs[:, 0] == pairs[:, 1]
    order = np.lexsort((~same, -n, pairs[:, 0]))
    holds = np.zeros(len(pairs), bool)
    holds[order[S.group_edges(pairs[order, 0])[:-1]]] = True
    if not holds.all():
        bad = at[~holds[which.ravel()]]
        q = q[np.searchsorted(bad, q) == np.searchsorted(bad, q + length)]
        at = at[np.isin(at, (q[:, None] + np.arange(length)).ravel())]
        pairs = np.unique(np.stack([own[at], theirs[at + diagonal]], axis=1), axis=0)
        same = pairs[:, 0] == pairs[:, 1]
    return q, int((~same).sum())


class Index:
    """Template windows of a block of the benchmark, sorted by hash, for all views."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [(text or "").encode() for _, text in items]
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.units = unit_hashes()
        self.views = []
        for view in VIEWS:
            t = Template(data, off, view, self.units)
            n = np.diff(t.first)
            lengths = np.unique(np.append(n[(n >= (1 if view == LITERAL else SHORTEST)) & (n < LENGTH)], LENGTH))
            found: dict[int, tuple] = {}
            total = np.zeros(len(items), np.int64)
            for length in lengths.tolist():
                at, h = t.windows(length)
                item = np.searchsorted(t.first, at, "right") - 1
                sel = n[item] >= LENGTH if length == LENGTH else n[item] == length
                at, h, item = at[sel], h[sel], item[sel]
                total += np.bincount(item, minlength=len(items))
                order = np.argsort(h, kind="stable")
                small = np.zeros(1 << 16, bool)
                small[(h >> np.uint64(48)).astype(np.int64)] = True
                found[length] = (small, h[order], at[order], item[order])
            self.views.append((view, t, found, total))

    def matches(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, windows matched, windows of the item, slots with another value)."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for view, own, found, total in self.views:
            t = Template(data, off, view, self.units)
            hits = []
            for length, (small, hashes, at, item) in found.items():
                p, h = t.windows(length)
                sel = small[(h >> np.uint64(48)).astype(np.int64)]
                p, h = p[sel], h[sel]
                lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                n = hi - lo
                rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hits.append((np.repeat(p, n), at[rows], item[rows], np.full(len(rows), length)))
            p, q, item, length = (np.concatenate(x) for x in zip(*hits, strict=True))
            if not len(p):
                continue
            doc = np.searchsorted(t.first, p, "right") - 1
            diagonal = p - q
            order = np.lexsort((p, diagonal, item, doc))
            p, q, item, length, doc, diagonal = (x[order] for x in (p, q, item, length, doc, diagonal))
            new = np.ones(len(p), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])
            edges = np.append(np.flatnonzero(new), len(p))
            matched: dict[tuple[int, int], list] = {}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                windows, changed = consistent(q[a:b], int(length[a]), int(diagonal[a]), own.slot, t.slot)
                if len(windows):
                    matched.setdefault((int(doc[a]), int(item[a])), []).append((windows, changed))
            for (d, i), parts in matched.items():
                n = len(np.unique(np.concatenate([x for x, _ in parts])))
                if n >= min(ENOUGH, -(-int(total[i]) // 2)):
                    now = (n, int(total[i]), max(x for _, x in parts))
                    best[d, i] = max(best.get((d, i), now), now)
        for (d, i), (n, total, changed) in sorted(best.items()):
            yield d, i, n, total, changed


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, slots_changed for each document that holds an item."""
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    schema = "doc_id long, item_id long, n_windows long, item_windows long, slots_changed long"
    fields = [x.split()[0] for x in schema.split(", ")]
    out = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else items
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in part.toLocalIterator()]))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for i, _, data, off in K.pieces(batch.column(1)):
                    rows = list(index.value.matches(data, off))
                    if rows:
                        d, item, n, total, changed = (np.array(x) for x in zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(d + i)), pa.array(index.value.ids[item]), *(pa.array(x.astype(np.int64)) for x in (n, total, changed))], fields)

        found = S.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), find, schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("slots_changed").alias("slots_changed"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item; rows without a doc_id stay."""
    bad = S.cut(leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
    return S.without(docs, bad)
