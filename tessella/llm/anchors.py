"""Which content-defined anchors of the documents also occur in another document.

An anchor is the least k-unit gram (by hash) of some window of `length` units.
Equal windows have equal anchors, so a window that occurs in two documents has
an anchor that does; only about 2 of (length - k + 2) grams are anchors, so this
finds where repeats can be at a fraction of what shuffling all windows costs.

An anchor's documents meet in the bucket of its hash. A task first merges its
own: of the documents of a task with one anchor only the least goes to that
bucket, and the others, known to repeat, travel by a hash of their own. So a
passage that a third of all documents share costs its bucket one entry a task.
Answers go back packed by `group`, a residue of doc_id, with which the text is
met again.

Short grams are alike by chance, the more the larger the corpus is. With sides an
entry also has hashes of two bytes of what stands before and after its anchor, half
of what a window has besides it: of two equal windows one side at least is alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm import spread as S
from tessella.session import ship

FIELDS = {"key": "u8", "doc": "i8", "kind": "u1"}
SIDES = FIELDS | {"near": "u4"}
REPLY = {"doc": "i8", "key": "u8"}
#: Documents of a group, about.
GROUP_ROWS = 1000

Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def groups_for(docs: DataFrame) -> int:
    """A prime number of groups of about GROUP_ROWS documents."""
    n = max(docs.count() // GROUP_ROWS, 13)
    while any(n % i == 0 for i in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def with_group(docs: DataFrame, groups: int) -> DataFrame:
    own = F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(groups)), F.pmod(F.xxhash64("text"), F.lit(groups)))  # rows without a doc_id are spread
    return docs.select(own.cast("int").alias("bucket"), F.col("doc_id").cast("long"), "text")


def once(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries of a task without repeats, the least document of each key first (kind 1 if it has company, whose kind is 2)."""
    order = np.lexsort((x["doc"], x["key"]))
    key, doc = x["key"][order], x["doc"][order]
    if len(key):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
    edges = S.group_edges(key)
    size = np.diff(edges)
    kind = np.full(len(key), 2, np.uint8)
    kind[edges[:-1]] = size > 1
    return {"key": key, "doc": doc, "kind": kind}


def alike(key: np.ndarray, near: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry whether one of another document has its key and a side like its own, and whether it is the first with its key and a side."""
    company, first = np.zeros(len(key), bool), np.zeros(len(key), bool)
    for side in (near & np.uint32(0xFFFF), (near >> np.uint32(16)) + np.uint32(1 << 16)) if len(key) else ():
        own = K.mix(key ^ K.salted(side.astype(np.uint64), 73))
        order = np.argsort(own)
        edges = S.group_edges(own[order])
        held = doc[order]
        several = np.minimum.reduceat(held, edges[:-1]) != np.maximum.reduceat(held, edges[:-1])
        company[order] |= np.repeat(several, np.diff(edges))
        first[np.minimum.reduceat(order, edges[:-1])] = True
    return company, first


def shared(key: np.ndarray) -> np.ndarray:
    """Which entries have a key that another has."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def once_by_side(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """As once, with sides: the first entry of each key and side stands for those like it."""
    several = shared(x["key"])
    alone, x = {k: v[~several] for k, v in x.items()}, {k: v[several] for k, v in x.items()}
    order = np.argsort(x["doc"], kind="stable")
    x = {k: v[order] for k, v in x.items()}
    company, first = alike(x["key"], x["near"], x["doc"])
    # the others of one document only, whose first ones are its own, tell nothing more
    keep = company | first
    kind = np.where(first, company, 2).astype(np.uint8)
    out = {k: np.concatenate([alone[k], v[keep]]) for k, v in x.items()}
    return {"key": out["key"], "doc": out["doc"], "kind": np.concatenate([np.zeros(len(alone["key"]), np.uint8), kind[keep]]), "near": out["near"]}


def repeated(docs: DataFrame, grams: Units, groups: int, piece: int = K.CHUNK, sides: bool = False) -> DataFrame:
    """Packed by group: (doc, key) of each anchor that occurs in two documents or more.

    grams(data, off) gives (keys of the anchors, index of the document of each),
    from `piece` bytes of text at a time; with sides also the hashes of both sides of each.
    """

    bits = S.bucket_bits(docs.sparkSession)
    fields = SIDES if sides else FIELDS

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = S.Gather({k: fields[k] for k in fields if k != "kind"})

        def flush() -> Iterator[pa.RecordBatch]:
            x = (once_by_side if sides else once)(held.take())
            # keys are minima, and so mostly small: another hash of them deals them out evenly
            spread = np.where(x["kind"] == 2, K.mix(x["doc"].view(np.uint64).copy()), K.salted(x["key"], 61))
            yield from S.pack(S.bucket_of(spread, bits), x)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, data, off in K.pieces(batch.column(1), piece):
                key, doc, *near = grams(data, off)
                held.add(len(data), key=key, doc=ids[i:j][doc], **({"near": near[0]} if sides else {}))
                if held.bytes > S.FLUSH:
                    yield from flush()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = S.Gather(REPLY)
        for x in S.each_bucket(batches, fields):
            told = x["kind"] == 2
            key, doc, kind = (x[c][~told] for c in FIELDS)
            if sides:
                sel, several = kind == 1, np.flatnonzero(shared(key))
                sel[several] |= alike(key[several], x["near"][~told][several], doc[several])[0]
            else:
                order = np.argsort(key, kind="stable")
                key, doc, kind = key[order], doc[order], kind[order]
                edges = S.group_edges(key)
                size = np.diff(edges)
                hot = size > 1
                if len(key):
                    hot |= np.maximum.reduceat(kind, edges[:-1]) == 1
                sel = np.repeat(hot, size)
            doc, key = np.concatenate([doc[sel], x["doc"][told]]), np.concatenate([key[sel], x["key"][told]])
            held.add(doc.nbytes * 2, doc=doc, key=key)
            if held.bytes > S.FLUSH:
                y = held.take()
                yield from S.pack(np.mod(y["doc"], groups), y)
        y = held.take()
        yield from S.pack(np.mod(y["doc"], groups), y)

    packed = S.map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), emit, S.packed_schema(fields))
    return S.map_arrow(S.by_bucket(packed), meet, S.packed_schema(REPLY))


def meet_text(docs: DataFrame, groups: int, replies: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str, cycles: int = 2) -> DataFrame:
    """f(rows of a group: bucket, doc_id, text; packed replies to it), for every group; cycles: see spread.give_back."""
    ship(docs.sparkSession)

    def tidy(rows: pa.Table, told: pa.Table) -> pa.Table:
        out = f(rows, told)
        S.give_back(cycles)
        return out

    return with_group(docs, groups).groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(tidy, schema)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array known."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def ids_of(table: pa.Table) -> np.ndarray:
    """doc_id as numpy; null is the least long, which never has an answer."""
    return table.column("doc_id").fill_null(-(1 << 63)).to_numpy()


def with_id(rows: pa.Table) -> pa.Table:
    """The rows that have a doc_id: the others neither remove nor lose anything."""
    return rows.filter(rows.column("doc_id").is_valid())


def as_table(batches: Iterator[pa.RecordBatch], fields: dict[str, str]) -> pa.Table:
    schema = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in fields)])
    return pa.Table.from_batches([b.cast(schema) for b in batches], schema)
