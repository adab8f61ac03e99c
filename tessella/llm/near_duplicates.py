"""MinHash near-dedup with HyperMinHash registers.

1. Every document becomes the set of its distinct k-word shingles (64-bit
   hashes). Equal sets, found by a 128-bit sum, collapse to their least doc_id.
2. Each of m hash functions keeps the least value over the set as a register
   of a leading-zero count (6 bits) and the 10 mantissa bits after the leading
   one. Bands of registers are hashed; documents that share a band are linked
   to the least document of the band, never pair by pair, and connected
   components of these links are the candidate clusters: every pair that shares
   a band lies in one cluster.
3. In a cluster, documents are searched breadth-first: registers estimate the
   Jaccard index, corrected for chance collisions; what comes within five
   standard deviations of the threshold is confirmed on the full sets. The
   confirmed links that connect the cluster are kept, and their components are
   the groups. A cluster beyond BLOCK documents is searched in pairs of blocks,
   so a task holds two blocks at most, whatever the size of the cluster.

A pair at the threshold shares no band with probability under 1e-4; a pair at
0.95 with probability under 1e-12.

Defined cases: a document without words has an empty set, and is linked with
nothing; with fewer than k words its whole sequence is the one shingle; a null
doc_id is linked with nothing and kept; rows that repeat a doc_id are one node;
ties go to the least doc_id; empty tables give empty results; other columns of
the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm import spread as S

MANTISSA = 10
#: Most documents of a cluster that one task compares with each other, or with as many more.
BLOCK = 4096
SIGMAS = 5.0


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows of a band): about 126 registers, with a miss at the threshold of under 1e-4."""
    for rows in (8, 7, 6, 5, 4, 3):
        bands = 126 // rows
        if (1 - threshold**rows) ** bands < 1e-4:
            return bands, rows
    return 63, 2


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by document) of the sorted distinct shingles."""
    n = len(off) - 1
    w = K.words(data, off, lower=True)
    seq = K.Prefix(w.hash, K.WORD_BASE)
    starts = K.inside(w.first, k)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    h = np.concatenate([seq.spans(starts, starts + k), seq.spans(w.first[short], w.first[short + 1])])
    doc = np.concatenate([w.doc[starts], short])
    order = np.argsort(h)
    order = order[np.argsort(doc[order].astype(np.uint32 if n >= 1 << 16 else np.uint16), kind="stable")]
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def registers(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """(documents with a set, m) registers of leading zeros and mantissa."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), m), np.uint64)
    a = K.salted(np.arange(m, dtype=np.uint64), 11) | np.uint64(1)
    b = K.salted(np.arange(m, dtype=np.uint64), 12)
    held = np.empty_like(h)
    for i in range(m):
        np.multiply(h, a[i], out=held)
        np.add(held, b[i], out=held)
        out[:, i] = np.minimum.reduceat(held, starts) if len(starts) else 0
    zeros = 63 - np.floor(np.log2(np.maximum(out, 1).astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 63).astype(np.uint64)
    rest = (out << zeros) << np.uint64(1)
    return ((zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = regs[:, : bands * rows].astype(np.uint64).reshape(len(regs), bands, rows) + np.uint64(1)
    c = K.salted(np.arange(rows, dtype=np.uint64), 13) | np.uint64(1)
    return K.mix((x * c).sum(axis=2, dtype=np.uint64) + K.salted(np.arange(bands, dtype=np.uint64), 14))


def corrected(agree: np.ndarray, n: np.ndarray, n0: int) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less the collisions expected by chance."""
    ratio = n / n0
    phi = 4 * ratio / (1 + ratio) ** 2
    c = 0.169919487159739 * 2.0**-MANTISSA * phi
    return np.clip((agree - c) / (1 - c), 0, 1)


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (the set's 128-bit sum), bands (binary)."""
    bands, rows = banding(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in K.pieces(batch.column(1)):
                h, first = shingle_sets(data, off, k)
                n = np.diff(first)
                some = np.flatnonzero(n)
                s1, s2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                keys: list[bytes | None] = [None] * (j - i)
                if len(some):
                    s1[some] = np.add.reduceat(h, first[some])
                    s2[some] = np.add.reduceat(K.salted(h, 5), first[some])
                    for at, row in zip(some, band_keys(registers(h, first, bands * rows), bands, rows), strict=True):
                        keys[at] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(keys, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "bands"]
                )

    return S.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, s1 long, s2 long, bands binary")


#: Of a set: its 128-bit sum and size; equal sets have equal ones.
KEY = ["s1", "s2", "n_shingles"]
BAND_FIELDS = {"key": "u8", "u": "i8", "v": "i8"}


def star(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first key, first doc, other doc, its first) of the groups of equal keys; the first is the least doc."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    edges = S.group_edges(key)
    size = np.diff(edges)
    lead = np.repeat(doc[edges[:-1]], size)
    other = doc != lead
    return key[edges[:-1]], doc[edges[:-1]], doc[other], lead[other]


def band_links(reps: DataFrame) -> DataFrame:
    """(u, v): documents u that share a band with the least document v of that band."""
    bits = S.bucket_bits(reps.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = S.Gather(BAND_FIELDS)

        def flush() -> Iterator[pa.RecordBatch]:
            x = held.take()
            key, doc, u, v = star(x["key"], x["u"])
            # links found here travel with a spread-out bucket, not with the key's
            yield from S.pack(
                np.concatenate([S.bucket_of(key, bits), S.bucket_of(K.mix(u.view(np.uint64).copy()), bits)]),
                {"key": np.concatenate([key, np.zeros(len(u), np.uint64)]), "u": np.concatenate([doc, u]), "v": np.concatenate([doc, v])},
            )

        for batch in batches:
            keys, _ = K.column_bytes(batch.column(1))
            _, off = K.column_bytes(batch.column(1))
            key = np.frombuffer(keys[off[0] : off[-1]].tobytes(), np.uint64)
            doc = np.repeat(batch.column(0).to_numpy(), np.diff(off) // 8)
            held.add(key.nbytes * 4, key=key, u=doc, v=doc)
            if held.bytes > S.FLUSH:
                yield from flush()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = S.Gather({"u": "i8", "v": "i8"})

        def flush() -> Iterator[pa.RecordBatch]:
            x = held.take()
            pair = np.unique(np.stack([x["u"], x["v"]], axis=1), axis=0)
            for i in range(0, len(pair), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[i : i + (1 << 16), c])) for c in (0, 1)], ["u", "v"])

        for x in S.each_bucket(batches, BAND_FIELDS):
            told = x["u"] != x["v"]
            _, _, u, v = star(x["key"][~told], x["u"][~told])
            held.add(16 * (len(u) + int(told.sum())), u=np.concatenate([u, x["u"][told]]), v=np.concatenate([v, x["v"][told]]))
            if held.bytes > S.FLUSH:
                yield from flush()
        yield from flush()

    packed = S.map_arrow(reps.select("doc_id", "bands"), emit, S.packed_schema(BAND_FIELDS))
    return S.map_arrow(S.by_bucket(packed), meet, "u long, v long").distinct()


def link(docs: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links (u, v) that connect all documents of a cluster with |A & B| * den >= |A | B| * num."""
    m = len(docs)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, ids = np.unique(flat, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    flag = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    t = num / den
    least = t - SIGMAS * math.sqrt(t * (1 - t) / regs.shape[1])
    open_ = np.arange(m)
    us, vs = [], []
    while len(open_):
        stack, open_ = [int(open_[0])], open_[1:]
        while stack and len(open_):
            p = stack.pop()
            near = open_[(np.minimum(size[open_], size[p]) * den >= np.maximum(size[open_], size[p]) * num)]
            if len(near):
                near = near[corrected((regs[near] == regs[p]).mean(axis=1), size[near], int(size[p])) >= least]
            if not len(near):
                continue
            mine = ids[first[p] : first[p + 1]]
            flag[mine] = True
            if len(near) * 4 > m:
                both = np.add.reduceat(flag[ids].astype(np.int64), first[:-1])[near]
            else:
                both = np.array([np.count_nonzero(flag[ids[first[x] : first[x + 1]]]) for x in near])
            flag[mine] = False
            ok = both * den >= (size[near] + size[p] - both) * num
            found = near[ok][np.argsort(both[ok], kind="stable")]
            us += [docs[found]]
            vs += [np.full(len(found), docs[p])]
            stack += found.tolist()  # the closest is next
            open_ = np.setdiff1d(open_, found, assume_unique=True)
    none = np.empty(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def groups_in_order(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal first columns, from batches sorted by them; holds one group."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(members: DataFrame, cluster: str, block: int) -> DataFrame:
    """members with _p, _q: pairs of blocks of the cluster, one pair (0, 0) for a cluster of one block."""
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    nb = F.ceil(F.col("_n") / block).cast("int")
    x = members.join(sizes, cluster).withColumn("_nb", nb).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_nb")).cast("int"))
    return (
        x.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("_p", F.least("_b", "_j"))
        .withColumn("_q", F.greatest("_b", "_j"))
        .drop("_n", "_nb", "_b", "_j")
    )


def confirm(docs: DataFrame, clusters: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(u, v) links confirmed on full sets; clusters: node, component."""
    bands, rows = banding(num / den)
    wanted = S.bloom(clusters, "node")
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(S.in_bloom(bits.value, batch.column(0).to_numpy())))
            for i, j, data, off in K.pieces(batch.column(1)):
                h, first = shingle_sets(data, off, k)
                some = np.flatnonzero(np.diff(first))
                regs = registers(h, first, bands * rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(some)), pa.array([h[first[x] : first[x + 1]].tobytes() for x in some], pa.binary()), pa.array([x.tobytes() for x in regs], pa.binary())], ["node", "shingles", "registers"]
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, 3):
            if group.num_rows < 2:
                continue
            node = group.column("node").to_numpy()
            held = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
            regs = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in group.column("registers")])
            order = np.argsort(node, kind="stable")
            u, v = link(node[order], [held[x] for x in order], regs[order], num, den)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    found = S.map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), sets, "node long, shingles binary, registers binary")
    # the small side first meets the sets, then both travel to their cluster's block pairs
    pairs = in_blocks(clusters, "component", BLOCK)
    x = found.join(pairs, "node").select("component", "_p", "_q", "node", "shingles", "registers")
    x = x.repartition(S.parts(docs.sparkSession), "component", "_p", "_q").sortWithinPartitions("component", "_p", "_q")
    return S.map_arrow(x, verify, "u long, v long").distinct()


def near_groups(docs: DataFrame, k: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    sig = S.cut(signatures(docs, k, num / den))
    whole = sig.where("doc_id is not null and n_shingles > 0")
    # only groups of copies are joined back; as a table of their own they leave the join free to split a hot group
    same = S.cut(whole.groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    copies = S.cut(whole.select("doc_id", *KEY).join(same, KEY).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"), *KEY))
    # a doc_id of several texts loses only those that are copies
    reps = whole.join(copies.select(F.col("u").alias("doc_id"), *KEY), ["doc_id", *KEY], "left_anti")
    clusters = S.cut(S.components(S.cut(band_links(reps))))
    links = S.cut(confirm(docs, clusters, k, num, den))
    groups = S.components(links.unionByName(copies.select("u", "v")))
    out = sig.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group at a similarity of 0.8 or more the least doc_id stays; equal rows stay once."""
    gone = S.cut(near_groups(docs, 5, 80, 100).where("not kept").select("doc_id").distinct())
    left = S.without(docs, gone)
    if docs.select("doc_id").where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        named = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        left = named.unionByName(left.where("doc_id is null"))
    return left
