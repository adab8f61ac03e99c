"""Line dedup as an exact set-similarity join.

A line is the set of its distinct words; a line goes if an earlier line, in the
order of (doc_id, line number), has a Jaccard index of num/den or more with it.
Lines are judged on the input, so a line that goes itself still counts as the
earlier one.

1. Word frequencies are counted over all rows into 2^23 counters (16 bits each), of a fixed
   size whatever the corpus; words are ordered by (counter, hash), one order for
   all lines, rare words first.
2. Each line sends its prefix: the s - ceil(t s) + 1 rarest of s words, with its
   size, the word's position and a 128-bit parity map of all its words. A task
   first drops lines that equal an earlier one of its own, so a line that every
   document has costs one entry a task.
3. Where lines meet under a word, the length filter, the positional filter and
   the parity maps (which bound the symmetric difference from below, so no true
   pair is lost) leave candidates. They are linked into clusters, not listed in
   pairs.
4. In a cluster full sets decide: each line is compared with earlier ones until
   one is found. Clusters over BLOCK lines are compared in pairs of blocks.

Defined cases: null text has no lines; lines without words stay (`least`, the
fewest distinct words of a line that is looked at, is 1); a null doc_id keeps its lines and removes none; rows that repeat a
doc_id share their positions, so they don't remove each other, and a position
that goes goes in both; a document that loses all its words goes from the
pipeline; empty tables give empty results; other columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm import spread as S
from tessella.llm.near_duplicates import groups_in_order, in_blocks

COUNTERS = 1 << 23
FIELDS = {"key": "u8", "doc": "i8", "line": "u4", "size": "u4", "pos": "u4", "b1": "u8", "b2": "u8"}
#: Lists of lines under one word that are longer are first searched from a few of their lines.
PAIRED = 256
#: Bytes of text whose entries a task holds here; their sorting and packing takes eight times as much.
FLUSH = 12 << 20
PAIRS = 1 << 19
BLOCK = 8192


def counters(docs: DataFrame) -> np.ndarray:
    """Occurrences of words by hash slot, up to 65535: 16 MB, however large the corpus."""
    block = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        held: list[np.ndarray] = []
        size = 0

        def settle() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=COUNTERS).astype(np.uint32)
                held.clear()

        for batch in batches:
            for _, _, data, off in K.pieces(batch.column(0)):
                held.append((K.words(data, off).hash & np.uint64(COUNTERS - 1)).astype(np.int32))
                size += len(data)
                if size > FLUSH:
                    settle()
                    size = 0
        settle()
        grid = total.reshape(-1, block)
        some = np.flatnonzero(grid.any(axis=1))
        if len(some):
            yield from S.pack(some, {"n": np.array([grid[i].tobytes() for i in some], f"V{block * 4}")})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64)
                grid[b] = grid[b] + now if b in grid else now
        for b, n in grid.items():
            yield from S.pack(np.array([b]), {"n": np.array([np.minimum(n, 0xFFFF).astype(np.uint16).tobytes()], f"V{block * 2}")})

    out = np.zeros((COUNTERS // block, block), np.uint16)
    packed = S.map_arrow(docs.select("text"), count, "bucket int, n binary")
    for row in S.map_arrow(S.by_bucket(packed), add, "bucket int, n binary").toLocalIterator():
        out[row["bucket"]] = np.frombuffer(row["n"], np.uint16)
    S.give_back()
    S.give_back()
    return out.reshape(-1)


def in_lines(line: np.ndarray, first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Order by (line, first, then), first of 40 bits at most; `then` is only looked at where the others tie."""
    number = np.cumsum(np.concatenate([[0], line[1:] != line[:-1]])).astype(np.uint64) if len(line) else line.astype(np.uint64)
    key = (number << np.uint64(40)) | first
    order = np.argsort(key)
    k, t = key[order], then[order]
    if ((k[1:] == k[:-1]) & (t[1:] != t[:-1])).any():
        order = np.lexsort((then, key))
    return order


class Lines:
    """The lines of a run of documents that have enough distinct words: doc (index), line number, size, words in order of rarity.

    Without rarity the words are in the order of their hashes. wanted(doc, line)
    tells which lines are looked at.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, rarity: np.ndarray | None, least: int, wanted=None):
        w = K.words(data, off)
        breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
        line, word, doc = breaks[w.start] + w.doc, w.hash, w.doc  # a document's end ends a line
        if wanted is not None:
            edges = S.group_edges(line)
            d = doc[edges[:-1]]
            ok = np.repeat(wanted(d, line[edges[:-1]] - d - breaks[off[d]]), np.diff(edges))
            line, word, doc = line[ok], word[ok], doc[ok]
        if rarity is None:
            order = in_lines(line, word >> np.uint64(24), word)
        else:
            order = in_lines(line, (rarity[(word & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(24)) | (word >> np.uint64(40)), word)
        line, word, doc = line[order], word[order], doc[order]
        if len(line):
            new = np.ones(len(line), bool)
            new[1:] = (line[1:] != line[:-1]) | (word[1:] != word[:-1])
            line, word, doc = line[new], word[new], doc[new]
        edges = S.group_edges(line)
        size = np.diff(edges)
        enough = size >= least
        self.word = word[np.repeat(enough, size)]
        at = edges[:-1][enough]
        self.size = size[enough]
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.doc = doc[at]
        self.line = line[at] - self.doc - breaks[off[self.doc]]


def node_of(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return K.mix(K.salted(doc.astype(np.int64).view(np.uint64), 31) + line.astype(np.uint64)).view(np.int64)


def prefixes(docs: DataFrame, rarity: np.ndarray, num: int, den: int, least: int) -> DataFrame:
    """Packed: the prefix words of the lines; size 0 marks lines that equal an earlier line of the task."""
    table, bits = docs.sparkSession.sparkContext.broadcast(rarity), S.bucket_bits(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = S.Gather({"key": "u8", "pos": "u4", "of": "i8"})
        kept = S.Gather({"doc": "i8", "line": "u4", "size": "u4", "b1": "u8", "b2": "u8", "s1": "u8", "s2": "u8"})
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            count = 0
            x, e = kept.take(), held.take()
            order = np.lexsort((x["line"], x["doc"], x["s2"], x["s1"]))
            s1, s2, doc = x["s1"][order], x["s2"][order], x["doc"][order]
            first = np.ones(len(order), bool)
            first[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
            place = doc if not len(doc) else np.stack([doc, x["line"][order].astype(np.int64)], axis=1)
            # an equal line at the same position is a repeated row, and not an earlier line
            lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            own = (place == place[lead]).all(axis=1) if len(doc) else first
            gone = np.zeros(len(order), bool)
            gone[order] = ~first & ~own
            again = np.zeros(len(order), bool)
            again[order] = ~first & own
            e_sel = ~(gone | again)[e["of"]]
            of = e["of"][e_sel]
            g = np.flatnonzero(gone)
            spread = K.mix(x["doc"][g].view(np.uint64).copy())
            zero = np.zeros(len(g), np.uint64)
            cols = {
                "key": np.concatenate([e["key"][e_sel], spread]),
                "doc": np.concatenate([x["doc"][of], x["doc"][g]]),
                "line": np.concatenate([x["line"][of], x["line"][g]]),
                "size": np.concatenate([x["size"][of], zero.astype(np.uint32)]),
                "pos": np.concatenate([e["pos"][e_sel], zero.astype(np.uint32)]),
                "b1": np.concatenate([x["b1"][of], zero]),
                "b2": np.concatenate([x["b2"][of], zero]),
            }
            yield from S.pack(S.bucket_of(cols["key"], bits), cols)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, data, off in K.pieces(batch.column(1)):
                x = Lines(data, off, table.value, least)
                n = len(x.size)
                if not n:
                    continue
                at = x.first[:-1]
                bit = np.uint64(1) << (x.word & np.uint64(63))
                half = (x.word >> np.uint64(6)) & np.uint64(1) == 0
                length = x.size - -(-num * x.size // den) + 1
                of = np.repeat(np.arange(n), length)
                pos = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
                held.add(len(data), key=x.word[at[of] + pos], pos=pos.astype(np.uint32), of=of + count)
                kept.add(
                    0,
                    doc=ids[i:j][x.doc],
                    line=x.line.astype(np.uint32),
                    size=x.size.astype(np.uint32),
                    b1=np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), at),
                    b2=np.bitwise_xor.reduceat(np.where(half, np.uint64(0), bit), at),
                    s1=np.add.reduceat(x.word, at),
                    s2=np.add.reduceat(K.salted(x.word, 33), at),
                )
                count += n
                if held.bytes > FLUSH:
                    yield from flush()
        yield from flush()

    return S.map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), emit, S.packed_schema(FIELDS))


def candidates(x: dict[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of entries, sorted by (key, size), whose lines may be similar; enough of them to connect all that are.

    Of two similar lines the smaller (the earlier here) shares one of its
    s - ceil(2t/(1+t) s) + 1 rarest words, its index prefix, with the prefix of
    the other. So an entry's partners are the index entries before it in its
    group, from the least size that can match.
    """
    size, pos = x["size"].astype(np.int64), x["pos"].astype(np.int64)
    b1, b2 = x["b1"], x["b2"]
    rest = size - pos
    edges = S.group_edges(x["key"])
    group = np.diff(edges)
    rank = np.repeat(np.arange(len(group)), group)
    indexed = pos < size - -(-2 * num * size // (num + den)) + 1

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where the pair passes the positional filter and the bound of the parity maps."""
        both = size[i] + size[j]
        need = -(-num * both // (num + den))
        ok = np.flatnonzero((rest[i] >= need) & (rest[j] >= need))
        a, b = i[ok], j[ok]
        far = np.bitwise_count(b1[a] ^ b1[b]).astype(np.int64) + np.bitwise_count(b2[a] ^ b2[b])
        return ok[far <= (both - 2 * need)[ok]]

    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # in long lists of like lines a few of them, asked first, settle most: what they find needs no partners of its own
    probe = np.ones(len(size), bool)
    for g in np.flatnonzero(group > PAIRED):
        open_ = np.arange(edges[g], edges[g + 1])
        stack = [int(open_[len(open_) // 2])]
        asked = 0
        while stack and len(open_) > PAIRED and asked < 16:
            p = stack.pop()
            asked += 1
            fit = open_[(np.minimum(size[open_], size[p]) * den >= np.maximum(size[open_], size[p]) * num) & (open_ != p)]
            found = fit[may(fit, np.full(len(fit), p))]
            if len(found) * 20 < len(open_):
                continue
            us.append(found)
            vs.append(np.full(len(found), p))
            probe[found] = False
            far = np.bitwise_count(b1[found] ^ b1[p])
            stack += found[np.argsort(-far.astype(np.int64), kind="stable")].tolist()
            open_ = np.setdiff1d(open_, found, assume_unique=True)
    # pairs with at least one line that is not settled
    pool = np.flatnonzero(indexed)
    place = (rank[pool] << 32) + size[pool]

    def pairs(entry: np.ndarray, pool: np.ndarray, place: np.ndarray, after: bool) -> None:
        """Partners in the pool before (or, after: behind) each entry, block by block."""
        if after:
            low = np.searchsorted(pool, entry, "right")
            high = np.searchsorted(place, (rank[entry] << 32) + size[entry] * den // num, "right")
        else:
            low = np.searchsorted(place, (rank[entry] << 32) + -(-num * size[entry] // den))
            high = np.searchsorted(pool, entry)
        n = np.maximum(high - low, 0)
        total = np.cumsum(n)
        at = 0
        while at < len(entry):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            m = n[at:to]
            i = np.repeat(entry[at:to], m)
            j = pool[np.repeat(low[at:to], m) + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)]
            ok = may(i, j)
            us.append(i[ok])
            vs.append(j[ok])
            at = to

    pairs(np.flatnonzero(probe & np.repeat(group > 1, group)), pool, place, False)
    done = np.flatnonzero(~probe)
    if len(done):  # open index entries may be the smaller line of a settled one
        pairs(np.flatnonzero(probe & indexed & np.isin(rank, rank[done])), done, (rank[done] << 32) + size[done], True)
    return np.concatenate(us), np.concatenate(vs)


def met(packed: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: links between lines that may be similar; or doc, line: lines known to go."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in S.each_bucket(batches, FIELDS):
            told = x["size"] == 0
            gone = {c: x[c][told] for c in ("doc", "line")}
            x = {c: v[~told] for c, v in x.items()}
            order = np.lexsort((x["size"], x["key"]))
            x = {c: v[order] for c, v in x.items()}
            a, b = candidates(x, num, den)
            node, inverse = np.unique(node_of(x["doc"], x["line"])[np.concatenate([a, b])], return_inverse=True)
            label = S.roots(inverse[: len(a)], inverse[len(a) :], len(node))
            u, v = node, node[label]
            sel = u != v
            u, v, none = u[sel], v[sel], len(gone["doc"])
            cols = [
                pa.concat_arrays([pa.array(u), pa.nulls(none, pa.int64())]),
                pa.concat_arrays([pa.array(v), pa.nulls(none, pa.int64())]),
                pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(gone["doc"])]),
                pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(gone["line"].astype(np.int64))]),
            ]
            out = pa.RecordBatch.from_arrays(cols, ["u", "v", "doc_id", "line"])
            for i in range(0, out.num_rows, 1 << 16):
                yield out.slice(i, 1 << 16)

    return S.map_arrow(S.by_bucket(packed), meet, "u long, v long, doc_id long, line long")


def later_lines(doc: np.ndarray, line: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which lines have an earlier line that is similar enough; all of one cluster."""
    order = np.lexsort((line, doc))
    sets = [sets[i] for i in order]
    d, ln = doc[order], line[order]
    n = len(order)
    gone = np.zeros(n, bool)
    seen: dict[bytes, int] = {}
    pivots = []
    for i, s in enumerate(sets):
        at = seen.setdefault(s.tobytes(), i)
        if at == i:
            pivots.append(i)
        elif (d[at], ln[at]) != (d[i], ln[i]):
            gone[i] = True
    pivots = np.array(pivots)
    size = np.array([len(sets[i]) for i in pivots], np.int64)
    if len(pivots) > 1:
        flat, ids = np.unique(np.concatenate([sets[i] for i in pivots]), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(size)])
        flag = np.zeros(len(flat), bool)
        open_ = np.arange(1, len(pivots))
        for p in range(len(pivots) - 1):
            open_ = open_[open_ > p]
            near = open_[np.minimum(size[open_], size[p]) * den >= np.maximum(size[open_], size[p]) * num]
            if not len(near):
                if not len(open_):
                    break
                continue
            mine = ids[first[p] : first[p + 1]]
            flag[mine] = True
            if len(near) * 4 > len(pivots):
                both = np.add.reduceat(flag[ids].astype(np.int64), first[:-1])[near]
            else:
                both = np.array([np.count_nonzero(flag[ids[first[x] : first[x + 1]]]) for x in near])
            flag[mine] = False
            found = near[both * den >= (size[near] + size[p] - both) * num]
            found = found[(d[pivots[found]] != d[pivots[p]]) | (ln[pivots[found]] != ln[pivots[p]])]
            gone[pivots[found]] = True
            open_ = np.setdiff1d(open_, found, assume_unique=True)
    out = np.zeros(n, bool)
    out[order] = gone
    return out


def decided(docs: DataFrame, clusters: DataFrame, num: int, den: int, least: int) -> DataFrame:
    """(doc_id, line) of the lines of clusters that go."""
    bits = docs.sparkSession.sparkContext.broadcast(S.bloom(clusters, "node"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, data, off in K.pieces(batch.column(1)):
                own = ids[i:j]
                x = Lines(data, off, None, least, lambda d, n, own=own: S.in_bloom(bits.value, node_of(own[d], n)))
                doc = own[x.doc]
                held = [x.word[a:b].tobytes() for a, b in zip(x.first[:-1], x.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node_of(doc, x.line)), pa.array(doc), pa.array(x.line), pa.array(held, pa.binary())], ["node", "doc_id", "line", "words"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, 3):
            if group.num_rows < 2:
                continue
            doc, line = group.column("doc_id").to_numpy(), group.column("line").to_numpy()
            gone = later_lines(doc, line, [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("words")], num, den)
            if gone.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(line[gone])], ["doc_id", "line"])

    found = S.map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), sets, "node long, doc_id long, line long, words binary")
    x = found.join(in_blocks(clusters, "component", BLOCK), "node").select("component", "_p", "_q", "doc_id", "line", "words")
    x = x.repartition(S.parts(docs.sparkSession), "component", "_p", "_q").sortWithinPartitions("component", "_p", "_q")
    return S.map_arrow(x, verify, "doc_id long, line long")


def repeated_lines(docs: DataFrame, num: int = 4, den: int = 5, least: int = 1) -> DataFrame:
    """(doc_id, lines): the numbers, from 0, of the lines of each document that go; documents that lose none are absent."""
    rarity = counters(docs)
    first = S.cut(met(prefixes(docs, rarity, num, den, least), num, den))
    clusters = S.cut(S.components(first.where("u is not null").select("u", "v")))
    told = first.where("doc_id is not null").select("doc_id", "line")
    gone = told.unionByName(decided(docs, clusters, num, den, least))
    return S.cut(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines")))


def report(docs: DataFrame, num: int = 4, den: int = 5, least: int = 1) -> DataFrame:
    """Per document: doc_id, n_lines (newline-split, null text none), n_removed, removed_lines."""
    gone = repeated_lines(docs, num, den, least)
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"))
    x = lines.join(gone, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    return x.select("doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("lines", none).alias("removed_lines"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the lines that go, n_chars to match; documents that lose all their words go.

    The row travels whole in a column of its own, so no name of documents clashes with ours.
    """
    gone = repeated_lines(docs)
    x = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"))
    # texts are met by doc_id in a merge join at every size: the lists of lines have no small bound
    x = x.join(gone.hint("merge"), "doc_id", "left")
    # the lines between those that go, piece by piece: linear in the text, which is split once
    once = lambda value, f: F.flatten(F.transform(F.array(value), f))
    after = lambda stops, i: F.when(i == 0, 0).otherwise(F.get(stops, i - 1) + 1).cast("int")
    pieces = lambda lines, stops: F.flatten(F.transform(stops, lambda b, i: F.slice(lines, after(stops, i) + 1, b.cast("int") - after(stops, i))))
    kept = once(F.split("row.text", "\n"), lambda lines: once(F.concat("lines", F.array(F.size(lines).cast("long"))), lambda stops: pieces(lines, stops)))
    left = F.array_join(kept, "\n")
    x = x.select("row", F.col("lines").isNull().alias("same"), F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(left).alias("left"))
    x = x.where(F.col("same") | F.col("left").rlike(r"[^\x20\t-\r]"))
    own = {"text": F.col("left"), "n_chars": F.when(F.col("same"), F.col("row.n_chars")).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return x.select(*[(own[c] if c in own else F.col("row")[c]).alias(c) for c in docs.columns])
