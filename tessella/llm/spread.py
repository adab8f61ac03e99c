"""How work and small answers travel: scratch tables, packed shuffles, Bloom filters, components.

Packed shuffles: a task gathers its entries (keys and what belongs to them) as
numpy columns and emits one row for each bucket of the key space, so a shuffle
moves a few wide rows of binary columns, not millions of narrow ones.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import ship

#: log2 of the buckets of a packed shuffle, at least.
BUCKET_BITS = 10
#: Bytes of text whose entries a task holds before it emits them.
FLUSH = 32 << 20
BLOOM_BITS = 1 << 26

_made: dict[str, list[str]] = {}


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset on one machine (tests) a folder of our own; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(spark.sparkContext, "_tessella_folder", None) or tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext._tessella_folder = at
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it again: a lost executor later costs a read, not the lineage.

    The shuffle files behind it are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessella-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessella-" in path:
            remove(spark, path)


def _forget() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _made.get(spark.sparkContext.applicationId, []):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch
            return


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(tidy(f), schema)


def tidy(f):
    """f, and its memory is given back at the end of the task."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


# packed shuffles ----------------------------------------------------------


def packed_schema(fields: dict[str, str]) -> str:
    return ", ".join(["bucket int", *(f"{k} binary" for k in fields)])


def pack(bucket: np.ndarray, fields: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that has entries."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16 if bucket.max() < 1 << 16 else np.uint32), kind="stable")
    b = bucket[order]
    cut_at = np.flatnonzero(np.diff(b)) + 1
    edges = np.concatenate([[0], cut_at, [len(b)]])
    cols = {k: np.ascontiguousarray(v[order]) for k, v in fields.items()}
    for lo in range(0, len(edges) - 1, 256):
        hi = min(lo + 256, len(edges) - 1)
        rows = [pa.array(b[edges[lo:hi]].astype(np.int32))]
        rows += [pa.array([v[edges[i] : edges[i + 1]].tobytes() for i in range(lo, hi)], pa.binary()) for v in cols.values()]
        yield pa.RecordBatch.from_arrays(rows, ["bucket", *fields])


def unpack(batches: Iterable[pa.RecordBatch | pa.Table], fields: dict[str, str]) -> dict[str, np.ndarray]:
    """All entries of packed rows, joined."""
    held: dict[str, list[np.ndarray]] = {k: [] for k in fields}
    for batch in batches:
        for k, dtype in fields.items():
            column = batch.column(batch.schema.get_field_index(k))
            for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
                held[k] += [np.frombuffer(x.as_buffer(), dtype) for x in chunk]
    return {k: np.concatenate(v) if v else np.empty(0, dtype) for (k, dtype), v in zip(fields.items(), held.values(), strict=True)}


class Gather:
    """Entries of several runs of documents, held until they are worth a flush."""

    def __init__(self, fields: dict[str, str]):
        self.fields = fields
        self.clear()

    def clear(self) -> None:
        self.held: dict[str, list[np.ndarray]] = {k: [] for k in self.fields}
        self.bytes = 0

    def add(self, size: int, /, **columns: np.ndarray) -> None:
        self.bytes += size
        for k, v in columns.items():
            self.held[k].append(v)

    def take(self) -> dict[str, np.ndarray]:
        out = {k: np.concatenate(v) if v else np.empty(0, self.fields[k]) for k, v in self.held.items()}
        self.clear()
        return out


def by_bucket(df: DataFrame) -> DataFrame:
    """All rows of a bucket in one partition, one bucket after the other."""
    return df.repartition(parts(df.sparkSession), "bucket").sortWithinPartitions("bucket")


def each_bucket(batches: Iterable[pa.RecordBatch], fields: dict[str, str]) -> Iterator[dict[str, np.ndarray]]:
    """The entries of one bucket after the other, from rows in the order of by_bucket; holds one bucket."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        at = 0
        while at < len(bucket):
            to = int(np.searchsorted(bucket, bucket[at], "right"))
            if held and bucket[at] != last:
                yield unpack(held, fields)
                held = []
            last = bucket[at]
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield unpack(held, fields)


def give_back(cycles: int = 2) -> None:
    """Return freed memory of this Python worker to the system; workers are used again by later stages.

    Looking for cycles in all generations (2) takes some 60 ms, which is long for each of many groups.
    """
    gc.collect(cycles)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        return


def bucket_bits(spark: SparkSession) -> int:
    """log2 of the buckets: two for each shuffle partition at least, so they grow with what the cluster is set to."""
    return max(BUCKET_BITS, (2 * parts(spark) - 1).bit_length())


def bucket_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def group_edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Edges of the runs of equal values, with 0 and the length."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


# Bloom filters ------------------------------------------------------------


def bloom_places(ids: np.ndarray) -> list[np.ndarray]:
    from tessella.llm.kernels import salted

    x = ids.astype(np.int64).view(np.uint64)
    return [(salted(x, 71 + i) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for i in range(3)]


def bloom(df: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size (8 MB) of a column of longs; more rows make it less selective, never wrong."""
    block = 1 << 16  # bytes

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            for at in bloom_places(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        grid = bits.reshape(-1, block)
        some = np.flatnonzero(grid.any(axis=1))
        yield from pack(some, {"bits": np.array([grid[i].tobytes() for i in some], f"V{block}")}) if len(some) else ()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = np.frombuffer(bits.as_buffer(), np.uint8)
                grid[b] = grid[b] | now if b in grid else now
        yield from pack(np.array(list(grid), np.int64), {"bits": np.array([x.tobytes() for x in grid.values()], f"V{block}")}) if grid else ()

    one = map_arrow(df.select(F.col(column).cast("long")).na.drop(), build, "bucket int, bits binary")
    bits = np.zeros((BLOOM_BITS // 8 // block, block), np.uint8)
    for row in map_arrow(by_bucket(one), merge, "bucket int, bits binary").toLocalIterator():
        bits[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    give_back()
    return bits.reshape(-1)


def in_bloom(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for at in bloom_places(ids):
        ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return ok


#: Ids up to this number (8 MB) travel as a broadcast, more in a shuffled join.
BROADCAST_IDS = 1 << 20


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in gone (a scratch table of distinct doc_id); all of their columns."""
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


# connected components -----------------------------------------------------

LOCAL_EDGES = 1 << 20


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Component label, the least node, of each of n nodes under edges (u, v)."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v) of a partition."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not held:
        return
    node, place = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    u, v = place.reshape(2, -1)
    out = node[roots(u, v, len(node))]
    for i in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(out[i : i + (1 << 16)])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of (u, v) edges can reach.

    Up to LOCAL_EDGES edges (16 MB) are settled by one task's union-find. More
    take alternating large-star and small-star rounds: each node's least neighbour
    is a partially aggregated minimum and a table of its own, so the join with it
    can split a hub's edges. Rounds are cut by scratch tables, and the number of
    rounds is logarithmic; the result is the same.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        out = both.join(least, "u")
        if large:
            return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        kept = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return kept.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(now)
    if seen[0] <= LOCAL_EDGES:
        return cut(map_arrow(now.coalesce(1), settled, "node long, component long"))
    while seen[0]:
        then, now = now, cut(star(star(now, True), False))
        drop(then)
        last, seen = seen, mark(now)
        if last == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
