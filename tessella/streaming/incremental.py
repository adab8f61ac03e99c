"""Structured Streaming surface: incremental extraction with a fingerprint cache, time bins, live state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tessella.functions.hashing import fingerprint
from tessella.session import by_value


def changed(files: DataFrame, cache: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files to do, cached results that still hold): a left join on key and fingerprint."""
    now = files.withColumn("fp", fingerprint(*[F.col(c) for c in columns]))
    known = cache.select(key, "fp")
    return now.join(known, [key, "fp"], "left_anti"), cache.join(now.select(key, "fp"), [key, "fp"], "left_semi")


class Versions(StatefulProcessor):
    """Per key: the fingerprint, the version and the order of what was last passed on.

    Of the rows of a key in one batch the last in order counts, then the greatest
    fingerprint; rows from before what is known are late and change nothing. With
    timers, a key whose last row is behind the watermark leaves as if it was removed.
    """

    def __init__(self, key: str, rest: list[str], timers: bool):
        self.key, self.rest, self.timers = key, rest, timers

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "fp string, version long, at long, gone boolean")

    def handleInputRows(self, key, rows, timerValues):
        last = max(rows, key=lambda r: (r["_at"], r["fp"]))
        fp, version, at, gone = self.known.get() if self.known.exists() else (None, 0, None, True)
        if at is not None and last["_at"] < at:
            return
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if not last["gone"]:
                self.handle.registerTimer(last["_at"] // 1000)
        now = None if last["gone"] else last["fp"]
        if now == fp and last["gone"] == gone:
            self.known.update((fp, version, last["_at"], gone))
            return
        self.known.update((now, version + 1, last["_at"], last["gone"]))
        yield self.change(key, last, now, version + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, version, at, _ = self.known.get()
        self.known.update((None, version + 1, at, True))
        yield self.change(key, None, None, version + 1)

    def change(self, key, row, fp, version):
        return Row(**{self.key: key[0]}, **{c: row and row[c] for c in self.rest}, fp=fp, version=version, gone=fp is None)

    def close(self) -> None:
        return


def changes(stream: DataFrame, key: str, columns: list[str], at: Column, removed: Column | None = None, ttl: int | None = None) -> DataFrame:
    """The rows of a stream that are new, changed or removed: its columns, fp, version (from 1) and gone.

    key: what a row is known by (rows without one are left out); columns: what its
    fingerprint covers; at: when that was so, in microseconds, such as when a file
    was written; removed: whether a row says that its key is gone; ttl: a key is
    gone too, with null in all other columns, once rows come that are so many
    milliseconds newer than its last one. A gone key may come back later.
    """
    by_value(__name__)
    rest = [c for c in stream.columns if c != key]
    x = stream.where(F.col(key).isNotNull()).withColumns({"fp": fingerprint(*[F.col(c) for c in columns]), "_at": at.cast("long"), "gone": F.coalesce(removed, F.lit(False)) if removed is not None else F.lit(False)})
    types = dict(stream.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in (key, *rest)] + ["fp string", "version long", "gone boolean"])
    if ttl is not None:
        x = x.withColumn("_seen", F.timestamp_micros("_at")).withWatermark("_seen", f"{ttl} milliseconds")
    return x.groupBy(key).transformWithState(Versions(key, rest, ttl is not None), schema, "append", "None" if ttl is None else "EventTime")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def incremental(changed: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, partition_by: tuple[str, ...] = (), name: str | None = None) -> StreamingQuery:
    """A started query that appends what `work` makes of `changes` to a table of Parquet files, and ends when nothing new is left.

    work gives one row for each row it gets, with the key, version and gone. A batch
    writes its own changes only; a failed or repeated one is not seen twice, as the
    sink lists the files of finished batches. `latest` reads what holds now.
    """
    spark = changed.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        out = work(changed).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        out = out.partitionBy(*partition_by) if partition_by else out
        return (out.queryName(name) if name else out).start()
    finally:
        spark.conf.set(STORE, before)


def latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The last version of each key, without those that are gone."""
    x = spark.read.parquet(target)
    newest = x.groupBy(F.col(key).alias("_k")).agg(F.max("version").alias("_v"))
    return x.join(newest, (F.col(key) == F.col("_k")) & (F.col("version") == F.col("_v"))).where("not gone").select(*x.columns)


def binned(stream: DataFrame, ts: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are dropped, and closed windows leave the state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("bin"), *by).agg(F.count(F.lit(1)).alias("n"))


def folded(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Events once each, for a dashboard that may see an event streamed and again in the final report."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def sessions(stream: DataFrame, ts: str, by: list[str], gap: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), *by).agg(F.count(F.lit(1)).alias("n"))
