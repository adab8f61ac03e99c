"""A live board of running work: events are folded as they come, each once, and a run that ended leaves the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessella.session import by_value

BOARD = "kind string, n long, amount double, last timestamp, done boolean"


class Board(StatefulProcessor):
    """Per run: the ids of its events, and by kind how many there were, their sum and the last one.

    An event that comes again, because it was streamed and is in the final report
    too or because a file was sent twice, has an id that is known and counts no
    more. When the watermark is past a run's last event, all of its state goes, and
    each kind is reported once more as done.
    """

    def __init__(self, key: str):
        self.key = key

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "id string", "at long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long, amount double, last long")

    def handleInputRows(self, key, rows, timerValues):
        changed = {}
        for r in rows:
            if self.seen.containsKey((r["_id"],)):
                continue
            self.seen.updateValue((r["_id"],), (r["_ms"],))
            n, amount, last = changed.get(r["_kind"]) or self.kinds.getValue((r["_kind"],)) or (0, 0.0, 0)
            changed[r["_kind"]] = (n + 1, amount + r["_amount"], max(last, r["_ms"]))
        if not changed:
            return
        for kind, value in changed.items():
            self.kinds.updateValue((kind,), value)
        timers = list(self.handle.listTimers())
        end = max([*timers, *(last for _, _, last in changed.values())])
        if timers != [end]:
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(end)
        for kind, value in sorted(changed.items()):
            yield self.row(key, kind, value, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        for (kind,), value in sorted(self.kinds.iterator()):
            yield self.row(key, kind, value, True)
        self.seen.clear()
        self.kinds.clear()

    def row(self, key, kind, value, done):
        import datetime

        n, amount, last = value
        return Row(**{self.key: key[0]}, kind=kind, n=n, amount=amount, last=datetime.datetime.fromtimestamp(last / 1000), done=done)

    def close(self) -> None:
        return


def board(events: DataFrame, run: str, event: str, kind: str, amount: Column, at: str, quiet: str) -> DataFrame:
    """Rows (run, kind, n, amount, last, done) in update mode: what changed in a batch, and once more when a run is over.

    quiet: how far the events of all runs must be past a run's last one before it
    is over, such as '10 minutes'; events that are later than that are left out.
    Needs the RocksDB state store (incremental.ROCKS).
    """
    by_value(__name__)
    x = events.select(F.col(run), F.col(event).cast("string").alias("_id"), F.col(kind).cast("string").alias("_kind"), F.coalesce(amount.cast("double"), F.lit(0.0)).alias("_amount"), F.col(at).cast("timestamp").alias("_at"))
    x = x.where(F.col(run).isNotNull() & F.col("_id").isNotNull() & F.col("_kind").isNotNull() & F.col("_at").isNotNull()).withColumn("_ms", F.unix_millis("_at"))
    return x.withWatermark("_at", quiet).groupBy(run).transformWithState(Board(run), f"`{run}` {dict(events.dtypes)[run]}, {BOARD}", "update", "EventTime")
