"""Events of running queries for an observer, and results in the order they were asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Observer(StreamingQueryListener):
    """Tells a function of each start, batch and end of every stream: (event, query name, batch, rows).

    The end has the last batch and the rows of all batches.
    """

    def __init__(self, tell: Callable[[str, str | None, int | None, int | None], None]):
        self.tell = tell
        self.runs: dict[str, tuple[str | None, int | None, int]] = {}  # name, last batch and rows of each run that is going on

    def onQueryStarted(self, event) -> None:
        self.runs[str(event.runId)] = (event.name, None, 0)
        self.tell("started", event.name, None, None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        _, _, rows = self.runs.get(str(p.runId), (p.name, None, 0))
        self.runs[str(p.runId)] = (p.name, p.batchId, rows + p.numInputRows)
        self.tell("batch", p.name, p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self.tell("failed" if event.exception else "ended", *self.runs.pop(str(event.runId), (None, None, 0)))


def in_order(results: DataFrame, by: list[str], ordinal: str, value: str) -> DataFrame:
    """values: the results of each group by their ordinal, whatever order they were completed in."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("_o"), F.col(value).alias("_v"))))
    return results.groupBy(*by).agg(F.transform(rows, lambda r: r["_v"]).alias("values"))
