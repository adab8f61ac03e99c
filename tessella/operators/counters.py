"""Counts that a run carries along, so that asking for them reads nothing again."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """Taps on the frames of one plan; after its action, `read` has what each of them counted.

    A tap counts rows, and sums of columns if asked. Every tap must be in the plan
    that runs, and the plan must run as a whole: a limit would stop it early. Where
    a shuffle turns out to carry no rows, adaptive execution drops the part of the
    plan before it with its counts: such a tap has None.
    """

    def __init__(self):
        self.taps: list[tuple[str, Observation]] = []

    def tap(self, df: DataFrame, name: str, **sums: Column) -> DataFrame:
        seen = Observation(name)
        self.taps.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(k) for k, c in sums.items()])

    def read(self) -> dict[str, dict[str, int] | None]:
        return {name: self.one(seen) for name, seen in self.taps}

    @staticmethod
    def one(seen: Observation) -> dict[str, int] | None:
        try:
            return {k: v or 0 for k, v in seen.get.items()}
        except Py4JJavaError:  # the plan that ran had no such tap any more
            return None
