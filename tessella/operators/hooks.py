"""Where a caller's own functions run: encoders, folds, look-ups and loaders, in Arrow batches or groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def encoded(df: DataFrame, columns: list[str], encoder: Callable[[pd.DataFrame], pd.Series], type_: str, name: str = "code") -> DataFrame:
    """df with what an encoder makes of a batch of its columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: encoder(batch[columns])})

    return df.mapInPandas(run, ", ".join([*(f"{c} {t}" for c, t in df.dtypes), f"{name} {type_}"]))


def folded(df: DataFrame, key: list[str], order: list[str], fold: Callable, start, type_: str, neutral=None, reduce: Callable | None = None) -> DataFrame:
    """(key, value): fold(value, row) over the rows of each key in an order that tells them apart, from a start.

    With reduce, which must be associative but need not commute, and a value that
    is neutral to it, a key may have any number of rows: rows are dealt out by
    ranges of key and order, each range folds its rows from the neutral value, and
    a key's few ranges are reduced from left to right, after the start.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in key)
    if reduce is None:

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            value = start
            for row in rows.sort_values(order).itertuples(index=False):
                value = fold(value, row)
            return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in key}, "value": [value]})

        return df.groupBy(*key).applyInPandas(one, f"{schema}, value {type_}")

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, value, part = None, None, None
        done = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                this = tuple(getattr(row, k) for k in key)
                if this != now:
                    if now is not None:
                        done.append((*now, part, value))
                    now, value, part = this, neutral, row.range_no
                value = fold(value, row)
            if done:
                yield pd.DataFrame(done, columns=[*key, "range_no", "value"])
                done = []
        if now is not None:
            yield pd.DataFrame([(*now, part, value)], columns=[*key, "range_no", "value"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        value = start
        for v in rows.sort_values("range_no")["value"]:
            value = reduce(value, v)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in key}, "value": [value]})

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order).withColumn("range_no", F.spark_partition_id())
    return x.mapInPandas(ranges, f"{schema}, range_no int, value {type_}").groupBy(*key).applyInPandas(join, f"{schema}, value {type_}")


def looked_up(df: DataFrame, entries: DataFrame, key: list[str], missing: str) -> DataFrame:
    """df joined with the entries it names; a name that isn't there is an error when rows are read."""
    x = df.join(entries.withColumn("_there", F.lit(True)), key, "left")
    return x.withColumn("_ok", F.assert_true(F.coalesce(F.col("_there"), F.lit(False)), F.concat(F.lit(f"{missing}: "), F.concat_ws(", ", *key)))).where("_ok is null").drop("_there", "_ok")


def loaded(spark: SparkSession, load: Callable[[int], pd.DataFrame], n: int, schema: str) -> DataFrame:
    """The rows of load(0) .. load(n - 1), each loaded in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                yield load(int(i))

    return spark.range(n, numPartitions=max(1, min(n, 4096))).mapInPandas(run, schema)
