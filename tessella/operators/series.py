"""Operators over ordered rows: bins, histograms, shares, early stopping, recent rows, chunks."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import prefix
from tessella.operators.reconcile import checkpoints
from tessella.session import ship


def binned(df: DataFrame, by: list[str], ts: str, seconds: int, bins: int) -> DataFrame:
    """Counts in fixed bins from the first time of all; the last bin takes all that follows."""
    t = F.unix_seconds(F.col(ts).cast("timestamp"))
    start = df.agg(F.min(t).alias("_start"))
    b = F.least(F.floor((t - F.col("_start")) / seconds), F.lit(bins - 1)).cast("bigint")
    return df.join(F.broadcast(start)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts by half-open bins [a, b); bin 0 is below the first edge."""
    b = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        b = F.when(F.col(value) < e, i).otherwise(b)
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, family: str, member: str) -> DataFrame:
    """Rows, their share of all, and distinct members of each family."""
    x = df.groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(member).alias("members"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return x.join(F.broadcast(total)).select(family, "n", (F.col("n") / F.col("_total")).alias("share"), "members")


def family_rates(df: DataFrame, by: list[str], rate: str) -> DataFrame:
    """By group: the largest rate, the share of rates that aren't 0, and their median."""
    x = df.groupBy(*by).agg(F.max(rate).alias("max_rate"), F.avg((F.col(rate) > 0).cast("double")).alias("active"))
    m = prefix.medians(df.where(F.col(rate) > 0), by, rate, "median_active").withColumnsRenamed({c: f"_of_{c}" for c in by})
    return x.join(m, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]), "left").select(*by, "max_rate", "median_active", "active")


def profile(df: DataFrame, by: list[str], value: str, conditional: Column, silent: Column) -> DataFrame:
    """By group: rows, mean and exact median of a value, mean of a conditional column (null where it doesn't apply), silent rows."""
    x = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg(conditional).alias("conditional_mean"), F.count_if(silent).alias("silent"))
    m = prefix.medians(df, by, value, "median").withColumnsRenamed({c: f"_of_{c}" for c in by})
    return x.join(m, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]), "left").select(*by, "n", "mean", "median", "conditional_mean", "silent")


def early_stop(df: DataFrame, step: str, value: str, patience: int) -> DataFrame:
    """since: steps since the best value so far; stop: whether that reaches the patience. One row for each step of one run of any length."""
    x = prefix.running(df.select(step, value), [F.col(step)], {"_best": (F.col(value), "max")})
    x = x.withColumn("_new", F.when(F.col("_best").isNull() | (F.col(value) > F.col("_best")), F.col(step)))
    x = prefix.running(x, [F.col(step)], {"_before": (F.col("_new"), "max")})
    since = F.col(step) - F.coalesce("_new", "_before")
    return x.select(step, value, since.alias("since"), (since >= patience).alias("stop"))


def recent(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group in an order; Spark keeps k a task before it shuffles."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def chosen(df: DataFrame, by: list[str], value: str, rank: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, rank).alias("chosen"), F.count(F.lit(1)).alias("points"))


def ranked(df: DataFrame, key: str) -> DataFrame:
    """rank: the dense rank of each row's key, from 1."""
    keys = prefix.numbered(df.select(key).distinct(), [F.col(key)], "rank")
    return df.join(keys.select(key, (F.col("rank") + 1).cast("bigint").alias("rank")), key)


#: Rows of a group that one task walks over; larger groups are chunked by all tasks.
WALKED = 1 << 20


def numbered_chunks(df: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Greedy chunks of the ordered rows of each group: a chunk closes before the row that would pass the budget.

    Chunks reset the sum, so each row needs the one before it. Groups of up to
    WALKED rows are sorted and pass in Arrow batches, with a sum and a number
    held; larger ones are chunked by pointers, with the same result.
    """
    ship(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.select(by, *order, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    large = df.groupBy(F.col(by).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WALKED).select("_g")
    checkpoints(df.sparkSession)
    large = large.checkpoint()
    some = large.limit(1).count() > 0
    split = prefix.greedy_chunks(df.join(large, F.col(by) == F.col("_g"), "left_semi"), by, order, "_size", budget).drop("_size") if some else None
    df = df.join(large, F.col(by) == F.col("_g"), "left_anti") if some else df
    x = df.repartition(n, by).sortWithinPartitions(by, *order)

    def walk(batches):
        group, held, chunk = object(), 0, 0
        for b in batches:
            out = []
            for g, s in zip(b.column(0).to_pylist(), b.column(len(order) + 1).to_pylist(), strict=True):
                if g != group:
                    group, held, chunk = g, 0, 0
                elif held and held + s > budget:
                    held, chunk = 0, chunk + 1
                held += s
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(order) + 1], pa.array(out, pa.int32())], [by, *order, "chunk"])

    walked = x.mapInArrow(walk, ", ".join([*(f"{c} {t}" for c, t in x.dtypes if c != "_size"), "chunk int"]))
    return walked if split is None else walked.unionByName(split)
