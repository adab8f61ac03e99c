"""Linear scores, votes, conditional re-evaluation, and metrics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BINS = 4096


def margin(vector: Column, weights: list[float], bias: float = 0.0) -> Column:
    """w . x + b over an array column, without a UDF."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vector.cast("array<double>"), w, lambda a, b: a * b), F.lit(float(bias)), lambda acc, x: acc + x)


def threshold(df: DataFrame, value: Column, share: float) -> DataFrame:
    """theta: the lower quantile of |value|: the value of rank ceil(share * n), null values apart.

    Counts in BINS bins find the one that holds the rank, again and again, until
    the bin has few values; only those are sorted. No task sees all values.
    """
    spark, x = df.sparkSession, df.select(F.abs(value).cast("double").alias("a")).where("a is not null")
    low, high, n = x.agg(F.min("a"), F.max("a"), F.count("a")).first()
    rank, few = max(math.ceil(round(share * n, 9)), 1), 10_000
    while n > few and high > low:
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("a") - low) / width), F.lit(BINS - 1))
        counts = sorted(tuple(r) for r in x.groupBy(place.alias("b")).agg(F.count("a"), F.min("a"), F.max("a")).collect())
        for _, n, first, last in counts:
            if rank <= n:
                break
            rank -= n
        x, low, high = x.where(F.col("a").between(first, last)), first, last
    if not n:
        return spark.createDataFrame([(None,)], "theta double")
    return x.orderBy("a").limit(rank).agg(F.max("a").alias("theta")) if high > low else spark.createDataFrame([(low,)], "theta double")


def revoted(df: DataFrame, key: list[str], score: Callable[[Column], Column], theta: float, most: int) -> DataFrame:
    """Votes: every row is scored once; only rows with |score| < theta are scored `most` times more; the sum decides.

    score(n) is the score of evaluation n (0 for the first).
    """
    first = df.withColumn("vote", score(F.lit(0)))
    unsure = first.where(F.abs("vote") < theta)
    more = unsure.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("vote", score(F.col("n")))
    votes = first.select(*key, "vote").unionByName(more.select(*key, "vote"))
    return votes.groupBy(*key).agg(F.sum("vote").alias("vote"), F.count(F.lit(1)).alias("evaluations")).withColumn("verdict", F.col("vote") > 0)


def cascade(df: DataFrame, key: list[str], items: str, accept: Column, accept_item: Callable[[Column], Column]) -> DataFrame:
    """Rows that pass the first stage, with those of their items that pass the second."""
    kept = df.where(accept)
    return kept.select(*key, F.array_sort(F.filter(items, accept_item)).alias("kept"))


def confusion(df: DataFrame, truth: Column, guess: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; 0 where a denominator is 0."""
    counts = [F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn")]
    x = df.groupBy(*(by or [])).agg(*counts)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = x.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def worst(df: DataFrame, wrong: Column, value: Column, tie: list[str], n: int) -> DataFrame:
    """The n wrong rows with the largest |value|: a bounded top-k, no full sort."""
    return df.where(wrong).orderBy(F.abs(value).desc(), *tie).limit(n)


def categories(df: DataFrame, category: Column, n: int) -> DataFrame:
    return df.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(n)


def feature_modes(counts: Column, mode: str) -> Column:
    """binary, log1p, or both one after the other."""
    binary = F.transform(counts, lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    logs = F.transform(counts, lambda x: F.log1p(x.cast("double")))
    return {"binary": binary, "log1p": logs, "both": F.concat(binary, logs)}[mode]


def packed(bits: Column) -> Column:
    """Up to 63 booleans as a number, the first one lowest."""
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """empty: what two empty sets are to each other."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(empty))


def members(candidates: Column, known: Column) -> Column:
    """Of each name of an array, whether it is in another one."""
    return F.transform(candidates, lambda x: F.struct(x.alias("name"), F.array_contains(known, x).alias("known")))


@dataclass(frozen=True)
class Membrane:
    """Fixed values of a leaky unit: time constants in ms, threshold over rest in mV, mV for a unit of weight."""

    tau_m: float
    tau_syn: float
    threshold: float
    unit: float


def threshold_scale(mean_weight: Column, p: Membrane) -> Column:
    """The scale of weights from which one input of mean weight lifts a unit from rest over its threshold, in closed form."""
    m, s = p.tau_m, p.tau_syn
    peak_at = m * s / (m - s) * math.log(m / s)
    peak = s / (m - s) * (math.exp(-peak_at / m) - math.exp(-peak_at / s))
    return F.lit(p.threshold) / (F.lit(p.unit) * mean_weight * F.lit(peak))
