"""Balanced, grouped and replicated samples; selection is by hash, so any engine repeats it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(id_: Column, seed: str) -> Column:
    return F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}")).cast("binary"))


def balanced(df: DataFrame, label: str, id_: str, ratio: int = 3, seed: str = "b") -> DataFrame:
    """All of the rarer label and at most `ratio` times as many of the other, by hash.

    Hashes are counted in 4096 bins by label: lower bins stay whole, and only the
    rows of the bin in which a label reaches its number are ranked.
    """
    bin_ = F.conv(F.substring(draw(F.col(id_), seed), 1, 3), 16, 10).cast("int")
    counts = df.groupBy(F.col(label).alias("_label"), bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_label").orderBy("_bin")
    total = counts.groupBy("_label").agg(F.sum("_n").alias("_all"))
    most = total.agg((F.min("_all") * ratio).alias("_most"))
    edge = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).crossJoin(F.broadcast(most))
    # what each label may still take of its bins: all, some, none; at most 4096 rows a label
    edge = edge.select("_label", "_bin", (F.col("_most") - F.col("_before")).alias("_left"), "_n").where("_left > 0")
    x = df.withColumn("_bin", bin_)
    x = x.join(F.broadcast(edge), (x[label].eqNullSafe(F.col("_label"))) & (x["_bin"] == edge["_bin"])).drop(edge["_bin"])
    whole, part = x.where("_n <= _left"), x.where("_n > _left")
    rank = F.row_number().over(Window.partitionBy("_label").orderBy(draw(F.col(id_), seed), id_))
    part = part.withColumn("_rank", rank).where("_rank <= _left").drop("_rank")
    return whole.unionByName(part).select(*df.columns)


def group_split(df: DataFrame, group: str, train: int = 80, val: int = 10, seed: str = "s") -> DataFrame:
    """split: rows of one group stay together; the groups' hash range is cut at train and val per cent."""
    groups = df.select(group).distinct()
    # hashes are uniform, so their range is cut: no global sort of the groups
    first = F.conv(F.substring(draw(F.col(group), seed), 1, 8), 16, 10).cast("bigint") * 100 / float(1 << 32)
    split = F.when(first < train, "train").when(first < train + val, "val").otherwise("test")
    return df.join(groups.withColumn("split", split), group)


def capped(df: DataFrame, positive: Column, id_: str, budget: int, seed: str = "c") -> DataFrame:
    """All positive rows, and of the others those with the least hashes until the budget is full; one plan, `budget` rows ranked."""
    kept = df.where(positive)
    taken = kept.agg(F.count(F.lit(1)).alias("_taken"))
    order = [draw(F.col(id_), seed), F.col(id_)]
    few = df.where(~positive).orderBy(*order).limit(budget).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    return kept.unionByName(few.crossJoin(F.broadcast(taken)).where(F.col("_rank") <= budget - F.col("_taken")).select(*df.columns))


def replicated(df: DataFrame, seeds: list[int]) -> DataFrame:
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def pairs(df: DataFrame, id_: str, n: int, seed: str = "p", differ: str | None = None) -> DataFrame:
    """All pairs i < j of the n rows with the least hashes: a bounded sample of pairs; differ: a column whose values must differ."""
    few = df.orderBy(draw(F.col(id_), seed), id_).limit(n)
    a, b = few.alias("a"), few.alias("b")
    on = F.col(f"a.{id_}") < F.col(f"b.{id_}")
    return a.join(b, on & ~F.col(f"a.{differ}").eqNullSafe(F.col(f"b.{differ}")) if differ else on)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys in both parts; empty if a holdout is one."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")
