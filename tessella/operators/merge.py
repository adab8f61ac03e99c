"""Merging occurrences of a key, and comparing two extractions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_occurrences(df: DataFrame, key: list[str], star: Column, location: Column, kwargs: Column, path: Column, also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each key: the winning kwargs and path, where the first `**` is, and what else is to be counted (also).

    The winner is the earliest occurrence without `**`, else the earliest of all:
    the minimum of (star, location), so partial aggregates merge in any order.
    Locations must differ within a key: which of two equal ones wins is open.
    """
    rank = F.struct(star.alias("star"), location.alias("location"))
    return df.groupBy(*key).agg(
        F.min_by(kwargs, rank).alias("kwargs"),
        F.min_by(path, rank).alias("path"),
        F.min(rank)["location"].alias("location"),
        F.min(F.when(star, location)).alias("unknown_at"),
        F.count(F.lit(1)).alias("occurrences"),
        *[c.alias(n) for n, c in (also or {}).items()],
    )


def merge_by_file(df: DataFrame, file: list[str], key: list[str], star: Column, location: Column, kwargs: Column, path: Column) -> DataFrame:
    """merge_occurrences in two levels: what each file has, then what the files have together, with the same result.

    A file's own winner is without `**` if any of its occurrences is, so the
    second level compares winners by that; the first `**` and the counts of all
    files are carried along.
    """
    one = merge_occurrences(df, [*file, *key], star, location, kwargs, path, {"star": F.min(star)})
    rank = F.struct("star", "location")
    return one.groupBy(*key).agg(
        F.min_by("kwargs", rank).alias("kwargs"),
        F.min_by("path", rank).alias("path"),
        F.min(rank)["location"].alias("location"),
        F.min("unknown_at").alias("unknown_at"),
        F.sum("occurrences").alias("occurrences"),
        F.count(F.lit(1)).alias("files"),
    )


def conflicts(df: DataFrame, key: list[str], star: Column, kwargs: Column, path: Column) -> DataFrame:
    """Keys that occur with different paths, or without `**` with different kwargs."""
    x = df.groupBy(*key).agg(F.count_distinct(path).alias("paths"), F.count_distinct(F.when(~star, kwargs)).alias("kwargs_sets"))
    kind = F.when(F.col("paths") > 1, "path").otherwise("kwargs")
    return x.where("paths > 1 or kwargs_sets > 1").withColumn("kind", kind)


def conflicting(df: DataFrame, key: list[str], star: Column, location: Column, kwargs: Column, path: Column) -> DataFrame:
    """As conflicts, with the two earliest values that differ and where they are: key, kind, first, other, first_at, other_at.

    Paths are compared over all occurrences, kwargs over those without `**`. Of
    each value the earliest place counts, and two values of a key are kept.
    """
    out = None
    for kind, rows, value in (("path", df, path), ("kwargs", df.where(~star), F.array_join(kwargs, ", "))):
        one = rows.groupBy(*key, F.coalesce(value, F.lit("")).alias("value")).agg(F.min(location).alias("at"))
        two = one.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("at"))).where("_r <= 2")
        pair = two.groupBy(*key).agg(*[F.max(F.when(F.col("_r") == i, F.col(c))).alias(n) for c, i, n in (("value", 1, "first"), ("value", 2, "other"), ("at", 1, "first_at"), ("at", 2, "other_at"))])
        pair = pair.where("other_at is not null").withColumn("kind", F.lit(kind))
        out = pair if out is None else out.unionByName(pair)
    return out


def duplicates(df: DataFrame, key: list[str], line: str) -> DataFrame:
    """A row for each definition of a key that has several: key, line, n (how many). Keys are counted before their lines travel."""
    several = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.join(several, key).select(*key, line, "n")


def last_definition(df: DataFrame, key: list[str], order: Column, value: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, order).alias(value), F.count(F.lit(1)).alias("n"))


def diff(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys that one side lacks or whose values differ, null equal to null: verdict missing, invented or differs."""
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key])
    here, there = F.col(f"a.{key[0]}").isNotNull(), F.col(f"b.{key[0]}").isNotNull()
    same = reduce(lambda x, y: x & y, [F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values])
    verdict = F.when(~there, "missing").when(~here, "invented").when(~same, "differs")
    return a.join(b, on, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], verdict.alias("verdict")).where("verdict is not null")
