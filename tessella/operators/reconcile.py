"""Reconciling keys found in code with a stored catalogue."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reconcile(code: DataFrame, stored: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(key, status) of a full outer join on (locale, key).

    code: locale, key, path, kwargs; stored: locale, key, path, kwargs; keep: keys
    that stay though code lacks them (referenced or marked). New keys are added,
    moved ones have another path, changed ones other kwargs; the stored rest is
    commented unless it is kept.
    """
    a, b = code.alias("a"), stored.alias("b")
    on = (F.col("a.locale") == F.col("b.locale")) & (F.col("a.key") == F.col("b.key"))
    status = (
        F.when(F.col("b.key").isNull(), "added")
        .when(F.col("a.key").isNull(), "stale")
        .when(~F.col("a.path").eqNullSafe(F.col("b.path")), "moved")
        .when(~F.col("a.kwargs").eqNullSafe(F.col("b.kwargs")), "updated")
        .otherwise("same")
    )
    x = a.join(b, on, "full").select(F.coalesce("a.locale", "b.locale").alias("locale"), F.coalesce("a.key", "b.key").alias("key"), status.alias("status"))
    if keep is None:
        return x.withColumn("status", F.when(F.col("status") == "stale", "commented").otherwise(F.col("status")))
    held = keep.select("locale", "key").distinct().withColumn("_kept", F.lit(True))
    x = x.join(held, ["locale", "key"], "left")
    return x.select("locale", "key", F.when((F.col("status") == "stale") & F.col("_kept"), "kept").when(F.col("status") == "stale", "commented").otherwise(F.col("status")).alias("status"))


def statistics(reconciled: DataFrame, commenting: bool = True) -> DataFrame:
    """Counts by locale: the entries that are there afterwards, and those updated, added and commented.

    A moved or changed entry is written anew and its old form is commented, so it
    counts as both. A run that only warns leaves all entries and adds new keys only.
    """
    s = F.col("status")
    again = s.isin("updated", "moved")
    return reconciled.groupBy("locale").agg(
        (F.count_if(s != "commented") if commenting else F.count(F.lit(1))).alias("stored"),
        F.count_if(again).alias("updated"),
        F.count_if(s == "added").alias("added"),
        F.count_if((s == "commented") | again).alias("commented"),
    )


def with_home(comments: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """Comments whose path also has entries; a file of comments only is left alone."""
    return comments.join(entries.select(path).distinct(), path, "left_semi")


def checkpoints(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir for checkpoints; a folder of our own only on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="tessella-closure-"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node) for all nodes that references reach from the seeds, at any depth.

    edges: src, dst; seeds: root. Each round extends only what the last one found
    (semi-naive) and is cut by a checkpoint, so cycles end and plans stay short;
    rounds go on until one finds nothing.
    """
    checkpoints(edges.sparkSession)
    found = seeds.select("root", F.col("root").alias("node")).distinct().checkpoint()
    new = found
    while True:
        step = new.join(edges, new["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        new = step.join(found, ["root", "node"], "left_anti").checkpoint()
        if not new.limit(1).count():
            break
        found = found.unionByName(new)
    return found


def serialized(df: DataFrame, by: list[str], order: list[str], text: str, separator: str = "\n", *also: Column) -> DataFrame:
    """One text for each group, its entries in order, and further aggregates. A group is one file, so it fits in memory."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x[text]), separator).alias("content"), *also)


def stale(stored: DataFrame, code: DataFrame, needed: DataFrame, marked: DataFrame, key: list[str]) -> DataFrame:
    """Stored keys that are neither in code, nor needed by others, nor marked to stay."""
    out = stored
    for other in (code, needed, marked):
        out = out.join(other.select(*key), key, "left_anti")
    return out


def exactly_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """The inner join of candidates with occurrences, with the number of matches of each occurrence; use is_single to assert."""
    n = left.groupBy(*key).agg(F.count(F.lit(1)).alias("matches"))
    return right.join(n, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def is_single(matches: Column) -> Column:
    return F.assert_true(matches == 1, F.lit("an occurrence must match exactly one candidate"))
