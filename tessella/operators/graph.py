"""Weighted edge tables: aggregation, thresholds, checks, fan-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregated(edges: DataFrame, ends: list[str], weight: str, scores: list[str]) -> DataFrame:
    """One row for each pair: summed weight, weight-averaged scores, raw rows."""
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)), F.lit(0.0))
    return edges.groupBy(*ends).agg(F.sum(weight).alias(weight), *[mean(c).alias(c) for c in scores], F.count(F.lit(1)).alias("n_rows"))


def between(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col(node).alias(src)), src, "left_semi").join(nodes.select(F.col(node).alias(dst)), dst, "left_semi")


def threshold_sweep(pairs: DataFrame, dst: str, weight: str, levels: list[int]) -> DataFrame:
    """For each level: edges that reach it, their mean weight, and targets that lose all edges."""
    t = pairs.sparkSession.createDataFrame([(x,) for x in levels], "level int")
    best = pairs.groupBy(dst).agg(F.max(weight).alias("best"))
    kept = F.when(F.col(weight) >= F.col("level"), F.col(weight))
    a = pairs.crossJoin(F.broadcast(t)).groupBy("level").agg(F.count(kept).alias("edges"), F.avg(kept).alias("mean_weight"))
    b = best.crossJoin(F.broadcast(t)).groupBy("level").agg(F.count_if(F.col("best") < F.col("level")).alias("orphans"))
    return a.join(b, "level")


def fan_in(nodes: DataFrame, node: str, edges: DataFrame, dst: str) -> DataFrame:
    """Edges into every node, 0 where there are none."""
    n = edges.groupBy(F.col(dst).alias(node)).agg(F.count(F.lit(1)).alias("n"))
    return nodes.select(node).join(n, node, "left").select(node, F.coalesce("n", F.lit(0)).alias("n"))


def strongest(columns: list[str]) -> Column:
    """The name of the column with the greatest value, the first on ties."""
    best = F.greatest(*[F.col(c) for c in columns])
    out = F.lit(columns[-1])
    for c in reversed(columns[:-1]):
        out = F.when(F.col(c) == best, c).otherwise(out)
    return out


def delivered(events: DataFrame, edges: DataFrame, by: str, src: str, dst: str, value: str, weight: str) -> DataFrame:
    """A sparse product: each event's value times its edges' weights, summed at the targets."""
    return events.join(edges, src).groupBy(by, dst).agg(F.sum(F.col(value) * F.col(weight)).alias("g"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key the parent lacks."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def violations(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str, weight: str) -> DataFrame:
    """(rule, n) for the rules of a sound graph; all n are 0 if it is."""
    rules = [
        ("unknown source", orphans(edges, src, nodes, node)),
        ("unknown target", orphans(edges, dst, nodes, node)),
        ("self loop", edges.where(F.col(src) == F.col(dst))),
        ("no weight", edges.where(F.col(weight).isNull() | (F.col(weight) == 0))),
        ("repeated pair", edges.groupBy(src, dst).count().where("count > 1")),
    ]
    out = None
    for name, bad in rules:
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out
