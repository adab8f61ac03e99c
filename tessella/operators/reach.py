"""What nodes of a directed graph can reach: strongly connected components, and the values that references gather.

A reference graph may have cycles, and all of its nodes may reach each other, so
pairs of nodes are never listed. Cycles are first condensed; values then move
along the edges between components, each (component, value) once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.reconcile import checkpoints
from tessella.session import ship

#: Edges that one task settles (24 MB of ids); more are settled by rounds of joins.
LOCAL_EDGES = 1 << 20
#: Shortcuts over several edges are added while they, and the pairs that make them, are at most so many times the edges.
SHORTCUTS = 4
#: Rounds whose results are kept side by side before they are written as one, so that plans stay short.
UNIONS = 8


def strong(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of the strongly connected component of each of n nodes."""
    order = np.argsort(u, kind="stable")
    after = v[order].tolist()
    first = np.searchsorted(u[order], np.arange(n + 1)).tolist()
    number, low, label = [0] * n, [0] * n, [-1] * n
    at, count, held = first[:-1], 0, []
    for root in range(n):
        if number[root]:
            continue
        path = [root]
        while path:
            x = path[-1]
            if not number[x]:
                count += 1
                number[x] = low[x] = count
                held.append(x)
            if at[x] < first[x + 1]:
                y = after[at[x]]
                at[x] += 1
                if not number[y]:
                    path.append(y)
                elif label[y] < 0:
                    low[x] = min(low[x], number[y])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
            if low[x] == number[x]:
                k = len(held) - 1
                while held[k] != x:
                    k -= 1
                least = min(held[k:])
                for y in held[k:]:
                    label[y] = least
                del held[k:]
    return np.array(label, np.int64)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a partition."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if held:
        node, place = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        u, v = place.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[strong(len(node), u, v)])], ["node", "component"])


def _within(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias(column)), column, "left_semi").select("src", "dst")


def _spread(label: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least label that can reach each node; only labels that fell go on to the next round."""
    new = label
    while True:
        came = new.join(edges, new["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("_came"))
        new = came.join(label, "node").where(F.col("_came") < F.col("label")).select("node", F.col("_came").alias("label")).checkpoint()
        if not new.limit(1).count():
            return label
        label = label.join(new.select("node", F.col("label").alias("_new")), "node", "left").select("node", F.coalesce("_new", "label").alias("label")).checkpoint()


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of the strongly connected component of every end of the (src, dst) edges, which are longs.

    While there are more edges than one task settles: nodes without a way in or
    out are components of their own and leave; the least label that reaches a
    node is its colour; and what reaches a colour's own node within its colour is
    a component and leaves. Edges between colours are in no component. Rounds go
    on until no edge is left, however many there are.
    """
    spark = edges.sparkSession
    checkpoints(spark)
    ship(spark)
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().checkpoint()
    e = e.where("src <> dst").distinct().checkpoint()
    found = []
    n = e.count()
    while n > LOCAL_EDGES:
        while True:
            both = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
            left = _within(_within(e, both, "src"), both, "dst").checkpoint()
            m = left.count()
            e, before, n = left, n, m
            if n == before or n <= LOCAL_EDGES:
                break
        if n <= LOCAL_EDGES:
            break
        ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = _spread(ends.select("node", F.col("node").alias("label")).checkpoint(), e)
        own = colour.select(F.col("node").alias("src"), F.col("label").alias("_cs"))
        same = e.join(own, "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("_cd")), "dst").where("_cs = _cd").select("src", "dst", F.col("_cs").alias("colour")).checkpoint()
        # backwards from the colours' own nodes
        back = colour.where("node = label").select("node", F.col("label").alias("component")).checkpoint()
        new = back
        while True:
            step = new.join(same, (new["node"] == same["dst"]) & (new["component"] == same["colour"])).select(F.col("src").alias("node"), "component").distinct()
            new = step.join(back, "node", "left_anti").checkpoint()
            if not new.limit(1).count():
                break
            back = back.unionByName(new).checkpoint()
        found.append(back)
        gone = back.select("node")
        e = same.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst").checkpoint()
        n = e.count()
    if n:
        found.append(e.coalesce(1).mapInArrow(_settled, "node long, component long").checkpoint())
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f)
    if out is None:
        return nodes.select("node", F.col("node").alias("component"))
    least = out.groupBy("component").agg(F.min("node").alias("_least"))
    out = out.join(least, "component").select("node", F.col("_least").alias("component"))
    return nodes.join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component")).checkpoint()


def shortened(edges: DataFrame) -> DataFrame:
    """(_a, _b) edges of a graph without cycles and, beside them, ways of 2, 4, 8... edges as one, so that fewer rounds go the longest way.

    Pairs of edges are counted by their degrees before they are made: where they
    would outgrow the edges, as behind hubs or on long chains, shortcuts end.
    """
    n = first = edges.count()
    while n:
        into, out = (edges.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias(f"n{c}")) for c in ("_b", "_a"))
        pairs = into.join(out, "node").agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0
        if not pairs or pairs > SHORTCUTS * first:
            break
        two = edges.join(edges.select(F.col("_a").alias("_m"), F.col("_b").alias("_c")), F.col("_b") == F.col("_m")).select("_a", F.col("_c").alias("_b"))
        both = edges.unionByName(two).distinct().checkpoint()
        last, n = n, both.count()
        if n == last or n > SHORTCUTS * first:
            break
        edges = both
    return edges


def gathered(edges: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, component), (component, value)): the values (node, value) that each component's nodes reach at any depth, their own included.

    A round passes on only what is new to a component; as many rounds run as the
    longest way between components that brings anything new, over shortcuts.
    """
    ends = edges.select("src", "dst").unionByName(values.select(F.col("node").cast("long").alias("src"), F.col("node").cast("long").alias("dst")))
    part = strong_components(ends)
    between = edges.join(part.select(F.col("node").alias("src"), F.col("component").alias("_a")), "src").join(part.select(F.col("node").alias("dst"), F.col("component").alias("_b")), "dst")
    between = between.where("_a <> _b").select("_a", "_b").distinct().checkpoint()
    between = shortened(between)
    found = values.join(part, "node").where("value is not null").select("component", "value").distinct().checkpoint()
    new = found
    for n in itertools.count(1):
        step = new.join(between, new["component"] == between["_b"]).select(F.col("_a").alias("component"), "value").distinct()
        new = step.join(found, ["component", "value"], "left_anti").checkpoint()
        if not new.limit(1).count():
            return part, found
        found = found.unionByName(new)
        if n % UNIONS == 0:
            found = found.checkpoint()
