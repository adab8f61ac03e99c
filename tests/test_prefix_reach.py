"""Prefix scans, chunks by pointers, medians, components and gathered values against plain Python, also with all rows in one group."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessella.operators import prefix, reach, series


def test_running(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(-5, 9)])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, x int").repartition(5)
    what = {"s": (F.col("x"), "sum"), "c": (F.col("x"), "count"), "m": (F.col("x"), "max"), "l": (F.col("x"), "min")}
    for order, sign in (([F.col("i")], 1), ([F.desc("i")], -1)):
        seen = []
        for r in sorted(prefix.running(df, order, what).collect(), key=lambda r: sign * r["i"]):
            assert (r["s"], r["c"], r["m"], r["l"]) == (sum(seen), len(seen), max(seen, default=None), min(seen, default=None))
            seen += [r["x"]] if r["x"] is not None else []
    assert prefix.running(df.where("false"), [F.col("i")], what).count() == 0


def test_early_stop_has_no_single_partition(spark, capsys):
    rng = random.Random(2)
    values = [rng.choice([None, *range(30)]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "step int, v int")
    out = series.early_stop(df, "step", "v", 5)
    out.explain("formatted")
    assert "SinglePartition" not in capsys.readouterr().out
    best = at = None
    for r in out.orderBy("step").collect():
        if best is None or (r["v"] is not None and r["v"] > best):
            best, at = r["v"], r["step"]
        assert r["since"] == r["step"] - at and r["stop"] == (r["since"] >= 5)


def test_medians_of_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([1, 2, 2, 2, 7]))) for _ in range(1001)] + [("even", float(rng.randrange(50))) for _ in range(100)] + [("one", 4.0), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    want = {g: statistics.median(x for h, x in rows if h == g and x is not None) for g in ("hot", "even", "one", None)}
    assert {r["g"]: r["m"] for r in prefix.medians(df, ["g"], "x", "m").collect()} == want


def walked(sizes, budget):
    held = chunk = 0
    out = []
    for s in sizes:
        if held and held + s > budget:
            held, chunk = 0, chunk + 1
        held += s
        out.append(chunk)
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_chunks(spark, monkeypatch, limit):
    """The same chunks by a walk and by pointers: empty rows, rows over the budget, groups of one row and one of most rows."""
    monkeypatch.setattr(series, "WALKED", limit)
    rng = random.Random(4)
    rows = [("hot", i, rng.choice([0, 0, 1, 3, 9, 10, 11, 25])) for i in range(400)]
    rows += [(f"g{g}", i, rng.choice([0, 2, 12])) for g in range(6) for i in range(rng.randrange(1, 9))] + [("null", 0, None), ("null", 1, 11), ("null", 2, 1), ("null", 3, None)]
    df = spark.createDataFrame(rows, "s string, i int, n int").repartition(4)
    want = {}
    for g, part in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[0]):
        part = list(part)
        want |= {(g, r[1]): c for r, c in zip(part, walked([r[2] or 0 for r in part], 10))}
    out = series.numbered_chunks(df, "s", ["i"], "n", 10)
    assert out.columns == ["s", "i", "chunk"]
    assert {(r["s"], r["i"]): r["chunk"] for r in out.collect()} == want


def reached(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("local", [1 << 20, 0])
@pytest.mark.parametrize("seed,n,m", [(1, 14, 18), (2, 12, 30), (3, 20, 16)])
def test_gathered(spark, monkeypatch, local, seed, n, m):
    """Random graphs with cycles, by one task and by rounds of joins."""
    monkeypatch.setattr(reach, "LOCAL_EDGES", local)
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    values = [(rng.randrange(n + 2), f"v{rng.randrange(6)}") for _ in range(n)]
    e = spark.createDataFrame(edges, "src long, dst long")
    part, sets = reach.gathered(e, spark.createDataFrame(values, "node long, value string"))
    comp = {r["node"]: r["component"] for r in part.collect()}
    nodes = {x for p in edges for x in p} | {x for x, _ in values}
    reach_of = {x: reached(edges, x) for x in nodes}
    assert comp == {x: min(y for y in reach_of[x] if x in reach_of.get(y, {y})) for x in nodes}
    got = {}
    for r in sets.collect():
        got.setdefault(r["component"], set()).add(r["value"])
    for x in nodes:
        assert got.get(comp[x], set()) == {v for y, v in values if y in reach_of[x]}


def test_a_long_ring(spark):
    """100 000 nodes on one ring are one component with one set, not pairs of nodes."""
    n = 100_000
    e = spark.range(n).selectExpr("id src", f"(id + 1) % {n} dst")
    part, sets = reach.gathered(e, spark.range(0, n, 1000).selectExpr("id node", "concat('v', id % 7) value"))
    assert part.count() == n and part.select("component").distinct().collect()[0][0] == 0
    assert sorted(r["value"] for r in sets.collect()) == [f"v{i}" for i in range(7)]


def test_no_edges(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert reach.strong_components(e).count() == 0
    part, sets = reach.gathered(e, spark.createDataFrame([(1, "a"), (1, None)], "node long, value string"))
    assert [tuple(r) for r in part.collect()] == [(1, 1)] and [tuple(r) for r in sets.collect()] == [(1, "a")]


def test_gathered_needs_few_rounds(spark, monkeypatch):
    """Along a chain with branches and a hub, shortcuts save most rounds, and every node has all values behind it."""
    from pyspark.sql.classic.dataframe import DataFrame

    n, calls, kept = 40, [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: calls.append(1) or kept(self, *a, **k))
    pairs = [(i, i + 1) for i in range(n)] + [(100 + i, i) for i in range(0, n, 3)] + [(200 + i, 300) for i in range(9)] + [(300, 400 + i) for i in range(9)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    values = spark.createDataFrame([(v, str(v)) for v in sorted({x for p in pairs for x in p})], "node long, value string")
    of, sets = reach.gathered(edges, values)
    got = {(r["node"], r["value"]) for r in of.join(sets, "component").select("node", "value").collect()}
    want, new = {(v, str(v)) for p in pairs for v in p}, True
    while new:
        new = {(a, v) for a, b in pairs for x, v in want if x == b} - want
        want |= new
    assert got == want
    assert len(calls) < n
