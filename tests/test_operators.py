import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import hashing
from tessella.functions import text as T
from tessella.operators import graph, merge, reconcile, sample, score, series, tokens, training
from tessella.streaming import incremental


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("()[]{}ab", max_size=30), min_size=1, max_size=20))
def test_depth_is_the_clamped_loop(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in tokens.exploded(tokens.with_depth(tokens.sequences(df, "id", "text")), "id", "depth").orderBy("id", "idx").collect():
        got.setdefault(r["id"], []).append(r["depth"])
    import re

    for i, t in enumerate(texts):
        depth, want = 0, []
        for tok in re.findall(T.TOKEN, t):
            want.append(depth)
            depth = max(0, depth + (tok in "([{") - (tok in ")]}"))
        assert got.get(i, []) == want


def test_merge_takes_the_earliest_without_star(spark):
    df = spark.createDataFrame([("k", True, 1, "a"), ("k", False, 5, "b"), ("k", False, 3, "c"), ("s", True, 2, "d")], "k string, star boolean, loc int, kw string")
    out = {r["k"]: r for r in merge.merge_occurrences(df, ["k"], F.col("star"), F.col("loc"), F.col("kw"), F.lit("p")).collect()}
    assert out["k"]["kwargs"] == "c" and out["k"]["unknown_at"] == 1 and out["s"]["kwargs"] == "d"


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string")
    got = {(r["root"], r["node"]) for r in reconcile.closure(e, spark.createDataFrame([("a",), ("d",)], "root string")).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "c"), ("d", "d")}


def test_blake_bucket_is_salted(spark):
    """A known vector: the salt is BLAKE2b's own salt, not its key."""
    import hashlib

    df = spark.createDataFrame([("tok:x", 124, "v1", 0), ("tok:x", 124, "v1", 2)], "f string, n int, s string, k int")
    got = [r[0] for r in df.select(hashing.blake_bucket("f", "n", "s", "k")).collect()]
    raw = lambda t: int.from_bytes(hashlib.blake2b(t, digest_size=8, salt=b"v1").digest(), "little") % 124
    assert got == [47, raw(b"tok:x\x1e2")]


def test_seed_is_little_endian(spark):
    import hashlib

    r = spark.createDataFrame([("x", 3)], "c string, i int").select(hashing.trial_seed(F.col("c"), F.col("i"), "v").alias("s")).first()
    assert int(r["s"]) == int.from_bytes(hashlib.sha256(b"x\x003\x00v").digest()[:8], "little")


def test_split_keeps_groups(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("g"), "id")
    x = sample.group_split(df, "g")
    assert x.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0 and x.count() == 400


def test_delta_rule_is_that_of_all_rows(spark):
    """Rounds over three partitions give the weights of plain numpy over all rows, for each group, and stop early."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    y = {"a": x @ np.array([2, -1, 0, 0, 1, 0.5]) > 0, "b": x[:, 0] > 5}
    df = spark.createDataFrame([(g, v.tolist(), bool(t), "train" if i < 300 else "val") for g in y for i, (v, t) in enumerate(zip(x, y[g]))] + [(None, [0.0] * 6, True, "train"), ("a", None, True, "val")], "g string, x array<double>, y boolean, s string").repartition(3)
    got = training.fit(df, "g", "x", "y", "s", epochs=12)
    for g in y:
        w, b, best = np.zeros(6), 0.0, (-1.0, 0, None)
        for epoch in range(13):
            hit, yes = x[300:] @ w + b > 0, y[g][300:]
            tp = (hit & yes).sum()
            f1 = 2 * tp / (2 * tp + (hit ^ yes).sum()) if tp else 0.0
            if f1 > best[0]:
                best = (f1, epoch, w)
            err = 1 / (1 + np.exp(-(x[:300] @ w + b))) - y[g][:300]
            w, b = w - 2.0 * (x[:300].T @ err / 300 + 1e-5 * w), b - 2.0 * err.mean()
        assert got[g].epochs == best[1] and abs(got[g].f1 - best[0]) < 1e-12 and np.allclose(got[g].w, best[2])
    assert got["a"].f1 > 0.95


def test_revote_only_unsure(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.1)], "id int, m double")
    out = {r["id"]: r["evaluations"] for r in score.revoted(df, ["id"], lambda n: F.col("m"), 0.5, 3).collect()}
    assert out == {1: 1, 2: 4}


def test_chunks_are_greedy(spark):
    df = spark.createDataFrame([("s", 1, 5), ("s", 2, 5), ("s", 3, 1), ("s", 4, 20), ("s", 5, 1), ("t", 1, 20), (None, 2, None)], "s string, i int, n int").repartition(3)
    got = {(r["s"], r["i"]): r["chunk"] for r in series.numbered_chunks(df, "s", ["i"], "n", 10).collect()}
    assert got == {("s", 1): 0, ("s", 2): 0, ("s", 3): 1, ("s", 4): 2, ("s", 5): 3, ("t", 1): 0, (None, 2): 0}


def test_closure_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(70)], "src int, dst int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert reconcile.closure(e, spark.createDataFrame([(0,)], "root int")).count() == 71
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_threshold_of_many_values(spark):
    df = spark.range(60_000).select(((F.col("id") * 7919) % 60_000).cast("double").alias("v"))
    for share in (0.1, 0.5, 1.0):
        want = df.agg(F.expr(f"percentile_disc({share}) within group (order by v)")).first()[0]
        assert score.threshold(df, F.col("v"), share).first()["theta"] == want
    assert score.threshold(df.where("false"), F.col("v"), 0.1).first()["theta"] is None
    assert score.threshold(spark.range(20_000).select(F.lit(3.0).alias("v")), F.col("v"), 0.1).first()["theta"] == 3.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("()[]{}a=,", max_size=30), min_size=1, max_size=20))
def test_brackets_of_unbalanced_texts(spark, texts):
    """Pairs, the pair around a token, values and parts as a stack finds them."""
    import re

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    x = tokens.matching(tokens.after_assignment(tokens.enclosing(tokens.sequences(df, "id", "text"))))
    got = {r["id"]: r for r in tokens.top_level_parts(df.join(x, "id", "left"), "text").collect()}
    for i, t in enumerate(texts):
        toks, stack, pairs, cuts, last, opened, value = re.findall(T.TOKEN, t), [], [], 0, {}, -1, []
        for k, c in enumerate(toks):
            level = len(stack)
            eq, comma = (last.get((level, s), -1) for s in "=,")
            value.append(eq > comma and (level == 0 or eq > opened))
            last[level, c] = k
            cuts += c == "," and not stack
            if c in "([{":
                stack.append(k)
                opened = k
            elif c in ")]}" and stack:
                pairs.append((stack.pop(), k))
        r = got[i]
        assert len(r["parts"]) == cuts + 1 and ",".join(r["parts"]) == t
        if toks:
            assert [(p["open_idx"], p["close_idx"]) for p in r["pairs"]] == sorted(pairs)
            assert r["open_idx"] == [max((a for a, b in pairs if a < k < b), default=-1) for k in range(len(toks))]
            assert r["in_value"] == value


def test_graph_rules(spark):
    e = spark.createDataFrame([(1, 2, 1), (1, 1, 1), (1, 2, 0), (9, 2, 1)], "a int, b int, w int")
    got = {r["rule"]: r["n"] for r in graph.violations(e, spark.createDataFrame([(1,), (2,)], "n int"), "a", "b", "n", "w").collect()}
    assert got == {"unknown source": 1, "unknown target": 0, "self loop": 1, "no weight": 1, "repeated pair": 1}


@pytest.fixture()
def growing(spark, tmp_path):
    """put(rows) adds a file of (path, text, at, gone) rows; run() takes what is new and gives (rows appended, what holds now)."""
    src, target = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    schema = "path string, text string, at long, gone boolean"

    def put(*rows):
        spark.createDataFrame([(*r, None)[:4] for r in rows], schema).coalesce(1).write.mode("append").json(str(src))

    def run(ttl=None):
        before = spark.read.parquet(target).count() if list((tmp_path / "out").glob("**/*.parquet")) else 0
        conf = spark.conf.get(incremental.STORE)
        stream = spark.readStream.schema(schema).json(str(src)).withColumnRenamed("gone", "deleted")
        changed = incremental.changes(stream, "path", ["text"], F.col("at"), F.col("deleted"), ttl)
        incremental.incremental(changed, lambda x: x.select("path", "version", "gone", F.length("text").alias("n")), target, str(tmp_path / "ck")).awaitTermination()
        assert spark.conf.get(incremental.STORE) == conf
        return spark.read.parquet(target).count() - before, {r["path"]: (r["n"], r["version"]) for r in incremental.latest(spark, target, "path").collect()}

    return put, run


def test_incremental_stream(growing):
    """Only changes are written: new and changed keys, the last row of a key in a batch, removed keys and those that come back."""
    put, run = growing
    put(("a", "xx", 1), ("b", "y", 1), ("b", "yyyyy", 3), ("b", "yy", 2), (None, "lost", 1))
    assert run() == (2, {"a": (2, 1), "b": (5, 1)})
    assert run() == (0, {"a": (2, 1), "b": (5, 1)})
    put(("a", "xx", 5), ("b", "yyy", 5), ("c", "", 5))
    assert run() == (2, {"a": (2, 1), "b": (3, 2), "c": (0, 1)})
    put(("b", "late", 4), ("c", None, 6, True), ("d", None, 6, True))
    assert run() == (1, {"a": (2, 1), "b": (3, 2)})
    put(("c", "back", 7))
    assert run() == (1, {"a": (2, 1), "b": (3, 2), "c": (4, 3)})


def test_incremental_replay(spark, growing, tmp_path):
    """A batch whose commit is lost runs again and changes nothing."""
    put, run = growing
    put(("a", "xx", 1))
    run()
    put(("a", "xxx", 2), ("b", "y", 2))
    want = run()[1]
    for p in (tmp_path / "ck" / "commits").glob("*1*"):
        p.unlink()
    assert run() == (0, want)


def test_incremental_timeout(growing):
    """A key that newer files don't mention any more leaves after its time, and may come back."""
    put, run = growing
    second = 1_000_000
    put(("a", "xx", 10 * second), ("b", "y", 11 * second))
    assert run(ttl=5000) == (2, {"a": (2, 1), "b": (1, 1)})
    put(("a", "xx", 14 * second))
    assert run(ttl=5000) == (0, {"a": (2, 1), "b": (1, 1)})
    put(("a", "xx", 20 * second), ("c", "z", 18 * second))
    assert run(ttl=5000) == (2, {"a": (2, 1), "c": (1, 1)})
    put(("b", "y", 21 * second))
    assert run(ttl=5000) == (1, {"a": (2, 1), "b": (1, 3), "c": (1, 1)})


def test_binned_stream(spark, tmp_path):
    src = tmp_path / "e"
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, k string").coalesce(1).write.json(str(src))
    s = spark.readStream.schema("ts timestamp, k string").json(str(src))
    q = incremental.binned(s, "ts", ["k"], "1 hour", "2 hours").writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("bins").collect()) == [1, 2]


def test_hooks(spark):
    import pandas as pd

    from tessella.operators import hooks

    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(30)], "k int, i int, v double").repartition(4)
    out = hooks.encoded(df, ["v"], lambda x: x["v"] * 2, "double").collect()
    assert all(r["code"] == 2 * r["v"] for r in out) and len(out) == 30
    want = {k: sum(float(i) for i in range(30) if i % 3 == k) for k in range(3)}
    add = lambda a, r: a + r.v
    for kw in ({}, {"reduce": lambda a, b: a + b, "neutral": 0.0}):
        assert {r["k"]: r["value"] for r in hooks.folded(df, ["k"], ["i"], add, 0.0, "double", **kw).collect()} == want
        assert {r["k"]: r["value"] for r in hooks.folded(df, ["k"], ["i"], add, 10.0, "double", **kw).collect()} == {k: v + 10 for k, v in want.items()}
    last = hooks.folded(df, ["k"], ["i"], lambda a, r: r.i, 0, "int")
    assert {r["k"]: r["value"] for r in last.collect()} == {0: 27, 1: 28, 2: 29}
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, name string")
    assert hooks.looked_up(df, names, ["k"], "unknown").count() == 30
    with pytest.raises(Exception, match="unknown: 2"):
        hooks.looked_up(df, names.where("k < 2"), ["k"], "unknown").collect()
    got = hooks.loaded(spark, lambda i: pd.DataFrame({"i": [i, i]}), 5, "i long").collect()
    assert sorted(r["i"] for r in got) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ordered_fold_is_the_left_fold(spark, parts):
    """An associative fold that does not commute, with one key that has most rows, at several partitionings."""
    import random

    from tessella.operators import hooks

    rng = random.Random(parts)
    rows = [("hot", i, rng.choice("abc")) for i in range(300)] + [(f"k{i % 5}", i, rng.choice("abc")) for i in range(12)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, c string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["k"]: r["value"] for r in hooks.folded(df, ["k"], ["i"], lambda a, r: a + r.c, ">", "string", neutral="", reduce=lambda a, b: a + b).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: ">" + "".join(c for j, _, c in sorted(rows, key=lambda r: r[1]) if j == k) for k in {r[0] for r in rows}}


def test_merge_by_file_is_the_merge_of_all(spark):
    """Any dealing of occurrences to files gives what one merge gives, the first star included."""
    import random

    rng = random.Random(7)
    rows = [(rng.choice("abcd"), f"k{rng.randrange(6)}", rng.random() < 0.4, i, f"kw{i}") for i in range(80)] + [("a", "both", True, 1, "s"), ("a", "both", False, 2, "p")]
    df = spark.createDataFrame(rows, "f string, k string, star boolean, i int, kw string")
    args = (F.col("star"), F.col("i"), F.col("kw"), F.col("f"))
    names = ["k", "kwargs", "path", "location", "unknown_at", "occurrences"]
    one = merge.merge_occurrences(df, ["k"], *args).select(names)
    two = merge.merge_by_file(df, ["f"], ["k"], *args).select(names)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert two.where("k = 'both'").first()["unknown_at"] == 1


def test_live_board(spark, tmp_path):
    """Events that come twice, late or in a final report count once; a run whose time is over is reported and forgotten."""
    from tessella.streaming import live

    src = tmp_path / "in"
    schema = "run string, event long, kind string, amount double, at timestamp"
    conf = spark.conf.get(incremental.STORE)

    def put(*rows):
        spark.createDataFrame([(r, e, k, a, f"2024-01-01 00:{m:02d}:00") for r, e, k, a, m in rows], "run string, event long, kind string, amount double, at string").coalesce(1).write.mode("append").json(str(src))

    def run():
        seen = []
        spark.conf.set(incremental.STORE, incremental.ROCKS)
        try:
            b = live.board(spark.readStream.schema(schema).json(str(src)), "run", "event", "kind", F.col("amount"), "at", "10 minutes")
            b.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(incremental.STORE, conf)
        return sorted((r["run"], r["kind"], r["n"], r["amount"], r["done"]) for r in seen)

    put(("a", 1, "file", 2.0, 1), ("a", 1, "file", 2.0, 1), ("a", 2, "file", 3.0, 4), ("a", 3, "error", None, 3), ("b", 1, "file", 1.0, 5), (None, 9, "file", 1.0, 5))
    assert run() == [("a", "error", 1, 0.0, False), ("a", "file", 2, 5.0, False), ("b", "file", 1, 1.0, False)]
    put(("a", 2, "file", 3.0, 4), ("a", 4, "file", 1.0, 2), ("b", 1, "file", 1.0, 5))  # a repeat, a late one, a repeat
    assert run() == [("a", "file", 3, 6.0, False)]
    put(("c", 1, "file", 1.0, 30))
    assert run() == [("a", "error", 1, 0.0, True), ("a", "file", 3, 6.0, True), ("b", "file", 1, 1.0, True), ("c", "file", 1, 1.0, False)]
    put(("c", 2, "file", 1.0, 31))
    assert run() == [("c", "file", 2, 2.0, False)]


def test_string_candidates_in_sql(spark):
    from tessella.functions import tables

    tables.register(spark)
    df = spark.createDataFrame([(1, "x", 'f("a", k="b") ["c" d "no" e: "é"'), (2, "y", None), (3, "z", "")], "id int, tag string, body string")
    got = spark.sql("select * from string_candidates(table(select * from {df}) partition by (id), 'body')", df=df)
    assert got.columns == ["id", "tag", "idx", "name", "sign", "string"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", 0, "f", "(", "a"), (1, "x", 1, "k", "=", "b"), (1, "x", 2, None, "[", "c"), (1, "x", 3, "e", ":", "é")]
    with pytest.raises(Exception, match="no column"):
        spark.sql("select * from string_candidates(table(select * from {df}) partition by (id), 'none')", df=df)


def test_counters_ride_along(spark):
    """Each tap has what a count of its own would give, from one job."""
    from tessella.operators.counters import Counters

    c = Counters()
    df = c.tap(spark.range(100), "all", total=F.col("id"))
    some = c.tap(df.where("id % 3 = 0"), "some")
    none = c.tap(some.where("id < 0"), "none", total=F.col("id"))
    none.write.format("noop").mode("overwrite").save()
    assert c.read() == {"all": {"rows": 100, "total": 4950}, "some": {"rows": 34}, "none": {"rows": 0, "total": 0}}
    c = Counters()
    c.tap(spark.range(9).where("id > 10"), "dropped").groupBy("id").count().write.format("noop").mode("overwrite").save()
    assert c.read() in ({"dropped": None}, {"dropped": {"rows": 0}})


def test_observer_hears_batches(spark, tmp_path):
    import time

    from tessella.streaming import observer

    said = []
    listener = observer.Observer(lambda *x: said.append(x))
    spark.streams.addListener(listener)
    try:
        spark.range(5).coalesce(1).write.json(str(tmp_path / "in"))
        q = spark.readStream.schema("id long").json(str(tmp_path / "in")).writeStream.format("memory").queryName("heard").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if any(x[0] == "ended" for x in said):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert said[0][:2] == ("started", "heard") and ("batch", "heard", 0, 5) in said and said[-1] == ("ended", "heard", 0, 5)


def test_nodes_in_two_groups_are_an_error(spark):
    from tessella.operators import build

    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    with pytest.raises(Exception, match="two groups"):
        build.tagged({"a": a, "b": b}, "k").collect()
    assert [r["index"] for r in build.numbered(build.tagged({"a": a, "b": b.selectExpr("k + 5 as k")}, "k"), "k").orderBy("k").collect()] == [0, 1, 2]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["context_window_6_3", "slot_context", "token_stream"])
def test_texts_sum_up_in_their_rows(spark, sf, name):
    """No row of a token or window is made, so what is sorted and shuffled is a row a text."""
    from tessella.plans import catalogue

    assert "Generate" not in plan_of(catalogue.queries()[name](spark, sf))


def test_hashed_features_travel_by_text(spark, sf):
    """What is shuffled are a text's buckets: nothing is hashed in a row of its own."""
    from tessella.plans import catalogue

    assert "md5" not in plan_of(catalogue.queries()["hashed_features_tanh"](spark, sf))


def test_window_and_slot_totals(spark):
    """Against the windows one by one, with empty, null, short and repeated texts, and at pieces of few tokens."""
    rows = [(1, "b a c"), (2, ""), (3, None), (4, "x"), (5, "a, b. c (d e) f g h i j"), (5, "z y"), (6, "one two " * 9)]
    df = tokens.sequences(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", "text")
    w = tokens.windows(df, "id", 6, 3)
    want = w.groupBy("id").agg(F.sum(F.size("before")), F.sum(F.size("after")), F.count(F.lit(1)), F.min(F.array_join("before", " ")))
    assert sorted(map(tuple, tokens.window_totals(df, "id", 6, 3).collect())) == sorted(map(tuple, want.collect()))
    s = tokens.windows(df, "id", 6, 0).select("id", tokens.slots(F.col("before"), 6).alias("s"))
    want = s.groupBy("id").agg(F.count(F.lit(1)), F.count(F.get("s", 0)), F.count(F.get("s", 5)), F.max(F.get("s", 5)))
    assert sorted(map(tuple, tokens.slot_totals(df, "id", 6).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("again", [False, True])
def test_token_totals(spark, again):
    """An id of several rows counts a token that they share once; null is an id."""
    rows = [(1, "a b a"), (2, None), (3, ""), (None, "c c"), (4, "x y")] + [(4, "y z z z"), (None, "c d")] * again
    df = spark.createDataFrame(rows, "id long, text string")
    x = tokens.token_stream(df, "id", "text").groupBy("id").agg(F.count(F.lit(1)), F.max("idx").cast("long"), F.count_distinct("token"))
    assert set(map(tuple, tokens.token_totals(df, "id", "text").collect())) == set(map(tuple, x.collect()))


def test_bracket_kernels_take_a_batch_by_pieces(monkeypatch):
    """Pieces of few codes give what the whole batch gives, and no kernel holds more at once than a piece or one text."""
    import numpy as np
    import pyarrow as pa

    from tessella.operators import brackets as B

    rng = np.random.default_rng(3)
    code = pa.array([None if n % 9 == 8 else rng.choice([-1, 0, 1, 2, 3], rng.integers(0, 30)).tolist() for n in range(60)], pa.list_(pa.int8()))
    text = pa.array([None if n % 9 == 8 else "".join(rng.choice(list("a,()[]é"), rng.integers(0, 30))) for n in range(60)])
    kernels = [(B.depth, code), (B.unclamped, code), (B.pairs, code), (B.enclosing, code), (B.in_value, code), (B.top_level_parts, text)]
    whole = [k.func(v).to_pylist() for k, v in kernels]
    seen, rows_of = [], B.rows_of
    monkeypatch.setattr(B, "PIECE", 40)
    monkeypatch.setattr(B, "rows_of", lambda off: seen.append(off[-1]) or rows_of(off))
    assert [k.func(v).to_pylist() for k, v in kernels] == whole
    assert max(seen) <= 60


def test_code_rows_are_made_by_few_files(monkeypatch):
    """A batch of many files is handed on in parts."""
    import pandas as pd

    from tessella.sources import python_code

    monkeypatch.setattr(python_code, "FILES", 4)
    parts = list(python_code.by_files(iter([pd.DataFrame({"file_idx": range(10)}), pd.DataFrame({"file_idx": []})])))
    assert [len(p) for p in parts] == [4, 4, 2]
