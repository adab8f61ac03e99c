"""Building a signed graph from tables: tagged nodes, dense numbers, kept pairs and their rows, fan-in by threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.series import ranked


def tagged(groups: dict[str, DataFrame], key: str) -> DataFrame:
    """The groups one after the other, each row with its group and the group's place; a key in two rows is an error when rows are read."""
    parts = [df.select(F.col(key), F.lit(name).alias("group"), F.lit(i).alias("place"), *[c for c in df.columns if c != key]) for i, (name, df) in enumerate(groups.items())]
    x = reduce(DataFrame.unionByName, parts)
    n = x.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    once = F.assert_true(F.col("_n") == 1, F.lit("a node is in two groups"))
    return x.join(n, key).withColumn("_ok", once).where("_ok is null").drop("_n", "_ok")


def numbered(nodes: DataFrame, key: str) -> DataFrame:
    """index: the place of each node in the order of (group, key), from 0."""
    x = nodes.withColumn("_order", F.struct("place", key))
    return ranked(x, "_order").withColumn("index", F.col("rank") - 1).drop("_order", "rank")


def signed(pairs: DataFrame, nodes: DataFrame, src: str, dst: str, key: str, weight: str, sign: str) -> DataFrame:
    """(pre, post, weight): pairs by the numbers of their ends, weights with the sign of the source; pairs without a sign go."""
    a = nodes.select(F.col(key).alias(src), F.col("index").alias("pre"), F.col(sign).alias("_sign"))
    b = nodes.select(F.col(key).alias(dst), F.col("index").alias("post"))
    x = pairs.join(a, src).join(b, dst).where("_sign <> 0")
    return x.select("pre", "post", (F.col(weight) * F.col("_sign")).alias(weight))


def rows_of_pairs(rows: DataFrame, kept: DataFrame, ends: list[str]) -> DataFrame:
    """The raw rows behind kept pairs."""
    return rows.join(kept.select(*ends), ends, "left_semi")


def fan_in_sweep(pairs: DataFrame, nodes: DataFrame, dst: str, weight: str, levels: list[int]) -> DataFrame:
    """(node columns, level, inputs): how many sources of each node reach each level, 0 where there are none."""
    counts = pairs.groupBy(dst).agg(*[F.count_if(F.col(weight) >= t).alias(f"_{t}") for t in levels])
    each = F.array(*[F.struct(F.lit(t).alias("level"), F.coalesce(F.col(f"_{t}"), F.lit(0)).alias("inputs")) for t in levels])
    return nodes.join(counts, dst, "left").select(*nodes.columns, F.explode(each).alias("_e")).select(*nodes.columns, "_e.*")


def sweep_report(inputs: DataFrame) -> DataFrame:
    """By level: edges, mean and median inputs, nodes without any. The median is taken from counts of counts."""
    n = inputs.groupBy("level", "inputs").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("level").agg(F.sum(F.col("inputs") * F.col("n")).alias("edges"), F.sum("n").alias("nodes"), F.coalesce(F.sum(F.when(F.col("inputs") == 0, F.col("n"))), F.lit(0)).alias("orphans"), F.array_sort(F.collect_list(F.struct("inputs", "n"))).alias("h"))
    at = lambda rank: F.aggregate("h", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("v")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + x["n"] > rank), x["inputs"]).otherwise(a["v"]).alias("v")), lambda a: a["v"])
    low, high = F.floor((F.col("nodes") - 1) / 2), F.floor(F.col("nodes") / 2)
    return total.select("level", "edges", (F.col("edges") / F.col("nodes")).alias("mean_inputs"), ((at(low) + at(high)) / 2).alias("median_inputs"), "orphans")


def tag_shares(df: DataFrame, id_: str, tags: str, groups: dict[str, list[str]]) -> DataFrame:
    """Of each known tag: occurrences, share in its group and of all, rows that have it, and their share; tags that never occur are there with 0."""
    known = df.sparkSession.createDataFrame([(g, t) for g, names in groups.items() for t in names], "family string, tag string")
    n = df.select(id_, F.explode(tags).alias("tag")).groupBy(id_, "tag").agg(F.count(F.lit(1)).alias("n"))
    n = n.groupBy("tag").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("rows"))
    x = F.broadcast(known).join(n, "tag", "left").na.fill(0, ["occurrences", "rows"])
    family = x.groupBy("family").agg(F.sum("occurrences").alias("_family"))
    x = x.join(family, "family").crossJoin(F.broadcast(x.agg(F.sum("occurrences").alias("_all")))).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_rows"))))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return x.select("family", "tag", "occurrences", share("occurrences", "_family").alias("share"), share("occurrences", "_all").alias("share_all"), "rows", share("rows", "_rows").alias("row_share"))


def braille(rows: Column) -> Column:
    """Up to four rows of booleans as one line: two columns of four dots a character, the last row at the bottom."""
    dots = [[0x01, 0x02, 0x04, 0x40], [0x08, 0x10, 0x20, 0x80]]  # fixed values: bits of the dots, by column
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    top = F.lit(4) - F.size(rows)
    bit = lambda c, dx, dy: F.when(F.coalesce(F.get(F.get(rows, F.lit(dy) - top), c * 2 + dx), F.lit(False)), dots[dx][dy]).otherwise(0)
    code = lambda c: reduce(lambda a, b: a + b, [bit(c, dx, dy) for dx in (0, 1) for dy in range(4)]) + 0x2800
    # a code point as its three bytes of UTF-8
    raw = lambda n: F.decode(F.unhex(F.concat(F.lit("E2"), F.hex(F.lit(0x80) + F.floor((n - 0x2000) / 64)), F.hex(F.lit(0x80) + n % 64))), "UTF-8")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(wide / 2).cast("int") - 1), lambda c: raw(code(c))), "")
