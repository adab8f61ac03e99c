"""What rows get from the rows before them, without all rows in one task.

Rows are dealt out by ranges of their order; every range is scanned alone, and
what a range needs from those before it is one row, summed up from one row a
range. Running sums, extremes and counts, ranks, medians of groups of any size
and first-row-after look-ups are made of that.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.reconcile import checkpoints

HOW = {"sum": (F.sum, lambda a, b: a + b), "count": (F.count, lambda a, b: a + b), "max": (F.max, max), "min": (F.min, min)}
MEET = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": F.greatest,  # both leave nulls out
    "min": F.least,
}


def running(df: DataFrame, order: list[Column], what: dict[str, tuple[Column, str]]) -> DataFrame:
    """df with, for each name, the sum, count, max or min of a column over all rows before this one.

    order must tell all rows apart. Sums and counts start from 0, extremes from null.
    """
    spark = df.sparkSession
    checkpoints(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the ranges must not change between the two scans, so the rows are written down with theirs
    x = df.withColumns({f"_in_{k}": c for k, (c, _) in what.items()}).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    one = x.groupBy("_range").agg(*[HOW[how][0](f"_in_{k}").alias(k) for k, (_, how) in what.items()]).orderBy("_range").collect()
    carried, now = [], {k: None for k in what}
    for r in one:  # one row a range
        carried.append((r["_range"], *now.values()))
        for k, (_, how) in what.items():
            now[k] = r[k] if now[k] is None else now[k] if r[k] is None else HOW[how][1](now[k], r[k])
    types = dict(x.select(*[HOW[how][0](f"_in_{k}").alias(k) for k, (_, how) in what.items()]).dtypes)
    carry = spark.createDataFrame(carried, ", ".join(["_range int", *(f"_of_{k} {types[k]}" for k in what)]))
    before = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = x.join(F.broadcast(carry), "_range").withColumns({k: MEET[how](F.col(f"_of_{k}"), HOW[how][0](f"_in_{k}").over(before)) for k, (_, how) in what.items()})
    return out.select(*df.columns, *what)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place in the order, from 0."""
    return running(df, order, {name: (F.lit(1), "count")})


def medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): the exact median of the values of each group, nulls left out; a group may hold any share of all rows.

    Equal values of a group are counted first. The values of all groups are then
    numbered by range, and the one or two at the middle of a group are picked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, [*[F.col(c) for c in by], F.col("_v")], {"_at": (F.col("_n"), "sum")})
    sizes = placed.groupBy(*[F.col(c).alias(f"_of_{c}") for c in by]).agg(F.min("_at").alias("_first"), F.sum("_n").alias("_all"))
    x = placed.join(sizes, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]))
    lo, hi = F.col("_at") - F.col("_first"), F.col("_at") - F.col("_first") + F.col("_n")
    left, right = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = x.where((lo <= right) & (hi > left)).select(*by, F.when((lo <= left) & (hi > left), F.col("_v")).alias("_a"), F.when((lo <= right) & (hi > right), F.col("_v")).alias("_b"))
    return middle.groupBy(*by).agg(((F.max("_a") + F.max("_b")) / 2).alias(name))


def orbit(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """(i): all that pointers (i, to) lead to from the starts (i), by doubling: after k rounds a pointer spans 2^k steps."""
    checkpoints(pointers.sparkSession)
    jump = pointers.where("to is not null").select("i", "to").checkpoint()
    found = starts.select("i").checkpoint()
    while True:
        reached = found.join(jump, "i").select(F.col("to").alias("i"))
        if not reached.limit(1).count():
            return found
        found = found.unionByName(reached).distinct().checkpoint()
        jump = jump.join(jump.select(F.col("i").alias("to"), F.col("to").alias("_next")), "to").select("i", F.col("_next").alias("to")).checkpoint()


def greedy_chunks(rows: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """rows with chunk: a chunk of a group closes before the row that would take it past the budget, unless it holds nothing yet.

    Of every row it is found which row would close a chunk that starts there: the
    first whose prefix sum is more than the budget ahead, but at least the one
    after the first row that isn't empty. Those pointers are followed from each
    group's first row.
    """
    x = running(rows, [F.col(by), *[F.col(c) for c in order]], {"_i": (F.lit(1), "count"), "_before": (F.col(size), "sum")}).checkpoint()
    last = x.groupBy(F.col(by).alias("_g")).agg(F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    own = F.col(size) > 0
    asks = x.select(F.col(by).alias("_g"), (F.col("_before") + budget).alias("_v"), F.lit(0).alias("_t"), F.col("_i"))
    rows_at = x.select(F.col(by).alias("_g"), (F.col("_before") + F.col(size)).alias("_v"), F.lit(1).alias("_t"), F.col("_i"))
    # from behind: groups before this one come later, so what was met last is in this group or past its end
    past = running(asks.unionByName(rows_at), [F.desc("_g"), F.desc("_v"), F.asc("_t"), F.desc("_i")], {"_past": (F.when(F.col("_t") == 1, F.col("_i")), "min")}).where("_t = 0").select("_i", "_past")
    full = running(x.select("_i", own.alias("_own")), [F.desc("_i")], {"_later": (F.when(F.col("_own"), F.col("_i")), "min")}).select("_i", F.when(F.col("_own"), F.col("_i")).otherwise(F.col("_later")).alias("_full"))
    to = F.when(F.col("_past").isNotNull() & F.col("_full").isNotNull(), F.greatest("_past", F.col("_full") + 1))
    met = x.select("_i", F.col(by).alias("_g")).join(past, "_i").join(full, "_i").join(last, "_g")
    pointers = met.select(F.col("_i").alias("i"), F.when(to <= F.col("_last"), to).alias("to"))
    begun = orbit(pointers, last.select(F.col("_first").alias("i")))
    marked = x.join(begun.select(F.col("i").alias("_i"), F.lit(1).alias("_mark")), "_i", "left")
    counted = running(marked, [F.col("_i")], {"_marks": (F.coalesce("_mark", F.lit(0)), "sum")}).withColumn("_chunk", F.col("_marks") + F.coalesce("_mark", F.lit(0)))
    base = counted.groupBy(F.col(by).alias("_g")).agg(F.min("_chunk").alias("_base"))
    return counted.join(base, F.col(by) == F.col("_g")).withColumn("chunk", (F.col("_chunk") - F.col("_base")).cast("int")).select(*rows.columns, "chunk")
