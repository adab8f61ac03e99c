"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule rejects documents whose signal is at or over a cutoff. The cutoff is
not a guess: over all labelled good documents of a stratum (here: language) the
rejections k of n are counted for a fixed grid of cutoffs, loosest first, and a
cutoff is certified while the exact binomial test P[Bin(n, alpha) <= k] is at
most delta. Testing in fixed order needs no correction within a rule; delta is
divided by the number of (stratum, rule) pairs and alpha by the number of
rules. So with probability 1 - delta all rules together reject at most alpha of
the good documents of every stratum. Where labels are too few, nothing beyond
the base rules is rejected.

Defined cases: null text has no words and fails the base rule; a null stratum is
a stratum of its own; labels that occur more than once count once, as bad if any
is 0; null labels and labels without a document don't count; an empty table
gives an empty result; equal signals are all rejected or all kept; repeated rows
are judged alike; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.spread import cut

BLANK = r"[\x20\t-\r]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Strata up to this number travel as a broadcast, more in a shuffled join.
BROADCAST_STRATA = 10_000
#: ln(i!) for i < 16; Stirling's series from there on.
EXACT = 16


@dataclass(frozen=True)
class Rule:
    name: str
    signal: str  # SQL over the features
    cutoffs: tuple[float, ...]  # loosest first


#: Fixed grids, chosen without looking at the labels.
RULES = (
    Rule("symbols", "n_symbols / word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.007, 0.005)),
    Rule("dup_lines", "n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("repeats", "n_repeat_words / n_words", (0.3, 0.27, 0.24, 0.21, 0.18, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04)),
    Rule("long_words", "word_chars / n_words", (50.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5, 6.2)),
    Rule("short_words", "n_words / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.33, 0.3, 0.28, 0.26, 0.25)),
)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and the columns of keep."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select(*keep, text.alias("_t"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\t-\r]"))
    b = a.select(*keep, F.array_remove(F.split("_t", BLANK), "").alias("_w"), lines.alias("_l"), F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    n = F.size("_w")
    c = b.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    h = F.col("_h")
    grams = F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    names = [*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    d = c.select(*names, F.coalesce(grams, F.array().cast("array<bigint>")).alias("_g"))
    g = F.col("_g")
    # positions by hash, then those next to an equal hash, in order
    e = d.select(*names, F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"))
    s = F.col("_s")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    f = e.select(*names, F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])).alias("_p"))
    p = F.col("_p")
    gaps = F.aggregate(F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return f.select(*names, F.coalesce(gaps, F.lit(0).cast("long")).alias("n_repeat_words"))


def ln_factorial(x: Column) -> Column:
    """ln(x!) to about 1e-13, relative."""
    import math

    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(EXACT)])
    y = F.greatest(x.cast("double"), F.lit(1.0))
    series = (y + 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5.0)) - 1 / (1680 * F.pow(y, 7.0))
    return F.when(x < EXACT, F.get(small, x.cast("int"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: Column) -> Column:
    """P[Bin(n, p) <= k]; 1 where k >= n p, where no test passes anyway.

    The terms fall from i = k down; after 9 standard deviations and 60 terms
    the rest is under 1e-15 of the sum.
    """
    ln = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * F.log(p) + (n - k) * F.log1p(-p)
    steps = F.least(k, F.ceil(F.lit(9.0) * F.sqrt(n * p)) + 60).cast("int")
    down = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)).alias("term"),
            (acc["total"] + acc["term"] * (k - j + 1) * (1 - p) / ((n - k + j) * p)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(ln) * down)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def certified(feats: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.02, delta: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each stratum: _stratum, cuts (map of rule to its certified cutoff; a rule without one is absent)."""
    spark = feats.sparkSession
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id")
    levels = F.array(*[F.struct(F.lit(r.name).alias("rule"), _level(r).alias("level")) for r in rules])
    # a generator again, so that no filter is pushed into the features
    rows = feats.join(good, "doc_id", "left_semi").select(F.col(stratum).alias("_stratum"), F.inline(F.when(~base_failed(), levels)))
    counts = rows.groupBy("_stratum", "rule", "level").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("_stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("level", "n")).alias("by_level"))
    found = cut(found)  # a few numbers for each stratum and rule
    pairs = found.count() or 1
    grid = spark.createDataFrame([(r.name, i, len(r.cutoffs) - i, float(c)) for r in rules for i, c in enumerate(r.cutoffs)], "rule string, i int, least int, cutoff double")
    k = F.aggregate(F.filter("by_level", lambda x: x["level"] >= F.col("least")), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    tests = found.join(F.broadcast(grid), "rule").withColumn("k", k)
    tests = tests.withColumn("ok", binomial_tail(F.col("n"), F.col("k"), F.lit(alpha / len(rules))) <= delta / pairs)
    inorder = tests.groupBy("_stratum", "rule").agg(F.array_sort(F.collect_list(F.struct("i", "ok", "cutoff"))).alias("t"))
    # the last cutoff before the first that fails
    passed = F.coalesce(F.nullif(F.array_position(F.transform("t", lambda x: x["ok"]), F.lit(False)), F.lit(0)) - 1, F.size("t"))
    chosen = inorder.select("_stratum", "rule", F.get("t", passed.cast("int") - 1)["cutoff"].alias("cutoff")).where("cutoff is not null")
    cuts = chosen.groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    return cut(cuts)


def _signal(r: Rule) -> Column:
    a, b = r.signal.split(" / ")
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _level(r: Rule) -> Column:
    """How many of the rule's cutoffs the signal reaches; it reaches all that are stricter than the loosest reached."""
    x = _signal(r)
    level = F.lit(0)
    for i, c in reversed(list(enumerate(r.cutoffs))):
        level = F.when(x >= c, F.lit(len(r.cutoffs) - i)).otherwise(level)
    return level


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, stratum, counts, base_failed, kept, failed_rules (array of names)."""
    keep = list(dict.fromkeys(["doc_id", stratum]))
    feats = cut(features(docs, keep))
    x = with_verdict(feats, certified(feats, labels, stratum, alpha, delta, rules), stratum, rules)
    return x.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def with_verdict(feats: DataFrame, cuts: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_STRATA else cuts
    x = feats.join(cuts, feats[stratum].eqNullSafe(cuts["_stratum"]), "left")
    failed = F.filter(F.array(*[F.when(_signal(r) >= F.try_element_at("cuts", F.lit(r.name)), F.lit(r.name)) for r in rules]), lambda v: v.isNotNull())
    return x.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with their own columns.

    Cutoffs come from one pass over the features; a second pass computes the
    features again beside the rows, so that no text is shuffled.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    cuts = certified(cut(features(docs, ["doc_id", "lang"])), labels, "lang")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("lang").alias("_lang"), "text")
    x = with_verdict(features(packed, ["_row", "_lang"]), cuts, "_lang")
    # a generator, not a filter: a filter would be pushed down with all features written out in it
    return x.select(F.inline(F.when(F.col("kept"), F.array("_row"))))
