"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed by cell (source, language, topic). Raking scales the
cells until their shares meet the target shares of every source, language and
topic, as far as empty cells allow; the weight of a cell is its fitted share
over its share in the corpus. A document is then taken with the probability
min(1, c * weight of its cell), with c so that the expected tokens meet the
budget, and its draw is a hash of doc_id and seed: the same documents on every
run and cluster, whatever the partitioning.

The cells are few and the documents many: documents are aggregated before the
shuffle, and only cells travel. Up to DRIVER_CELLS cells are fitted on the
driver; more are fitted by DataFrame rounds that never leave the cluster.

Targets are by default the corpus shares to a power under 1, which lifts small
sources, languages and topics. A table without a topic column gets one from the
shape of the text: markup, listing, long or short.

Defined cases: null text has no tokens; a null source, language or topic is the
value '' of its own; a target of 0 or a value without a target gets weight 0 if
targets are given; documents without tokens keep their cell's probability; a
null doc_id draws by its text; rows that repeat a doc_id are drawn alike; empty
tables give empty results; columns that clash with ours don't matter, as only
doc_id, text, source, lang and topic are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.spread import cut, drop

MARGINS = ("source", "lang", "topic")
DRIVER_CELLS = 200_000
WORD = r"[^\x20\t-\r]+"


@dataclass(frozen=True)
class Mix:
    """targets: by margin, {value: share}; a margin without targets takes corpus shares to its power."""

    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    powers: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.7})
    budget: float = 0.5  # expected tokens, as a share of the corpus
    rounds: int = 100
    tolerance: float = 1e-9
    seed: int = 17


def topic_of(text: Column) -> Column:
    """A topic by the shape of a text, where no better one is known."""
    words = F.regexp_count(text, F.lit(WORD))
    marks = F.regexp_count(text, F.lit("[#*$%&|<>{}=]"))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return F.when(marks * 20 > F.length(text), "markup").when(words < lines * 5, "listing").when(words >= 1000, "long").otherwise("short")


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, n_tokens, source, lang, topic, _h (what the draw is made of) of every document, not its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(text)
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")],
        topic.alias("topic"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), text)).alias("_h"),
        *more,
    )
    return base


def drawn(seed: int) -> Column:
    return F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def wanted(share: np.ndarray, names: list[str], margin: str, mix: Mix) -> np.ndarray:
    if margin in mix.targets:
        x = np.array([mix.targets[margin].get(n, 0.0) for n in names])
    else:
        x = np.where(share > 0, share, 0.0) ** mix.powers.get(margin, 1.0) * (share > 0)
    return x / x.sum() if x.sum() > 0 else x


def rake(cells: list[tuple[str, str, str, float]], mix: Mix) -> np.ndarray:
    """Fitted shares of the cells (source, lang, topic, tokens); they sum to 1 unless nothing is wanted."""
    tokens = np.array([c[3] for c in cells], float)
    if not tokens.sum():
        return np.zeros(len(cells))
    share = tokens / tokens.sum()
    codes, targets = [], []
    for k, margin in enumerate(MARGINS):
        names, code = np.unique([c[k] for c in cells], return_inverse=True)
        codes.append(code)
        targets.append(wanted(np.bincount(code, share), names.tolist(), margin, mix))
    x = share.copy()
    for _ in range(mix.rounds):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, x, minlength=len(target))
            worst = max(worst, float(np.abs(now - target).max()))
            x = x * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[code]
        if worst < mix.tolerance:
            break
    return x / x.sum() if x.sum() else x


def scale(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """c with sum(tokens * min(1, c * weight)) = budget, or as near as all of the weighted cells come."""
    some = (weight > 0) & (tokens > 0)
    t, w = tokens[some], weight[some]
    if not len(t):
        return 0.0
    order = np.argsort(-w)
    t, w = t[order], w[order]
    full = np.concatenate([[0.0], np.cumsum(t)])  # tokens of cells taken whole
    part = np.concatenate([np.cumsum((t * w)[::-1])[::-1], [0.0]])
    for k in range(len(t) + 1):
        if k == len(t):
            return 1 / w[-1]
        c = (budget - full[k]) / part[k]
        if c * w[k] <= 1:
            return max(c, 0.0)
    return 0.0


def cells_on_driver(cells: DataFrame, mix: Mix) -> DataFrame:
    rows = sorted((r["source"], r["lang"], r["topic"], float(r["tokens"])) for r in cells.collect())
    fitted = rake(rows, mix)
    tokens = np.array([r[3] for r in rows])
    total = tokens.sum()
    weight = np.divide(fitted * total, tokens, out=np.zeros(len(rows)), where=tokens > 0)
    c = scale(tokens, weight, mix.budget * total)
    out = [(*r[:3], float(w), float(min(1.0, c * w))) for r, w in zip(rows, weight, strict=True)]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, weight double, probability double")


def cells_on_cluster(cells: DataFrame, mix: Mix) -> DataFrame:
    """The same for any number of cells, by the same rounds, tolerance and scale: each margin is an aggregate joined back, each round a scratch table."""
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) or 1.0
    x = cells.withColumn("x", F.col("tokens") / total)
    target = {}
    for margin in MARGINS:
        t = x.groupBy(margin).agg(F.sum("x").alias("t"))
        if margin in mix.targets:
            given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in mix.targets[margin].items()] or [("", 0.0)], f"{margin} string, g double")
            t = t.join(given, margin, "left").select(margin, F.coalesce("g", F.lit(0.0)).alias("t"))
        else:
            t = t.select(margin, F.when(F.col("t") > 0, F.pow("t", F.lit(mix.powers.get(margin, 1.0)))).otherwise(0.0).alias("t"))
        norm = t.agg(F.sum("t")).first()[0] or 1.0
        target[margin] = cut(t.withColumn("t", F.col("t") / norm))
    x = cut(x)
    for _ in range(mix.rounds):
        last, worst = x, 0.0
        for margin in MARGINS:
            now = x.groupBy(margin).agg(F.sum("x").alias("m"))
            f = now.join(target[margin], margin).select(margin, F.when(F.col("m") > 0, F.col("t") / F.col("m")).otherwise(0.0).alias("f"))
            x = x.join(f, margin).withColumn("x", F.col("x") * F.col("f")).drop("f")
            worst = max(worst, now.join(target[margin], margin).agg(F.max(F.abs(F.col("m") - F.col("t")))).first()[0] or 0.0)
        x = cut(x)
        drop(last)
        if worst < mix.tolerance:
            break
    norm = x.agg(F.sum("x")).first()[0] or 1.0
    w = cut(x.select(*MARGINS, "tokens", F.when(F.col("tokens") > 0, F.col("x") / norm * total / F.col("tokens")).otherwise(0.0).alias("weight")))
    c = scale_on_cluster(w.where("weight > 0 and tokens > 0"), mix.budget * total)
    return w.select(*MARGINS, "weight", F.least(F.lit(1.0), F.col("weight") * c).alias("probability"))


def scale_on_cluster(w: DataFrame, budget: float) -> float:
    """scale() by sums over the cells: c only grows, by the cells that are taken whole under it, until they stay the same."""
    c, full = 0.0, -1
    while True:
        whole = F.col("weight") * c > 1
        r = w.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(~whole, F.col("tokens") * F.col("weight"))), F.count_if(whole), F.min("weight")).first()
        if r[3] is None:
            return 0.0
        if r[2] == full:
            return c
        full = r[2]
        if r[1] is None or budget < r[0]:
            return 1 / r[3]
        c = (budget - r[0]) / r[1]


def calibrated(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, source, lang, topic, weight, probability, sampled."""
    mix = mix or Mix()
    rows = cut(measured(docs))
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    n = cells.count()
    fitted = F.broadcast(cells_on_driver(cells, mix)) if n <= DRIVER_CELLS else cells_on_cluster(cells, mix)
    x = rows.join(fitted, list(MARGINS))
    return x.select("doc_id", "n_tokens", *MARGINS, "weight", "probability", (drawn(mix.seed) < F.col("probability")).alias("sampled"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the sampled documents, with their weight and probability.

    The row travels whole in a column of its own, so no name of documents clashes
    with ours; columns named mix_topic, weight or probability are replaced.
    """
    mix = Mix()
    cells = cut(cut(measured(docs)).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    fitted = F.broadcast(cells_on_driver(cells, mix)) if cells.count() <= DRIVER_CELLS else cells_on_cluster(cells, mix)
    x = measured(docs, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    x = x.join(fitted, list(MARGINS)).where(drawn(mix.seed) < F.col("probability"))
    return x.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("mix_topic", "weight", "probability")], F.col("topic").alias("mix_topic"), "weight", "probability")
