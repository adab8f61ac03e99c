"""Operators over token sequences: a text is one row with an array of its tokens, and its context is found inside that row.

Nothing is shuffled to see a token's neighbours; rows of tokens appear where an
operator returns them, by one explode at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import brackets as B
from tessella.session import ship


def sequences(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, tokens) of every text; texts without tokens have an empty array."""
    ship(df.sparkSession)
    return df.select(id_, T.tokens(F.col(text)).alias("tokens"))


def token_stream(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, idx, token): every token of every text; texts without tokens give no row."""
    return df.select(id_, F.posexplode(T.tokens(F.col(text))).alias("idx", "token"))


def token_totals(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, n, last, kinds): how many tokens an id's texts have, the last index, and how many different tokens.

    A text counts its own tokens in its row. Only an id of several rows needs
    theirs side by side; whether there is one, the ids alone tell.
    """
    t = T.tokens(F.col(text))
    rows = df.select(id_, t.alias("_t")).select(id_, F.size("_t").alias("n"), F.size(F.array_distinct("_t")).alias("kinds"))
    again = df.groupBy(id_).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col(id_).alias("_id"))
    total = lambda x, kinds: x.agg(F.sum("n").alias("n"), (F.max("n") - 1).cast("bigint").alias("last"), kinds.cast("bigint").alias("kinds")).where("n > 0")
    if again.isEmpty():
        return total(rows.groupBy(id_), F.max("kinds"))
    at = F.col(id_).eqNullSafe(F.col("_id"))
    one = total(rows.join(again, at, "left_anti").groupBy(id_), F.max("kinds"))
    several = df.join(again, at, "left_semi").select(id_, F.posexplode(t).alias("idx", "token")).groupBy(id_)
    return one.unionByName(several.agg(F.count(F.lit(1)).alias("n"), F.max("idx").cast("bigint").alias("last"), F.count_distinct("token").alias("kinds")))


def with_codes(df: DataFrame) -> DataFrame:
    """codes: what the bracket kernels need to know of the tokens."""
    return df.withColumn("codes", B.codes(F.col("tokens")))


def with_depth(df: DataFrame) -> DataFrame:
    """depth: by token, the open brackets before it, never under 0 however many close."""
    return with_codes(df).withColumn("depth", B.depth("codes"))


def exploded(df: DataFrame, id_: str, *arrays: str) -> DataFrame:
    """(id, idx, token, ...): a row for each token, with what other arrays have of it."""
    rows = F.posexplode(F.arrays_zip("tokens", *arrays)).alias("idx", "_t")
    return df.select(id_, rows).select(id_, "idx", F.col("_t.tokens").alias("token"), *[F.col(f"_t.{a}").alias(a) for a in arrays])


def matching(df: DataFrame) -> DataFrame:
    """pairs: (open_idx, close_idx, level) of the brackets that close."""
    return with_codes(df).withColumn("pairs", B.pairs("codes"))


def framed(tokens: Column, before: int, after: int) -> Column:
    """By token a struct of idx, token, and its neighbours before and after as arrays, shorter at the ends."""
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            i.alias("idx"),
            t.alias("token"),
            F.slice(tokens, F.greatest(F.lit(1), i - before + 1), F.least(F.lit(before), i)).alias("before"),
            F.slice(tokens, i + 2, F.lit(after)).alias("after"),
        ),
    )


def windows(df: DataFrame, id_: str, before: int, after: int) -> DataFrame:
    """(id, idx, token, before, after): a row for each token."""
    return df.select(id_, F.explode(framed(F.col("tokens"), before, after)).alias("w")).select(id_, "w.*")


def window_totals(df: DataFrame, id_: str, before: int, after: int) -> DataFrame:
    """(id, before_n, after_n, n, first_before): what the windows of an id's tokens hold in all, and the least of what is before a token.

    Each text sums up its windows in its row, so none of them travels or is sorted.
    """
    from tessella.operators import features

    ship(df.sparkSession)
    x = df.select(id_, features.window_totals(before, after)("tokens").alias("t")).select(id_, "t.*")
    return x.groupBy(id_).agg(*[F.sum(c).alias(c) for c in ("before_n", "after_n", "n")], F.min("first_before").alias("first_before")).where("n > 0")


def slot_totals(df: DataFrame, id_: str, size: int) -> DataFrame:
    """(id, n, first_slot, last_slot, top): how often the first and last of `size` right-aligned slots before a token are taken, and the greatest token of the last."""
    from tessella.operators import features

    ship(df.sparkSession)
    x = df.select(id_, features.slot_totals(size)("tokens").alias("t")).select(id_, "t.*")
    return x.groupBy(id_).agg(*[F.sum(c).alias(c) for c in ("n", "first_slot", "last_slot")], F.max("top").alias("top")).where("n > 0")


def slots(context: Column, size: int) -> Column:
    """Right-aligned slots: what is missing is null, on the left."""
    return F.concat(F.array_repeat(F.lit(None).cast("string"), F.greatest(F.lit(0), size - F.size(context))), context)


def outward_depths(df: DataFrame, id_: str, focus: str, before: int = 6, after: int = 3, most: int = 5) -> DataFrame:
    """(id, idx, before, after): around each token `focus`, the depths of its neighbours, walked outward from its own and clipped to 0..most.

    Both brackets of a pair have the level outside it, as seen from the focus.
    """
    x = with_depth(df).withColumn("level", B.unclamped("codes"))
    walk = lambda part, own, base: F.transform(part, lambda s: F.greatest(F.lit(0), F.least(F.lit(most), own + s - base)))
    at = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == focus),
        lambda i: F.struct(
            i.alias("idx"),
            walk(F.slice("level", F.greatest(F.lit(1), i - before + 1), F.least(F.lit(before), i)), F.get("depth", i), F.get("level", i)).alias("before"),
            walk(F.slice("level", i + 2, F.lit(after)), F.get("depth", i), F.get("level", i)).alias("after"),
        ),
    )
    return x.select(id_, F.explode(at).alias("f")).select(id_, "f.*")


def bigrams(df: DataFrame, id_: str) -> DataFrame:
    """(id, previous, token): each token with the one before it, <BOF> at the start."""
    pairs = F.zip_with(F.concat(F.array(F.lit("<BOF>")), F.slice("tokens", 1, F.size("tokens") - 1)), "tokens", lambda p, t: F.struct(p.alias("previous"), t.alias("token")))
    return df.select(id_, F.explode(pairs).alias("b")).select(id_, "b.*")


def runs(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours as one row: by, run, value, n."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).groupBy(*by, "run", value).agg(F.count(F.lit(1)).alias("n"))


def top_level_parts(df: DataFrame, text: str) -> DataFrame:
    """parts: a text split at the commas outside brackets."""
    ship(df.sparkSession)
    return df.withColumn("parts", B.top_level_parts(text))


def enclosing(df: DataFrame) -> DataFrame:
    """open_idx: by token, the opening bracket of the innermost pair around it, or -1."""
    return with_codes(df).withColumn("open_idx", B.enclosing("codes"))


def after_assignment(df: DataFrame) -> DataFrame:
    """in_value: by token, whether on its level, since the last comma or opening bracket, an '=' came before."""
    return with_codes(df).withColumn("in_value", B.in_value("codes"))


def hashed_features(df: DataFrame, id_: str, buckets: int, before: int = 6, after: int = 3) -> DataFrame:
    """(id, bucket, value): weights 1 / (1 + distance) of the tokens around each token, summed by hash bucket, tanh.

    Each token is a neighbour at every offset at which there is a token to
    neighbour. A text sums its own features in its row, and a batch hashes each
    different token once an offset; what is shuffled are a text's buckets.
    """
    from tessella.operators import features

    ship(df.sparkSession)
    rows = df.select(id_, F.explode(features.weights(buckets, before, after)("tokens")).alias("f"))
    return rows.groupBy(id_, F.col("f.bucket").alias("bucket")).agg(F.sum("f.w").alias("w")).select(id_, "bucket", F.round(F.tanh(F.col("w") / 100), 9).alias("value"))


#: Slots that a focus of several elements may take, and the greatest depth that is told apart: fixed values.
FOCUS_SLOTS, MOST_DEPTH = 4, 5


def slot_features(df: DataFrame, id_: str, focus: str, before: int = 6, after: int = 3) -> DataFrame:
    """(id, idx, slot, feature): what a token `focus` and each of its neighbours tell, by slot in source order.

    Neighbours: tok, the token; tok@d, with its offset; type@d, its class; depth@d,
    its outward depth; bi@d, with the token before it, <BOF> at the start of the
    text. The focus has the slots after those before it: its first holds the same
    as focus_*, the last is the summary: length, kind and depth of the focus, and
    whether it comes first in brackets or after an equals sign.
    """
    x = with_depth(df).withColumn("level", B.unclamped("codes"))
    offsets = [d for d in range(-before, after + 1) if d]
    name = lambda tag, *values: F.concat(F.lit(f"{tag}:"), *[v if isinstance(v, Column) else F.lit(v) for v in values])
    kind = lambda token: F.when(~token.rlike(r"^[A-Za-z0-9_]"), "OP").when(token.rlike(r"^[0-9]"), "NUMBER").otherwise("NAME")
    depth = lambda c: F.greatest(F.lit(0), F.least(F.lit(MOST_DEPTH), c)).cast("string")
    rows_of = lambda i, slot, names: F.transform(F.array(*names), lambda f: F.struct(i.alias("idx"), F.lit(slot).alias("slot"), f.alias("feature")))
    before_of = lambda j: F.coalesce(F.get("tokens", j - 1), F.lit("<BOF>"))

    def neighbour(i: Column, d: int) -> Column:
        j, token = i + d, F.get("tokens", i + d)
        deep = depth(F.get("depth", i) + F.get("level", j) - F.get("level", i))
        names = [name("tok", token), name(f"tok@{d}", token), name(f"type@{d}", kind(token)), name(f"depth@{d}", deep), name(f"bi@{d}", before_of(j), "\x1f", token)]
        return F.when((j >= 0) & (j < F.size("tokens")), rows_of(i, d + before if d < 0 else d + before + FOCUS_SLOTS, names)).otherwise(F.array())

    def own(i: Column) -> list[Column]:
        token, deep = F.get("tokens", i), depth(F.get("depth", i))
        flag = lambda c: F.when(c, "1").otherwise("0")
        element = [name("focus_tok@0", token), name("focus_tok", token), name("focus_type@0", kind(token)), name("focus_bi@0", before_of(i), "\x1f", token), name("focus_depth@0", deep)]
        summary = [F.lit("focus_len:1"), name("kind", kind(token)), name("first_positional", flag(before_of(i) == "(")), name("in_kwargs", flag(before_of(i) == "=")), name("depth", deep)]
        return [rows_of(i, before, element), rows_of(i, before + FOCUS_SLOTS, summary)]

    at = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == focus)
    rows = F.flatten(F.transform(at, lambda i: F.concat(*[neighbour(i, d) for d in offsets], *own(i))))
    return x.select(id_, F.explode(rows).alias("f")).select(id_, "f.*")


def ngram_decay(df: DataFrame, id_: str, focus: str, n: int, before: int, tau: float) -> DataFrame:
    """(id, gram, weight): n-grams before a token `focus`, weighing exp(-distance of their last token / tau)."""
    ends = [d for d in range(1, before - n + 2)]
    at = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == focus)
    gram = lambda i, d: F.struct(F.array_join(F.slice("tokens", i - d - n + 2, F.lit(n)), " ").alias("gram"), F.exp(F.lit(-d / tau)).alias("weight"))
    rows = F.flatten(F.transform(at, lambda i: F.concat(*[F.when(i - d - n + 1 >= 0, F.array(gram(i, d))).otherwise(F.array()) for d in ends])))
    return df.select(id_, F.explode(rows).alias("g")).select(id_, "g.*")
