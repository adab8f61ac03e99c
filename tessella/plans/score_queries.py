"""Scores, votes, samples and metrics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import sample as B
from tessella.operators import score as S
from tessella.plans.registry import query, table

#: Weights for the 64 first dimensions, by rule.
WEIGHTS = [((7 * i) % 11 - 5) / 10 for i in range(64)]
SQL_W = "[" + ", ".join(f"{w}::double" for w in WEIGHTS) + "]"
SQL_MARGIN = f"list_sum([embedding[i]::double * ({SQL_W})[i] for i in range(1, 65)]) + 0.05"
NOISE = "(((('0x' || substr(md5(vec_id::varchar || ':' || n), 1, 8))::bigint % 1000) - 500) / 5000.0::double)"


def margins(spark, d):
    v = F.slice("embedding", 1, 64)
    return table(spark, d, "embeddings").select("vec_id", "label", S.margin(v, WEIGHTS, 0.05).alias("m"))


@query("margin_linear", f"select vec_id, round({SQL_MARGIN}, 6) m, {SQL_MARGIN} > 0 positive from embeddings")
def margin_linear(spark, d):
    return margins(spark, d).select("vec_id", F.round("m", 6).alias("m"), (F.col("m") > 0).alias("positive"))


@query("unsure_threshold", f"select round(percentile_disc(0.1) within group (order by abs(m)), 6) theta from (select {SQL_MARGIN} m from embeddings)")
def unsure_threshold(spark, d):
    return S.threshold(margins(spark, d), F.col("m"), 0.1).select(F.round("theta", 6).alias("theta"))


@query(
    "resniff_vote",
    f"with m as (select vec_id, {SQL_MARGIN} m from embeddings), v as (select vec_id, m + {NOISE} vote from (select *, 0 n from m)), w as (select vec_id, vote from v union all select vec_id, m + {NOISE} from (select m.*, unnest(range(1, 6)) n from m join v using (vec_id) where abs(v.vote) < 0.3)) select vec_id, round(sum(vote), 6) vote, count(*) evaluations, sum(vote) > 0 verdict from w group by vec_id",
)
def resniff_vote(spark, d):
    noise = lambda n: (F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(":"), n.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(1000)) - 500) / 5000.0
    x = S.revoted(margins(spark, d), ["vec_id"], lambda n: F.col("m") + noise(n), 0.3, 5)
    return x.withColumn("vote", F.round("vote", 6))


@query("cascade_two_stage", "select conv_id, turn, list_sort(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: len(x) > 8)) kept from conversations where role = 'user' and text is not null")
def cascade_two_stage(spark, d):
    x = table(spark, d, "conversations").where("text is not null").withColumn("words", F.split(F.lower("text"), "[^a-z]+"))
    return S.cascade(x, ["conv_id", "turn"], "words", F.col("role") == "user", lambda w: F.length(w) > 8)


RULE = "select d.doc_id, l.quality = 1 truth, d.n_chars >= 200 and contains(d.text, '.') guess, d.n_chars, d.lang, d.source from documents d join labels l using (doc_id)"


def judged(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return x.select("doc_id", (F.col("quality") == 1).alias("truth"), ((F.col("n_chars") >= 200) & F.col("text").contains(".")).alias("guess"), "n_chars", "lang", "source")


@query("confusion_prf", f"select lang, tp, fp, fn, tn, coalesce(round(tp / nullif(tp + fp, 0)::double, 9), 0) as precision, coalesce(round(tp / nullif(tp + fn, 0)::double, 9), 0) recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 9), 0) f1 from (select lang, count(*) filter (truth and guess) tp, count(*) filter (not truth and guess) fp, count(*) filter (truth and not guess) fn, count(*) filter (not truth and not guess) tn from ({RULE}) group by lang)")
def confusion_prf(spark, d):
    x = S.confusion(judged(spark, d), F.col("truth"), F.col("guess"), ["lang"])
    return x.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("worst_n_by_margin", f"select doc_id, n_chars from ({RULE}) where truth <> guess order by abs(n_chars) desc, doc_id limit 10")
def worst_n_by_margin(spark, d):
    return S.worst(judged(spark, d), F.col("truth") != F.col("guess"), F.col("n_chars"), ["doc_id"], 10).select("doc_id", "n_chars")


@query("error_categories_topk", f"select source || '/' || lang category, count(*) n from ({RULE}) where truth <> guess group by all order by n desc, category limit 15")
def error_categories_topk(spark, d):
    return S.categories(judged(spark, d).where("truth <> guess"), F.concat("source", F.lit("/"), "lang"), 15)


@query("balance_3_to_1", "select doc_id, quality from (select doc_id, quality, row_number() over (partition by quality order by md5(doc_id || ':b'), doc_id) r, (select min(n) from (select count(*) n from labels group by quality)) m from labels) where r <= 3 * m")
def balance_3_to_1(spark, d):
    return B.balanced(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality")


@query("group_split_80_10_10", "select conv_id, turn, case when f < 80 then 'train' when f < 90 then 'val' else 'test' end split from (select conv_id, turn, ('0x' || substr(md5(conv_id || ':s'), 1, 8))::bigint * 100 / 4294967296.0::double f from conversations)")
def group_split_80_10_10(spark, d):
    return B.group_split(table(spark, d, "conversations"), "conv_id").select("conv_id", "turn", "split")


@query("capped_negatives", "(select doc_id from labels where quality = 0) union all (select doc_id from labels where quality = 1 order by md5(doc_id || ':c'), doc_id limit greatest(0, 200 - (select count(*) from labels where quality = 0)))")
def capped_negatives(spark, d):
    return B.capped(table(spark, d, "labels"), F.col("quality") == 0, "doc_id", 200).select("doc_id")


@query("replicate_seeds", "select doc_id, quality, s::int seed from labels, unnest([1, 2, 3]) t(s)")
def replicate_seeds(spark, d):
    return B.replicated(table(spark, d, "labels"), [1, 2, 3]).select("doc_id", "quality", "seed")


@query(
    "pair_jaccard",
    "with f as (select doc_id, lang, list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')) w from documents where text is not null order by md5(doc_id || ':p'), doc_id limit 70) select a.doc_id i, b.doc_id j, round(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(a.w || b.w)), 1)::double, 9) jaccard, a.lang = b.lang same from f a join f b on a.doc_id < b.doc_id",
)
def pair_jaccard(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", F.array_distinct(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    p = B.pairs(x, "doc_id", 70)
    return p.select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), F.round(S.jaccard(F.col("a.w"), F.col("b.w")), 9).alias("jaccard"), (F.col("a.lang") == F.col("b.lang")).alias("same"))


@query("holdout_disjoint", "select doc_id from documents where doc_id in (select doc_id from labels)")
def holdout_disjoint(spark, d):
    return B.overlap(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("feature_modes", "select vec_id, round(list_sum([case when e > 0 then 1.0::double else 0 end for e in embedding]), 6) n_on, round(list_sum([ln(1 + greatest(e, 0)::double) for e in embedding]), 4) logs, 2 * len(embedding) as width from embeddings")
def feature_modes(spark, d):
    e = F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0)).cast("double"))
    total = lambda mode: F.aggregate(S.feature_modes(e, mode), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(total("binary"), 6).alias("n_on"), F.round(total("log1p"), 4).alias("logs"), F.size(S.feature_modes(e, "both")).cast("bigint").alias("width"))


@query("bit_pack", "select vec_id, list_sum([case when embedding[i] > 0 then (1::bigint << ((i - 1) % 32)) else 0 end for i in range(32 * w + 1, 32 * w + 33)])::bigint bits, bit_count(list_sum([case when embedding[i] > 0 then (1::bigint << ((i - 1) % 32)) else 0 end for i in range(32 * w + 1, 32 * w + 33)])::bigint)::int n, w::int word from embeddings, unnest(range(0, (len(embedding) + 31) // 32)) u(w)")
def bit_pack(spark, d):
    """All dimensions, 32 a word."""
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 32).cast("int") - 1), lambda w: S.packed(F.transform(F.slice("embedding", w * 32 + 1, F.lit(32)), lambda x: x > 0)))
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(words).alias("word", "bits"))
    return x.select("vec_id", "word", "bits", F.bit_count("bits").alias("n"))


@query("active_fraction_masked", "select label, round(avg(f), 9) active, round(coalesce(avg(f) filter (f > 0.4), 0), 9) active_non_empty from (select label, list_sum([case when e > 0 then 1 else 0 end for e in embedding]) / len(embedding)::double f from embeddings) group by label")
def active_fraction_masked(spark, d):
    f = F.aggregate("embedding", F.lit(0), lambda a, x: a + F.when(x > 0, 1).otherwise(0)) / F.size("embedding")
    x = table(spark, d, "embeddings").select("label", f.alias("f"))
    return x.groupBy("label").agg(F.round(F.avg("f"), 9).alias("active"), F.round(F.coalesce(F.avg(F.when(F.col("f") > 0.4, F.col("f"))), F.lit(0.0)), 9).alias("active_non_empty"))
