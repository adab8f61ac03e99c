"""Graph building, shares, sections, seeds and other small operators on the driver's tables."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import functions as F

from tessella.functions import hashing
from tessella.functions import text as T
from tessella.operators import build as B
from tessella.operators import merge as M
from tessella.operators import sample as P
from tessella.operators import score as S
from tessella.operators import series
from tessella.plans.graph_queries import PAIRS, pairs
from tessella.plans.registry import query, stored, table
from tessella.streaming import observer

LEVELS = [5, 10, 20, 40, 60]
NODES = "select s_suppkey k, 'in' as grp, 0 place, case when s_acctbal < 0 then -1 when s_nationkey = 0 then 0 else 1 end sgn from supplier union all select 1000000000 + p_partkey, 'out', 1, 1 from part"


def nodes(spark, d):
    """Suppliers and parts as the nodes of one graph; parts are numbered apart."""
    sign = F.when(F.col("s_acctbal") < 0, -1).when(F.col("s_nationkey") == 0, 0).otherwise(1)
    a = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), sign.alias("sgn"))
    b = table(spark, d, "part").select((F.lit(1_000_000_000) + F.col("p_partkey")).cast("bigint").alias("k"), F.lit(1).alias("sgn"))
    return B.numbered(B.tagged({"in": a, "out": b}, "k"), "k")


@query("network_nodes", f"select k, grp as \"group\", row_number() over (order by place, k) - 1 as \"index\" from ({NODES})")
def network_nodes(spark, d):
    return nodes(spark, d).select("k", "group", "index")


def kept(spark, d):
    return pairs(spark, d).where("l_quantity >= 20").select("l_suppkey", (F.lit(1_000_000_000) + F.col("l_partkey")).alias("l_partkey"), "l_quantity")


@query("network_edges", f"with n as (select *, row_number() over (order by place, k) - 1 i from ({NODES})) select a.i pre, b.i post, l_quantity * a.sgn as l_quantity from ({PAIRS} having sum(l_quantity) >= 20) p join n a on a.k = p.l_suppkey join n b on b.k = 1000000000 + p.l_partkey where a.sgn <> 0")
def network_edges(spark, d):
    return B.signed(kept(spark, d), nodes(spark, d), "l_suppkey", "l_partkey", "k", "l_quantity", "sgn")


@query("rows_of_kept_pairs", f"select l_returnflag, count(*) n from lineitem semi join ({PAIRS} having sum(l_quantity) >= 40) using (l_suppkey, l_partkey) group by l_returnflag")
def rows_of_kept_pairs(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return B.rows_of_pairs(rows, pairs(spark, d).where("l_quantity >= 40"), ["l_suppkey", "l_partkey"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("edge_scan_between", "select (select count(*) from lineitem) total, count(*) between_nodes, count(distinct (l_suppkey, l_partkey)) pairs from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey < 12) and l_partkey in (select p_partkey from part where p_size <= 25)")
def edge_scan_between(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    a = table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"))
    b = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    x = li.join(a, "l_suppkey", "left_semi").join(b, "l_partkey", "left_semi").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    out = x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("between_nodes"), F.count(F.lit(1)).alias("pairs"))
    return li.agg(F.count(F.lit(1)).alias("total")).crossJoin(out)


FAN_IN = f"select p.p_partkey, p.p_brand, t.level, count(x.l_partkey) inputs from part p cross join (values (5), (10), (20), (40), (60)) t(level) left join ({PAIRS}) x on x.l_partkey = p.p_partkey and x.l_quantity >= t.level group by all"


def fan_in(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return B.fan_in_sweep(pairs(spark, d), parts, "l_partkey", "l_quantity", LEVELS)


@query("fan_in_sweep", f"select level, sum(inputs)::bigint edges, round(avg(inputs), 9) mean_inputs, median(inputs) median_inputs, count(*) filter (inputs = 0) orphans from ({FAN_IN}) group by level")
def fan_in_sweep(spark, d):
    return B.sweep_report(fan_in(spark, d)).withColumn("mean_inputs", F.round("mean_inputs", 9))


@query("orphans_by_type", f"select level, p_brand, count(*) n from ({FAN_IN}) where inputs = 0 group by all")
def orphans_by_type(spark, d):
    return fan_in(spark, d).where("inputs = 0").groupBy("level", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("merge_by_file", """with o as (select l_suppkey f, l_partkey k, l_returnflag = 'R' star, l_orderkey o, l_linenumber n, l_linestatus kw, (l_suppkey % 7)::varchar p from lineitem)
 select k l_partkey, arg_min(kw, (star, o, n)) kwargs, arg_min(p, (star, o, n)) path, arg_min(o, (star, o, n)) first_order, arg_min(o, (o, n)) filter (star) unknown_order, min(n) filter (star and o = u) unknown_line, count(*) occurrences, count(distinct f) files
 from (select *, min(o) filter (star) over (partition by k) u from o) group by k""")
def merge_by_file(spark, d):
    x = M.merge_by_file(table(spark, d, "lineitem"), ["l_suppkey"], ["l_partkey"], F.col("l_returnflag") == "R", F.struct("l_orderkey", "l_linenumber", *stored()), F.col("l_linestatus"), (F.col("l_suppkey") % 7).cast("string"))
    return x.select("l_partkey", "kwargs", "path", F.col("location.l_orderkey").alias("first_order"), F.col("unknown_at.l_orderkey").alias("unknown_order"), F.col("unknown_at.l_linenumber").alias("unknown_line"), "occurrences", "files")


FAMILIES = {"english": ["the", "and", "of"], "german": ["der", "und", "nicht"], "romance": ["que", "le", "el"], "none": ["qqqqq"]}
TAGS = " union all ".join(f"select '{g}' family, '{t}' tag" for g, names in FAMILIES.items() for t in names)


@query("tag_shares", f"""with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) tag from documents), n as (select tag, count(*) occurrences, count(distinct doc_id) "rows" from w group by tag),
 x as (select f.family, f.tag, coalesce(n.occurrences, 0) occurrences, coalesce(n."rows", 0) "rows" from ({TAGS}) f left join n on n.tag = f.tag)
 select family, tag, occurrences, round(occurrences / greatest(sum(occurrences) over (partition by family), 1), 9) share, round(occurrences / greatest(sum(occurrences) over (), 1), 9) share_all, "rows", round("rows" / (select count(*) from documents), 9) row_share from x""")
def tag_shares(spark, d):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    x = B.tag_shares(table(spark, d, "documents").select("doc_id", words.alias("tags")), "doc_id", "tags", FAMILIES)
    return x.withColumns({c: F.round(c, 9) for c in ("share", "share_all", "row_share")})


@query("pairs_that_differ", """with f as (select doc_id, lang, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+')), lambda x: len(x) > 9) w from documents where text is not null order by md5(doc_id || ':p'), doc_id limit 60)
 select a.doc_id i, b.doc_id j, round(case when len(list_distinct(a.w || b.w)) = 0 then 1.0 else len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::double end, 9) jaccard from f a join f b on a.doc_id < b.doc_id and a.lang is distinct from b.lang""")
def pairs_that_differ(spark, d):
    """A bounded sample of pairs in different languages; two empty sets are alike."""
    w = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda x: F.length(x) > 9)
    p = P.pairs(table(spark, d, "documents").where("text is not null").select("doc_id", "lang", w.alias("w")), "doc_id", 60, differ="lang")
    return p.select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), F.round(S.jaccard(F.col("a.w"), F.col("b.w"), 1.0), 9).alias("jaccard"))


@query("kwargs_membership", """with t as (select conv_id, turn, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'))) w from conversations)
 select a.conv_id, a.turn, count(*) names, count(*) filter (list_contains(b.w, a.x)) known from (select conv_id, turn, unnest(w) x from t) a join t b on b.conv_id = a.conv_id and b.turn = a.turn + 1 group by all""")
def kwargs_membership(spark, d):
    """Of each turn's words, those that the next turn has too."""
    w = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))))
    t = table(spark, d, "conversations").select("conv_id", "turn", w.alias("w"))
    x = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next")), ["conv_id", "turn"]).withColumn("m", S.members(F.col("w"), F.col("next")))
    out = x.select("conv_id", "turn", F.size("m").cast("bigint").alias("names"), F.size(F.filter("m", lambda v: v["known"])).cast("bigint").alias("known"))
    return out.where("names > 0").groupBy("conv_id", "turn").agg(F.sum("names").alias("names"), F.sum("known").alias("known"))


@query("doc_section", """with s as (select doc_id, coalesce(text, '# none') t, '<!-- n:start -->' || chr(10) || coalesce(n_chars, 0) || chr(10) || '<!-- n:end -->' b from documents) select doc_id, md5(regexp_replace(t, '\\s+$', '') || chr(10) || chr(10) || b || chr(10)) once, md5(regexp_replace(t, '\\s+$', '') || chr(10) || chr(10) || replace(b, chr(10) || '<!-- n:end', '0' || chr(10) || '<!-- n:end') || chr(10)) twice from s""")
def doc_section(spark, d):
    """A section put at the end of every text, and then replaced."""
    n = F.coalesce(F.col("n_chars"), F.lit(0)).cast("string")
    x = table(spark, d, "documents").select("doc_id", T.update_section(F.col("text"), "n", F.concat(n, F.lit("\n")), "# none").alias("once"), n.alias("n"))
    return x.select("doc_id", F.md5(F.col("once").cast("binary")).alias("once"), F.md5(T.update_section(F.col("once"), "n", F.concat("n", F.lit("0"))).cast("binary")).alias("twice"))


SALT = int.from_bytes(hashlib.sha256((7).to_bytes(8, "little", signed=True) + b"salt").digest()[:8], "little")
SEED = "(('0x' || substr(h,15,2) || substr(h,13,2) || substr(h,11,2) || substr(h,9,2) || substr(h,7,2) || substr(h,5,2) || substr(h,3,2) || substr(h,1,2))::ubigint)"


@query("salted_seeds", f"select page_id, xor({SEED}, {SALT}::ubigint)::decimal(20,0) seed, 1000000 + page_id * 1000 + 3 argument from (select page_id, sha256(encode(coalesce(url, '')) || '\\x00'::blob || encode(page_id::varchar) || '\\x00'::blob || encode('v1')) h from pages)")
def salted_seeds(spark, d):
    seed = hashing.trial_seed(F.coalesce(F.col("url"), F.lit("")), F.col("page_id"), "v1")
    return table(spark, d, "pages").select("page_id", hashing.salted_seed(seed, 7).alias("seed"), hashing.argument_index(F.col("page_id"), F.lit(3)).alias("argument"))


P0 = S.Membrane(20.0, 5.0, 7.0, 0.275)
PEAK_AT = P0.tau_m * P0.tau_syn / (P0.tau_m - P0.tau_syn) * math.log(P0.tau_m / P0.tau_syn)


@query("threshold_scale", f"select l_suppkey, round({P0.threshold}::double / ({P0.unit}::double * avg(l_quantity) * ({P0.tau_syn}::double / ({P0.tau_m}::double - {P0.tau_syn}::double) * (exp(-{PEAK_AT!r}::double / {P0.tau_m}::double) - exp(-{PEAK_AT!r}::double / {P0.tau_syn}::double)))), 9) scale from lineitem group by l_suppkey")
def threshold_scale(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(S.threshold_scale(F.avg("l_quantity"), P0), 9).alias("scale"))


@query("rate_metrics", "select l_suppkey, max(r) max_rate, median(r) filter (r > 0) median_active, round(avg((r > 0)::int), 9) active from (select l_suppkey, greatest(l_quantity - 25, 0) r from lineitem) group by l_suppkey")
def rate_metrics(spark, d):
    x = table(spark, d, "lineitem").select("l_suppkey", F.greatest(F.col("l_quantity") - 25, F.lit(0)).alias("r"))
    return series.family_rates(x, ["l_suppkey"], "r").withColumn("active", F.round("active", 9))


DOT = " + ".join(f"case when r[{dy + 1}][2 * c + {dx + 1}] > 0 then {bit} else 0 end" for dx, bits in ((0, (1, 2, 4, 64)), (1, (8, 16, 32, 128))) for dy, bit in enumerate(bits))


@query("braille_raster", f"select block, array_to_string([chr((10240 + {DOT})::int) for c in range(0, len(r[4]) // 2)], '') line from (select block, case len(l) when 4 then l when 3 then [null] || l when 2 then [null, null] || l else [null, null, null] || l end r from (select vec_id // 4 block, list(embedding order by vec_id) l from embeddings group by all))")
def braille_raster(spark, d):
    """Four vectors a line, one dot for each dimension over 0."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: F.transform(x["embedding"], lambda v: v > 0))
    x = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("block")).agg(rows.alias("rows"))
    return x.select("block", B.braille(F.col("rows")).alias("line"))


@query("completion_order", "select user_id, list(event_type order by event_id) as \"values\" from events group by user_id")
def completion_order(spark, d):
    """Results come in any order and are listed by their ordinal."""
    x = table(spark, d, "events").select("user_id", "event_id", "event_type").repartition(7)
    return observer.in_order(x, ["user_id"], "event_id", "event_type")
