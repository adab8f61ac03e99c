"""Ordered and binned operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import series as S
from tessella.plans.registry import query, table


@query("spike_bins_last_bin_absorbs", "select user_id, least(floor((floor(epoch(ts)) - (select min(floor(epoch(ts))) from events)) / 86400), 9)::bigint bin, count(*) n from events group by all")
def spike_bins_last_bin_absorbs(spark, d):
    return S.binned(table(spark, d, "events"), ["user_id"], "ts", 86400, 10)


@query("histogram_half_open", "select case when n_chars < 100 then 0 when n_chars < 500 then 1 when n_chars < 1000 then 2 when n_chars < 5000 then 3 else 4 end bin, count(*) n from documents group by all")
def histogram_half_open(spark, d):
    return S.histogram(table(spark, d, "documents"), "n_chars", [100, 500, 1000, 5000])


@query("family_shares", "select event_type, n, round(n / sum(n) over (), 9) share, users from (select event_type, count(*) n, count(distinct user_id) users from events group by all)")
def family_shares(spark, d):
    x = S.shares(table(spark, d, "events"), "event_type", "user_id")
    return x.select("event_type", "n", F.round("share", 9).alias("share"), F.col("members").alias("users"))


@query("early_stop_running_best", "with s as (select floor(epoch(ts) / 86400)::bigint as \"day\", round(avg(value), 6) v from events group by 1), b as (select *, max(v) over (order by day rows between unbounded preceding and 1 preceding) prev from s), i as (select *, max(case when prev is null or v > prev then day end) over (order by day) best_day from b) select day, v, day - best_day since, (day - best_day) >= 3 stop from i")
def early_stop_running_best(spark, d):
    daily = table(spark, d, "events").groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return S.early_stop(daily, "day", "v", 3)


@query("recent_k_per_group", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 3")
def recent_k_per_group(spark, d):
    return S.recent(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type")


@query("candidate_ordinal", "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 ordinal from events")
def candidate_ordinal(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"))


@query("multi_key_sort_nulls_first", "select o_orderkey, row_number() over (partition by o_orderpriority order by case when o_orderstatus = 'P' then null else o_orderstatus end nulls first, o_totalprice desc, o_orderkey) rank from orders")
def multi_key_sort_nulls_first(spark, d):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    w = Window.partitionBy("o_orderpriority").orderBy(status.asc_nulls_first(), F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("rank"))


@query("calibrate_choose", "select l_shipmode, arg_max(grid, (ok, -abs(rate - 0.05))) chosen, count(*) points from (select l_returnflag l_shipmode, l_linenumber grid, avg(l_discount) rate, (avg(l_tax) < 0.05)::int ok from lineitem group by all) group by all")
def calibrate_choose(spark, d):
    grid = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode"), F.col("l_linenumber").alias("grid")).agg(F.avg("l_discount").alias("rate"), F.when(F.avg("l_tax") < 0.05, 1).otherwise(0).alias("ok"))
    return S.chosen(grid, ["l_shipmode"], "grid", F.struct("ok", (-F.abs(F.col("rate") - 0.05)).alias("near")))


@query("run_counters", "select count(*) walked, count(*) filter (contains(text, '|')) prefiltered, count(distinct source) sources, sum(len(text))::bigint characters from documents")
def run_counters(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("walked"), F.count_if(F.col("text").contains("|")).alias("prefiltered"), F.count_distinct("source").alias("sources"), F.sum(F.length("text")).alias("characters"))


@query(
    "greedy_chunks",
    """with recursive o as (select source, doc_id, coalesce(n_chars, 0) s, row_number() over (partition by source order by doc_id) r from documents),
    c(source, r, doc_id, held, chunk) as (select source, r, doc_id, s::bigint, 0 from o where r = 1 union all
     select o.source, o.r, o.doc_id, case when c.held > 0 and c.held + o.s > 20000 then o.s else c.held + o.s end, case when c.held > 0 and c.held + o.s > 20000 then c.chunk + 1 else c.chunk end from c join o on o.source = c.source and o.r = c.r + 1)
    select source, doc_id, chunk from c""",
)
def greedy_chunks(spark, d):
    return S.numbered_chunks(table(spark, d, "documents"), "source", ["doc_id"], "n_chars", 20_000)
