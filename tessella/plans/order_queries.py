"""Queries over what rows before and nodes behind bring: closures, ordered folds, chunks of one long run, medians of hot groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import tables
from tessella.operators import counters, hooks, prefix, reach, series, sparse
from tessella.plans.registry import query, table

FOLLOWS = """e(src, dst) as (select distinct l_partkey, after from (select l_partkey, l_quantity, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) after from lineitem) where l_quantity >= 49 and after is not null)"""


def follows(spark, d):
    """A directed graph with cycles: after a large line of an order, the part of its next line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").withColumn("dst", F.lead("l_partkey").over(w))
    return li.where("l_quantity >= 49 and dst is not null").select(F.col("l_partkey").alias("src"), "dst").distinct()


@query(
    "reference_closure",
    f"""with recursive {FOLLOWS}, r(root, node) as (select p_partkey, p_partkey from part union select r.root, e.dst from r join e on e.src = r.node),
     c as (select a.root, min(a.node) component from r a join r b on a.root = b.node and a.node = b.root group by a.root),
     b as (select r.root, list_sort(list_distinct(list(p.p_brand))) brands from r join part p on p.p_partkey = r.node group by r.root)
     select root p_partkey, component, brands from c join b using (root)""",
)
def reference_closure(spark, d):
    """Every part's strongly connected component, and the brands of all parts that it leads to."""
    part = table(spark, d, "part")
    of, sets = reach.gathered(follows(spark, d), part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("value")))
    brands = sets.groupBy("component").agg(F.array_sort(F.collect_set("value")).alias("brands"))
    return of.join(brands, "component").select(F.col("node").alias("p_partkey"), "component", "brands")


@query(
    "ordered_fold",
    """with o as (select user_id, event_type, event_id, ts, lag(event_type) over w before from events window w as (partition by user_id order by ts, event_id))
     select user_id, arg_min(event_type, (ts, event_id)) as "first", arg_max(event_type, (ts, event_id)) as "last", count(*) filter (before <> event_type) changes, count(*) n from o group by user_id""",
)
def ordered_fold(spark, d):
    """First and last event and the number of changes of each user: a fold over ordered rows whose parts join, but don't commute."""

    def step(state, row):
        return join(state, [row.event_type, row.event_type, "0", "1"])

    def join(a, b):
        a, b = list(a), list(b)
        if not a or not b:
            return a or b
        return [a[0], b[1], str(int(a[2]) + int(b[2]) + (a[1] != b[0])), str(int(a[3]) + int(b[3]))]

    x = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    out = hooks.folded(x, ["user_id"], ["ts", "event_id"], step, [], "array<string>", neutral=[], reduce=join)
    v = F.col("value")
    return out.select("user_id", v[0].alias("first"), v[1].alias("last"), v[2].cast("bigint").alias("changes"), v[3].cast("bigint").alias("n"))


@query(
    "chunks_of_one_run",
    """with recursive o as (select doc_id, coalesce(n_chars, 0) s, row_number() over (order by doc_id) r from documents),
     c(r, doc_id, held, chunk) as (select r, doc_id, s::bigint, 0 from o where r = 1 union all
      select o.r, o.doc_id, case when c.held > 0 and c.held + o.s > 20000 then o.s else c.held + o.s end, case when c.held > 0 and c.held + o.s > 20000 then c.chunk + 1 else c.chunk end from c join o on o.r = c.r + 1)
     select doc_id, chunk from c""",
)
def chunks_of_one_run(spark, d):
    """All documents as one run: greedy chunks by pointers, in all tasks."""
    x = table(spark, d, "documents").select(F.lit("all").alias("run"), "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return prefix.greedy_chunks(x, "run", ["doc_id"], "n_chars", 20_000).select("doc_id", "chunk")


@query(
    "slot_profile",
    """select l_linenumber slot, l_returnflag flag, count(*) n, round(avg(l_extendedprice), 6) mean, median(l_extendedprice) median, round(avg(l_quantity) filter (l_discount > 0.05), 6) conditional_mean, count(*) filter (l_quantity = 0) silent from lineitem group by all
     union all select l_linenumber, 'all', count(*), round(avg(l_extendedprice), 6), median(l_extendedprice), round(avg(l_quantity) filter (l_discount > 0.05), 6), count(*) filter (l_quantity = 0) from lineitem group by l_linenumber""",
)
def slot_profile(spark, d):
    """Means, conditional means and exact medians by slot and flag, and of all flags together."""
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("slot"), F.explode(F.array("l_returnflag", F.lit("all"))).alias("flag"), "l_extendedprice", "l_quantity", "l_discount")
    return series.profile(li, ["slot", "flag"], "l_extendedprice", F.when(F.col("l_discount") > 0.05, F.col("l_quantity")), F.col("l_quantity") == 0).withColumns({c: F.round(c, 6) for c in ("mean", "conditional_mean")})


@query(
    "string_candidates",
    r"""with l as (select page_id, regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_-]*)?[ ]*([(\[{,=:])[ ]*"([^"\n]*)"', 1) a, regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_-]*)?[ ]*([(\[{,=:])[ ]*"([^"\n]*)"', 2) b, regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_-]*)?[ ]*([(\[{,=:])[ ]*"([^"\n]*)"', 3) c from pages)
     select page_id, (unnest(range(1, len(a) + 1)) - 1)::int idx, nullif(unnest(a), '') as name, unnest(b) sign, unnest(c) as "string" from l""",
)
def string_candidates(spark, d):
    """The strings after brackets, commas and equals signs in the pages' source, by a table function in SQL."""
    tables.register(spark)
    pages = table(spark, d, "pages").select("page_id", "html")
    return spark.sql("select * from string_candidates(table(select page_id, html from {pages}) partition by (page_id), 'html')", pages=pages)


@query(
    "observed_counters",
    "select count(*) walked, count(*) filter (contains(text, '|')) prefiltered, count(*) filter (contains(text, '|') and n_chars >= 300) judged, coalesce(sum(length(text)) filter (contains(text, '|') and n_chars >= 300), 0)::bigint characters from documents",
)
def observed_counters(spark, d):
    """What each step of a run let through, counted by the run itself: one scan and no job beside it."""
    c = counters.Counters()
    walked = c.tap(table(spark, d, "documents").select("text", "n_chars"), "walked")
    named = c.tap(walked.where(F.contains("text", F.lit("|"))), "prefiltered")
    judged = c.tap(named.where("n_chars >= 300"), "judged", characters=F.length("text"))
    judged.write.format("noop").mode("overwrite").save()
    got = c.read()
    row = (got["walked"]["rows"], got["prefiltered"]["rows"], got["judged"]["rows"], got["judged"]["characters"])
    return spark.createDataFrame([row], "walked long, prefiltered long, judged long, characters long")


@query(
    "sparse_gather",
    """with e as (select vec_id, label, unnest(range(0, len(embedding))) col, unnest(embedding) x from embeddings), m as (select max(vec_id) + 1 n from embeddings),
     s as (select vec_id as "row", col, ln(1 + x::double) v from e where x > 0 union all select vec_id + n, col, x::double from e, m where x > 0 and label % 2 = 1),
     w as (select conv_id as "at", (conv_id * 7 + turn) % (2 * n) as "row" from conversations, m where role = 'user')
     select "at", count(*) entries, round(sum(v / (1 + col)), 6) product from w join s using ("row") group by "at\"""",
)
def sparse_gather(spark, d):
    """Two sparse views of the embeddings, stacked; the rows that conversations name, gathered and weighed."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.max("vec_id") + 1).first()[0] or 0
    logs = sparse.built(e, "vec_id", F.col("embedding"), F.log1p(F.col("x").cast("double")))
    plain = sparse.built(e.where("label % 2 = 1"), "vec_id", F.col("embedding"))
    wanted = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("at"), ((F.col("conv_id") * 7 + F.col("turn")) % (2 * n)).alias("row"))
    rows = sparse.gathered(sparse.stacked([(logs, n), (plain, n)]), wanted)
    weights = spark.range(4096).select(F.col("id").cast("int").alias("col"), (F.lit(1.0) / (1 + F.col("id"))).alias("weight"))
    x = rows.groupBy("row").agg(F.count(F.lit(1)).alias("entries"))
    return x.join(sparse.times(rows, F.broadcast(weights)), "row").select(F.col("row").alias("at"), "entries", F.round("product", 6).alias("product"))
