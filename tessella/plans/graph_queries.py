"""Merge, reconciliation and graph operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import merge as M
from tessella.operators import reconcile as R
from tessella.plans.registry import query, stored, table


@query(
    "occurrence_merge_winner",
    """with o as (select l_partkey, l_returnflag = 'R' star, l_orderkey, l_linenumber, l_linestatus kw, (l_suppkey % 7)::varchar p from lineitem)
    select l_partkey, arg_min(kw, (star, l_orderkey, l_linenumber)) kwargs, arg_min(p, (star, l_orderkey, l_linenumber)) path, min(case when star then l_orderkey end) unknown_order, count(*) occurrences from o group by l_partkey""",
)
def occurrence_merge_winner(spark, d):
    li = table(spark, d, "lineitem")
    x = M.merge_occurrences(li, ["l_partkey"], F.col("l_returnflag") == "R", F.struct("l_orderkey", "l_linenumber", *stored()), F.col("l_linestatus"), (F.col("l_suppkey") % 7).cast("string"))
    return x.select("l_partkey", "kwargs", "path", F.col("unknown_at.l_orderkey").alias("unknown_order"), "occurrences")


@query("merge_conflicts", "select l_partkey, paths, kwargs_sets, case when paths > 1 then 'path' else 'kwargs' end kind from (select l_partkey, count(distinct l_suppkey % 3) paths, count(distinct case when l_returnflag <> 'R' then l_linestatus end) kwargs_sets from lineitem group by l_partkey) where paths > 1 or kwargs_sets > 1")
def merge_conflicts(spark, d):
    return M.conflicts(table(spark, d, "lineitem"), ["l_partkey"], F.col("l_returnflag") == "R", F.col("l_linestatus"), F.col("l_suppkey") % 3)


RECONCILE = """with code as (select lang locale, doc_id k, source path, (n_chars % 5)::varchar kwargs from documents where n_chars >= 300),
 stored as (select lang locale, doc_id k, case when doc_id % 7 = 0 then 'old' else source end path, (case when doc_id % 11 = 0 then n_chars + 1 else n_chars end % 5)::varchar kwargs from documents where doc_id in (select doc_id from labels)),
 marked as (select d.lang locale, d.doc_id k from documents d join labels l using (doc_id) where l.quality = 1 group by all),
 r as (select coalesce(a.locale, b.locale) locale, coalesce(a.k, b.k) k, case when b.k is null then 'added' when a.k is null then case when m.k is not null then 'kept' else 'commented' end when a.path is distinct from b.path then 'moved' when a.kwargs is distinct from b.kwargs then 'updated' else 'same' end status
  from code a full join stored b on a.locale = b.locale and a.k = b.k left join marked m on m.locale = coalesce(a.locale, b.locale) and m.k = coalesce(a.k, b.k))"""


def reconciled(spark, d):
    """Code asks for all longer documents, the catalogue has all labelled ones; every seventh moved, every eleventh changed."""
    docs = table(spark, d, "documents")
    code = docs.where("n_chars >= 300").select(F.col("lang").alias("locale"), F.col("doc_id").alias("key"), F.col("source").alias("path"), (F.col("n_chars") % 5).cast("string").alias("kwargs"))
    old = F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("source"))
    n = F.when(F.col("doc_id") % 11 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    stored = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.col("lang").alias("locale"), F.col("doc_id").alias("key"), old.alias("path"), (n % 5).cast("string").alias("kwargs"))
    marked = docs.join(table(spark, d, "labels").where("quality = 1"), "doc_id").select(F.col("lang").alias("locale"), F.col("doc_id").alias("key"))
    return R.reconcile(code, stored, marked)


@query("reconcile_full_outer", RECONCILE + " select locale, k as doc_id, status from r")
def reconcile_full_outer(spark, d):
    return reconciled(spark, d).select("locale", F.col("key").alias("doc_id"), "status")


@query("reconcile_statistics", RECONCILE + " select locale, count(*) filter (status <> 'commented') stored, count(*) filter (status in ('updated', 'moved')) updated, count(*) filter (status = 'added') added, count(*) filter (status in ('commented', 'updated', 'moved')) commented from r group by locale")
def reconcile_statistics(spark, d):
    return R.statistics(reconciled(spark, d))


@query("audit_diff", "select coalesce(a.o_orderkey, b.o_orderkey) o_orderkey, case when b.o_orderkey is null then 'missing' when a.o_orderkey is null then 'invented' else 'differs' end verdict from (select o_orderkey, o_orderstatus s, o_orderpriority p from orders where o_totalprice >= 50000) a full join (select o_orderkey, o_orderstatus s, case when o_orderkey % 6 = 0 then null else o_orderpriority end p from orders where o_orderstatus <> 'P') b on a.o_orderkey = b.o_orderkey where a.o_orderkey is null or b.o_orderkey is null or a.s is distinct from b.s or a.p is distinct from b.p")
def audit_diff(spark, d):
    o = table(spark, d, "orders")
    p = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority"))
    a = o.where("o_totalprice >= 50000").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    b = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderstatus").alias("s"), p.alias("p"))
    return M.diff(a, b, ["o_orderkey"], ["s", "p"])


@query("semi_bucket_attach", "select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders)")
def semi_bucket_attach(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.with_home(table(spark, d, "customer"), orders, "c_custkey").select("c_custkey", "c_mktsegment")


@query("stale_keys", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45) and p_partkey not in (select l_partkey from lineitem where l_discount > 0.095) and p_size <> 1")
def stale_keys(spark, d):
    """Parts that no large return uses, no great discount needs and no mark keeps."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return R.stale(p.select("p_partkey"), li.where("l_returnflag = 'R' and l_quantity > 45"), li.where("l_discount > 0.095"), p.where("p_size = 1"), ["p_partkey"])


@query("duplicate_definitions", "select md5(text) text_md5, doc_id, n from (select text, doc_id, count(*) over (partition by text) n from documents where text is not null) where n > 1")
def duplicate_definitions(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return M.duplicates(x, ["text_md5"], "doc_id")


@query("last_definition", "select o_custkey, arg_max(o_orderstatus, o_orderkey) status, count(*) n from orders group by o_custkey")
def last_definition(spark, d):
    x = table(spark, d, "orders").withColumn("status", F.col("o_orderstatus"))
    return M.last_definition(x, ["o_custkey"], F.col("o_orderkey"), "status")


@query("label_join_exactly_one", "select l.doc_id, l.quality, count(d.doc_id) matches from labels l left join documents d on d.doc_id = l.doc_id group by l.doc_id, l.quality, l.toxic")
def label_join_exactly_one(spark, d):
    x = R.exactly_one(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])
    return x.select("doc_id", "quality", "matches")


@query("dependency_closure", "with recursive e(src, dst) as (select n_nationkey, n_regionkey from nation where n_nationkey <> n_regionkey), r(root, node) as (select n_nationkey, n_nationkey from nation union select r.root, e.dst from r join e on e.src = r.node) select root, node from r")
def dependency_closure(spark, d):
    n = table(spark, d, "nation")
    edges = n.where("n_nationkey <> n_regionkey").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    return R.closure(edges, n.select(F.col("n_nationkey").alias("root")))


PAIRS = "select l_suppkey, l_partkey, sum(l_quantity) l_quantity, count(*) n_rows, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) l_discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 8) l_tax from lineitem group by all"


def pairs(spark, d):
    return G.aggregated(table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax"), ["l_suppkey", "l_partkey"], "l_quantity", ["l_discount", "l_tax"])


@query("edge_weighted_agg", f"{PAIRS} having sum(l_quantity) >= 20")
def edge_weighted_agg(spark, d):
    return pairs(spark, d).where("l_quantity >= 20").withColumns({c: F.round(c, 8) for c in ("l_discount", "l_tax")})


@query(
    "edge_threshold_sweep",
    f"with p as ({PAIRS}), b as (select l_partkey, max(l_quantity) best from p group by all) select t.level::int as level, (select count(*) from p where l_quantity >= t.level) edges, (select round(avg(l_quantity), 6) from p where l_quantity >= t.level) mean_weight, (select count(*) from b where best < t.level) orphans from (values (5), (10), (20), (40), (60)) t(level)",
)
def edge_threshold_sweep(spark, d):
    return G.threshold_sweep(pairs(spark, d), "l_partkey", "l_quantity", [5, 10, 20, 40, 60]).withColumn("mean_weight", F.round("mean_weight", 6))


@query("zero_filled_fan_in", "select p_partkey, count(l_partkey) n from part left join lineitem on p_partkey = l_partkey group by p_partkey")
def zero_filled_fan_in(spark, d):
    return G.fan_in(table(spark, d, "part"), "p_partkey", table(spark, d, "lineitem"), "l_partkey")


@query(
    "argmax_columns_disagreement",
    "with x as (select l_returnflag, case when a >= greatest(b, c) then 'a' when b >= c then 'b' else 'c' end best, case when l_quantity > 25 then 'a' else 'c' end expected from (select *, l_discount * 10 a, l_tax * 10 b, l_quantity / 60 c from lineitem)) select l_returnflag, best, count(*) n, count(*) filter (best = expected) agree from x group by all",
)
def argmax_columns_disagreement(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), (F.col("l_quantity") / 60).alias("c"))
    x = x.withColumn("best", G.strongest(["a", "b", "c"])).withColumn("expected", F.when(F.col("l_quantity") > 25, "a").otherwise("c"))
    return x.groupBy("l_returnflag", "best").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("best") == F.col("expected")).alias("agree"))


@query("value_counts_pivot", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') f, count(*) filter (o_orderstatus = 'O') o, count(*) filter (o_orderstatus = 'P') p from orders group by all")
def value_counts_pivot(spark, d):
    x = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return x.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("node_selection", "with s as (select s_suppkey from supplier where s_nationkey < 12 and s_acctbal > 0), p as (select p_partkey from part where p_size <= 25) select l_suppkey, l_partkey, count(*) n from lineitem where l_suppkey in (from s) and l_partkey in (from p) group by all")
def node_selection(spark, d):
    s = table(spark, d, "supplier").where("s_nationkey < 12 and s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    p = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(s, "l_suppkey", "left_semi").join(p, "l_partkey", "left_semi").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("sparse_drive", f"with p as ({PAIRS}), e as (select s_suppkey, s_nationkey, round(s_acctbal) v from supplier) select s_nationkey, l_partkey, round(sum(v * l_quantity), 3) g from e join p on p.l_suppkey = e.s_suppkey group by all")
def sparse_drive(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", F.round("s_acctbal").alias("v"))
    return G.delivered(e, pairs(spark, d), "s_nationkey", "l_suppkey", "l_partkey", "v", "l_quantity").withColumn("g", F.round("g", 3))


@query("claws_by_k", "with f as (select p_partkey, count(l_partkey) k, coalesce(max(l_quantity), 0) top from part left join lineitem on p_partkey = l_partkey group by all) select k, count(*) n, avg(top) mean_top, count(*) filter (top >= 45)::double / count(*) active from f group by k")
def claws_by_k(spark, d):
    n = G.fan_in(table(spark, d, "part"), "p_partkey", table(spark, d, "lineitem"), "l_partkey")
    top = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("top"))
    x = n.join(top, "p_partkey", "left").select(F.col("n").alias("k"), F.coalesce("top", F.lit(0.0)).alias("top"))
    return x.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("top").alias("mean_top"), F.avg(F.when(F.col("top") >= 45, 1.0).otherwise(0.0)).alias("active"))


@query(
    "referential_and_graph_checks",
    "select 'unknown source' as rule, (select count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier)) n union all select 'unknown target', (select count(*) from lineitem where l_partkey not in (select p_partkey from part)) union all select 'orders without customer', (select count(*) from orders where o_custkey not in (select c_custkey from customer)) union all select 'repeated pair', (select count(*) from (select 1 from lineitem group by l_suppkey, l_partkey having count(*) > 1))",
)
def referential_and_graph_checks(spark, d):
    li = table(spark, d, "lineitem")
    counts = [
        ("unknown source", G.orphans(li, "l_suppkey", table(spark, d, "supplier"), "s_suppkey")),
        ("unknown target", G.orphans(li, "l_partkey", table(spark, d, "part"), "p_partkey")),
        ("orders without customer", G.orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey")),
        ("repeated pair", li.groupBy("l_suppkey", "l_partkey").count().where("count > 1")),
    ]
    out = None
    for name, bad in counts:
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "set_ops_suite",
    "select 'concat' op, count(*) n from (select text from documents union all select text from benchmark) union all select 'union', count(*) from (select text from documents union select text from benchmark) union all select 'except', count(*) from (select doc_id from documents except select doc_id from labels) union all select 'intersect', count(*) from (select doc_id from documents intersect select doc_id from labels) union all select 'expected_less_got', count(*) from (select distinct lang from documents where lang not in (select distinct source from documents))",
)
def set_ops_suite(spark, d):
    docs, bench, labels = (table(spark, d, t) for t in ("documents", "benchmark", "labels"))
    both = docs.select("text").unionByName(bench.select("text"))
    parts = [
        ("concat", both),
        ("union", both.distinct()),
        ("except", docs.select("doc_id").subtract(labels.select("doc_id"))),
        ("intersect", docs.select("doc_id").intersect(labels.select("doc_id"))),
        ("expected_less_got", docs.select("lang").distinct().join(docs.select(F.col("source").alias("lang")).distinct(), "lang", "left_anti")),
    ]
    out = None
    for name, x in parts:
        row = x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("tree_diff", "select coalesce(a.page_id, b.page_id) page_id, case when b.page_id is null then 'missing' when a.page_id is null then 'invented' else 'differs' end verdict from (select page_id, sha256(html) h from pages where length(html) >= 300) a full join (select page_id, sha256(case when page_id % 4 = 0 then html || ' ' else html end) h from pages where url not like '%?%') b on a.page_id = b.page_id where a.h is distinct from b.h")
def tree_diff(spark, d):
    p = table(spark, d, "pages")
    a = p.where("length(html) >= 300").select("page_id", F.sha2("html", 256).alias("h"))
    b = p.where("url not like '%?%'").select("page_id", F.sha2(F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("h"))
    return M.diff(a, b, ["page_id"], ["h"])
