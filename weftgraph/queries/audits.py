"""Aggregation, audit and metrics (E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.functions.scalar import ratio
from weftgraph.operators import audit
from weftgraph.queries import query


@query("e02_group_by", "select n_name as nation, c_mktsegment as segment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on n_nationkey = c_nationkey group by 1, 2")
def e02(t):
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("e08_duplicate_keys", "select l_orderkey as k, l_linenumber as line, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def e08(t):
    return audit.duplicate_keys(t.lineitem.selectExpr("l_orderkey as k", "l_linenumber as line"), ["k", "line"])


@query("e12_orphans", "select p_partkey as id from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 48)")
def e12(t):
    edges = t.lineitem.where("l_quantity > 48").selectExpr("l_orderkey as src", "l_partkey as dst")
    return audit.orphans(t.part, "p_partkey", edges).selectExpr("p_partkey as id")


@query("e13_fk_edges", "select o_orderkey as id from orders where o_custkey % 7 = 0")
def e13(t):
    edges = t.orders.where("o_custkey % 7 <> 0").selectExpr("o_custkey as src", "o_orderkey as dst")
    return audit.inconsistent(t.orders, "o_orderkey", "o_custkey", edges).selectExpr("o_orderkey as id")


@query("e14_exactly_one", "select o_orderkey as id, coalesce(n, 0) as n from orders left join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey where coalesce(n, 0) <> 1")
def e14(t):
    return audit.not_exactly_one(t.orders, "o_orderkey", t.lineitem.selectExpr("l_partkey as src", "l_orderkey as dst")).selectExpr("o_orderkey as id", "n")


@query("e16_invariants", "select 'pk' as invariant, count(*) as n, min(k) as sample from (select cast(o_orderkey as varchar) k from orders group by o_orderkey having count(*) > 1) union all select 'orphans', count(*), min(cast(c_custkey as varchar)) from customer where c_custkey not in (select o_custkey from orders) union all select 'dangling', count(*), min(cast(l_orderkey as varchar)) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def e16(t):
    orders = t.orders
    lost = t.lineitem.join(orders.where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return audit.report({"pk": (audit.duplicate_keys(orders, ["o_orderkey"]), F.col("o_orderkey")), "orphans": (audit.orphans(t.customer, "c_custkey", orders.selectExpr("o_custkey as dst")), F.col("c_custkey")), "dangling": (lost, F.col("l_orderkey"))})


@query("e17_parity", "with a as (select distinct p_name as k from part where p_size <= 40), b as (select distinct p_name as k from part where p_size > 10) select (select count(*) from a) as n_ours, (select count(*) from b) as n_theirs, (select count(*) from (select k from b except select k from a)) as n_missing, (select count(*) from (select k from a except select k from b)) as n_extra, round((select count(*) from (select k from b intersect select k from a)) / (select count(*) from b), 4) as coverage")
def e17(t):
    return audit.parity(t.part.where("p_size <= 40"), t.part.where("p_size > 10"), "p_name")


@query("e22_histogram", "select event_type as kind, count(*) as n from events group by 1")
def e22(t):
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("e23_coverage", "select count(distinct o_custkey) as with_orders, (select count(*) from customer) as customers, round(count(distinct o_custkey) / (select count(*) from customer), 4) as ratio from orders")
def e23(t):
    both = t.orders.agg(F.count_distinct("o_custkey").alias("with_orders")).join(t.customer.agg(F.count(F.lit(1)).alias("customers")))
    return both.withColumn("ratio", ratio(F.col("with_orders"), F.col("customers"), 0.0))


@query("e24_mergeable", "select round(sum(case when o_orderstatus = 'F' then 1 else 0 end) / count(*), 4) as ratio, count(*) as total from orders")
def e24(t):
    parts = t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count(F.lit(1)).alias("m"))
    return parts.agg(F.sum("n").alias("n"), F.sum("m").alias("total")).select(ratio(F.col("n"), F.col("total"), 0.0).alias("ratio"), "total")


@query("e25_identity_conflicts", "with b as (select source, lang, count(distinct text) as v, count(*) as n from documents group by 1, 2) select count(*) as bases, sum(v)::bigint as variants, sum(case when v > 1 then 1 else 0 end)::bigint as conflicting, sum(n - v)::bigint as merged from b")
def e25(t):
    b = t.documents.groupBy("source", "lang").agg(F.count_distinct(F.sha2("text", 256)).alias("v"), F.count(F.lit(1)).alias("n"))
    return b.agg(F.count(F.lit(1)).alias("bases"), F.sum("v").alias("variants"), F.count_if(F.col("v") > 1).alias("conflicting"), F.sum(F.col("n") - F.col("v")).alias("merged"))


@query("e28_gates", "select 'parity' as gate, (select count(*) from orders) > 0 as ok union all select 'unique', (select count(*) = count(distinct o_orderkey) from orders) union all select 'all', (select count(*) > 0 and count(*) = count(distinct o_orderkey) from orders)")
def e28(t):
    m = t.orders.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("d"))
    return audit.gates(m, {"parity": F.col("n") > 0, "unique": F.col("n") == F.col("d")})


@query("e29_regression", "with m as (select date_trunc('month', o_orderdate) as m, count(*) as n from orders group by 1) select strftime(m, '%Y-%m') as month, n, coalesce(n < 0.75 * lag(n) over (order by m), false) as regressed from m")
def e29(t):
    m = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("regressed", F.coalesce(F.col("n") < 0.75 * F.lag("n").over(Window.orderBy("month")), F.lit(False)))


@query("e31_nearest_rank", "with r as (select o_orderpriority as g, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_totalprice) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders) select g, max(case when i = round_even(0.5 * (n - 1), 0) then v end) as p50, max(case when i = round_even(0.9 * (n - 1), 0) then v end) as p90, max(case when i = round_even(0.99 * (n - 1), 0) then v end) as p99 from r group by 1")
def e31(t):
    return audit.nearest_rank(t.orders.withColumnRenamed("o_orderpriority", "g"), ["g"], "o_totalprice", [0.5, 0.9, 0.99])


@query("e32_cumulative_share", "with c as (select o_custkey as cust, sum(o_totalprice) as v from orders group by 1), r as (select cust, row_number() over (order by v desc, cust) as rank, round(sum(v) over (order by v desc, cust rows unbounded preceding) / sum(v) over (), 6) as share from c) select * from r where rank <= 20")
def e32(t):
    c = t.orders.groupBy(F.col("o_custkey").alias("cust")).agg(F.sum("o_totalprice").alias("v"))
    total = c.agg(F.sum("v").alias("all"))
    top = c.orderBy(F.desc("v"), "cust").limit(20).join(F.broadcast(total))
    w = Window.orderBy(F.desc("v"), "cust")
    return top.select("cust", F.row_number().over(w).cast("long").alias("rank"), F.round(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("all"), 6).alias("share"))


@query("e33_latest_per_group", "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def e33(t):
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(last.alias("e")).select("user_id", "e.event_id", "e.event_type")


@query("e34_category_rollup", "select p_type as category, count(*) as n, count(distinct p_brand) as brands from part group by 1")
def e34(t):
    return t.part.groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("e35_presence", "select count(*) as endpoints, sum(case when n > 0 then 1 else 0 end)::bigint as with_lines, sum(case when n > 3 then 1 else 0 end)::bigint as with_many from (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1)")
def e35(t):
    n = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("endpoints"), F.count_if(F.col("n") > 0).alias("with_lines"), F.count_if(F.col("n") > 3).alias("with_many"))
