"""Scans, predicates and patterns (A, B, C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalar
from weftgraph.operators import paths, upsert
from weftgraph.plans.cypher import cypher, procedure
from weftgraph.plans.graph import PropertyGraph
from weftgraph.queries import query


@procedure("nodes_containing")
def nodes_containing(g: PropertyGraph, label: str, prop: str, part: str):
    """key of the nodes whose property holds a text, in any case."""
    return g.node(label).where(scalar.contains_ci(part, F.col(prop))).select(F.col(g.pk(label)).alias("key"))


@query("c04_hops_region_orders", "select r.r_name as region, n.n_name as nation, count(*) as n_orders from region r join nation n on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1, 2")
def hierarchy(t):
    return cypher(t.g, "MATCH (o:Order)-[:PLACED_BY]->(c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, n.n_name AS nation, count(*) AS n_orders")


@query("a01_label_scan", "select c_custkey as id, c_name as name from customer")
def a01(t):
    return cypher(t.g, "MATCH (c:Customer) RETURN c.c_custkey AS id, c.c_name AS name")


@query("a02_pk_lookup", "select o_orderkey as k, o_totalprice as price from orders where o_orderkey = 7")
def a02(t):
    return cypher(t.g, "MATCH (o:Order {o_orderkey: $k}) RETURN o.o_orderkey AS k, o.o_totalprice AS price", {"k": 7})


@query("a03_multi_key", "select l_orderkey as k, l_linenumber as n, l_quantity as q from lineitem where l_orderkey = 5 and l_linenumber = 1")
def a03(t):
    return t.lineitem.where("l_orderkey = 5 and l_linenumber = 1").selectExpr("l_orderkey as k", "l_linenumber as n", "l_quantity as q")


@query("a04_batched_lookup", "select c_custkey as id, c_name as name from customer where c_custkey in (1, 5, 9, 77, 100000000)")
def a04(t):
    ids = t.spark.createDataFrame([(i,) for i in (1, 5, 9, 77, 100000000)], "c_custkey long")
    return t.customer.join(F.broadcast(ids), "c_custkey", "left_semi").selectExpr("c_custkey as id", "c_name as name")


@query("a05_label_union", "select 'Customer' as kind, c_custkey as id from customer where c_nationkey = 3 union all select 'Supplier', s_suppkey from supplier where s_nationkey = 3")
def a05(t):
    both = t.g.labels("Customer", "Supplier")
    return both.where("coalesce(c_nationkey, s_nationkey) = 3").select(F.col("_label").alias("kind"), F.coalesce("c_custkey", "s_suppkey").alias("id"))


@query("a06_edge_scan", "select (select count(*) from orders) as placed, (select count(*) from lineitem) as shipped")
def a06(t):
    g = t.g
    return g.rel("PLACED_BY").agg(F.count(F.lit(1)).alias("placed")).join(g.rel("SHIPPED_BY").agg(F.count(F.lit(1)).alias("shipped")))


@query("a07_whole_node", "select 'Region' as label, r_regionkey as k, r_name as name from region")
def a07(t):
    return t.g.whole("Region").select(F.col("n._label").alias("label"), F.col("n.r_regionkey").alias("k"), F.col("n.r_name").alias("name"))


@query("a16_introspection", "select 'node' as kind, 'Customer' as name, (select count(*) from customer) as n union all select 'node', 'Nation', (select count(*) from nation) union all select 'node', 'Order', (select count(*) from orders) union all select 'node', 'Part', (select count(*) from part) union all select 'node', 'Region', (select count(*) from region) union all select 'node', 'Supplier', (select count(*) from supplier) union all select 'rel', 'BASED_IN', (select count(*) from supplier) union all select 'rel', 'HAS_PART', (select count(*) from lineitem) union all select 'rel', 'IN_REGION', (select count(*) from nation) union all select 'rel', 'LIVES_IN', (select count(*) from customer) union all select 'rel', 'PLACED_BY', (select count(*) from orders) union all select 'rel', 'SHIPPED_BY', (select count(*) from lineitem)")
def a16(t):
    return t.g.counts()


@query("a28_corpus_identity", "select n, sha256(concat_ws('|', n, a, b, c)) as identity from (select count(*) as n, sum(('0x' || substr(sha256(text), 1, 15))::hugeint) as a, sum(('0x' || substr(sha256(text), 16, 15))::hugeint) as b, sum(('0x' || substr(sha256(text), 31, 15))::hugeint) as c from documents)")
def a28(t):
    from weftgraph.sources.files import corpus_identity

    return corpus_identity(t.documents, "text")


@query("b03_predicates", "select p_partkey as id, p_name as name from part where (p_size > 20 and p_size <= 40 or p_brand = 'Brand#13') and p_type <> '' and not p_retailprice < 905 and contains(lower(p_name), 'a') and p_size in (5, 21, 22, 30, 38)")
def b03(t):
    return cypher(t.g, "MATCH (p:Part) WHERE (p.p_size > 20 AND p.p_size <= 40 OR p.p_brand = 'Brand#13') AND p.p_type <> '' AND NOT p.p_retailprice < 905 AND toLower(p.p_name) CONTAINS 'a' AND p.p_size IN [5, 21, 22, 30, 38] RETURN p.p_partkey AS id, p.p_name AS name")


@query("b11_prefix_null", "select c_custkey as id, case when c_acctbal < 0 then 'debt' else c_mktsegment end as state, length(c_name) as n from customer where c_name is not null and starts_with(c_name, 'Customer#') and c_mktsegment is not null")
def b11(t):
    return cypher(t.g, "MATCH (c:Customer) WHERE c.c_name IS NOT NULL AND c.c_name STARTS WITH 'Customer#' AND c.c_mktsegment IS NOT NULL RETURN c.c_custkey AS id, CASE WHEN c.c_acctbal < 0 THEN 'debt' ELSE c.c_mktsegment END AS state, size(c.c_name) AS n")


@query("b19_order_topk", "select c_custkey as id, c_acctbal as bal, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer qualify rank <= 25")
def b19(t):
    from pyspark.sql import Window

    top = cypher(t.g, "MATCH (c:Customer) RETURN c.c_custkey AS id, c.c_acctbal AS bal ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 25")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bal"), "id")).cast("long"))


@query("b22_paging", "select * from (select 'part' as page, p_partkey as id, true as has_more from part order by length(p_name), p_name, p_partkey limit 20 offset 40) union all select 'region', r_regionkey, false from region where r_regionkey > 2 union all select * from (select 'nation', n_nationkey, (select count(*) from nation) > 15 from nation order by n_nationkey limit 15)")
def b22(t):
    from weftgraph.operators.govern import page

    parts = page(t.part, [F.length("p_name"), F.col("p_name"), F.col("p_partkey")], 40, 20).select(F.lit("part").alias("page"), F.col("p_partkey").alias("id"), "has_more")
    regions = page(t.region, [F.col("r_regionkey")], 3, 20).select(F.lit("region").alias("page"), F.col("r_regionkey").cast("long").alias("id"), "has_more")
    nations = page(t.nation, [F.col("n_nationkey")], 0, 15).select(F.lit("nation").alias("page"), F.col("n_nationkey").cast("long").alias("id"), "has_more")
    return parts.unionByName(regions).unionByName(nations)


@query("b24_distinct", "select distinct p_brand as brand, p_type as type from part")
def b24(t):
    return cypher(t.g, "MATCH (p:Part) RETURN DISTINCT p.p_brand AS brand, p.p_type AS type")


@query("b25_with_having", "select o_custkey as cust, count(*) as n from orders group by 1 having count(*) > 12")
def b25(t):
    return cypher(t.g, "MATCH (o:Order)-[:PLACED_BY]->(c:Customer) WITH c.c_custkey AS cust, count(*) AS n WHERE n > 12 RETURN cust, n")


@query("b26_unwind", "select x.x as x, n_name as nation from (select unnest(range(1, 6)) as x) x join nation on n_nationkey = x.x")
def b26(t):
    return cypher(t.g, "UNWIND range(1, 5) AS x MATCH (n:Nation) WHERE n.n_nationkey = x RETURN x, n.n_name AS nation")


@query("b27_union", "select n_name as name from nation where n_regionkey = 1 union select r_name from region")
def b27(t):
    return cypher(t.g, "MATCH (n:Nation) WHERE n.n_regionkey = 1 RETURN n.n_name AS name UNION MATCH (r:Region) RETURN r.r_name AS name")


@query("c02_reverse_expand", "select n_name as nation, c_custkey as id from nation join customer on c_nationkey = n_nationkey where n_name = 'NATION_3' or n_nationkey = 4")
def c02(t):
    return cypher(t.g, "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WHERE n.n_name = 'NATION_3' OR n.n_nationkey = 4 RETURN n.n_name AS nation, c.c_custkey AS id")


@query("c04_blast_radius", "select s.s_suppkey as supplier, count(distinct o_custkey) as customers, count(distinct o_orderkey) as orders from supplier s join lineitem on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey where s_nationkey < 5 group by 1")
def blast(t):
    return cypher(t.g, "MATCH (s:Supplier)<-[:SHIPPED_BY]-(o:Order), (o)-[:PLACED_BY]->(c:Customer) WHERE s.s_nationkey < 5 RETURN s.s_suppkey AS supplier, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT o.o_orderkey) AS orders")


@query("c06_value_join", "select p_brand as category, count(*) as n from part join (select distinct p_brand as b from part where p_size > 45) x on b = p_brand group by 1")
def c06(t):
    big = t.part.where("p_size > 45").select(F.col("p_brand").alias("b")).distinct()
    return t.part.join(big, F.col("p_brand") == F.col("b")).groupBy(F.col("p_brand").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("c07_optional_match", "select c_custkey as id, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1")
def c07(t):
    return cypher(t.g, "MATCH (c:Customer) OPTIONAL MATCH (c)<-[:PLACED_BY]-(o:Order) RETURN c.c_custkey AS id, count(o) AS n")


@query("c08_optional_chain", "select n_nationkey as n, coalesce(c, 0) as customers, coalesce(s, 0) as suppliers from nation left join (select c_nationkey, count(*) c from customer group by 1) on c_nationkey = n_nationkey left join (select s_nationkey, count(*) s from supplier group by 1) on s_nationkey = n_nationkey")
def c08(t):
    c = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    s = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s"))
    out = t.nation.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return out.select(F.col("n_nationkey").alias("n"), F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("c09_optional_predicate", "select c_custkey as id, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1")
def c09(t):
    return cypher(t.g, "MATCH (c:Customer) OPTIONAL MATCH (c)<-[:PLACED_BY]-(o:Order) WHERE o.o_orderstatus = 'F' RETURN c.c_custkey AS id, count(o) AS n")


@query("c10_optional_then_filter", "select c_custkey as id, o_orderkey as o from customer left join orders on o_custkey = c_custkey where o_orderpriority = '1-URGENT'")
def c10(t):
    return cypher(t.g, "MATCH (c:Customer) OPTIONAL MATCH (c)<-[:PLACED_BY]-(o:Order) WITH c, o WHERE o.o_orderpriority = '1-URGENT' RETURN c.c_custkey AS id, o.o_orderkey AS o")


@query("c11_anti_join", "select c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def c11(t):
    return cypher(t.g, "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)<-[:PLACED_BY]-(:Order) } RETURN c.c_custkey AS id")


@query("c12_anti_keyed", "select o_orderkey as id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = 4)")
def c12(t):
    return cypher(t.g, "MATCH (o:Order) WHERE NOT EXISTS { MATCH (o)-[:HAS_PART {l_linenumber: 4}]->() } RETURN o.o_orderkey AS id")


@query("c13_semi_join", "select c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')")
def c13(t):
    return cypher(t.g, "MATCH (c:Customer) WHERE EXISTS { MATCH (c)<-[:PLACED_BY]-(o:Order) WHERE o.o_orderstatus = 'O' } RETURN c.c_custkey AS id")


@query("c12_correlated", "select c_custkey as id from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 45 * c_acctbal and o_orderpriority <> c_mktsegment)")
def c12b(t):
    return cypher(t.g, "MATCH (c:Customer) WHERE NOT EXISTS { MATCH (c)<-[:PLACED_BY]-(o:Order) WHERE o.o_totalprice > 45 * c.c_acctbal AND o.o_orderpriority <> c.c_mktsegment } RETURN c.c_custkey AS id")


@query("c11_exists_or", "select c_custkey as id from customer where c_acctbal < 0 or not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def c11b(t):
    return cypher(t.g, "MATCH (c:Customer) WHERE c.c_acctbal < 0 OR NOT EXISTS { MATCH (c)<-[:PLACED_BY]-(o:Order) WHERE o.o_orderstatus = 'P' } RETURN c.c_custkey AS id")


@query("c05_bound_properties", "select c_custkey as cust, o_orderkey as o from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderstatus = 'F'")
def c05(t):
    return cypher(t.g, "MATCH (o:Order)-[:PLACED_BY]->(c:Customer), (c {c_mktsegment: 'BUILDING'}), (o {o_orderstatus: $s}) RETURN c.c_custkey AS cust, o.o_orderkey AS o", {"s": "F"})


@query("c05_bound_start", "select s_suppkey as s, c_custkey as c from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey join customer on c_custkey = o_custkey where o_orderpriority = '1-URGENT'")
def c05b(t):
    return cypher(t.g, "MATCH (s)<-[:SHIPPED_BY]-(o:Order), (c)<-[:PLACED_BY]-(o {o_orderpriority: '1-URGENT'}) RETURN s.s_suppkey AS s, c.c_custkey AS c")


@query("c14_walks", "select r_name as region, c_custkey as id, count(*) as n from region join nation n on n.n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by 1, 2")
def c14_walks(t):
    return cypher(t.g, "MATCH (c:Customer)-[:LIVES_IN|IN_REGION*1..3]->(r:Region) RETURN r.r_name AS region, c.c_custkey AS id, count(*) AS n")


@query("c15_walk_counts", "with e as (select 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem union all select 'o' || l_orderkey, 's' || l_suppkey from lineitem) select src[2:]::bigint as o, count(*) as n_walks, count(distinct dst) as n_ends from e group by 1")
def c15(t):
    both = cypher(t.g, "MATCH (o:Order)-[:HAS_PART|SHIPPED_BY*1..2]->(x) RETURN o.o_orderkey AS o, count(*) AS n_walks")
    ends = cypher(t.g, "MATCH (o:Order)-[:HAS_PART|SHIPPED_BY*1..2]->(x) RETURN DISTINCT o.o_orderkey AS o, labels(x) AS l, id(x) AS x")
    return both.join(ends.groupBy("o").agg(F.count(F.lit(1)).alias("n_ends")), "o")


@query("b12_optional_filter", "select p_partkey as id from part where p_brand = 'Brand#13'")
def b12(t):
    return cypher(t.g, "MATCH (p:Part) WHERE ($brand = '' OR p.p_brand = $brand) AND ($type IS NULL OR p.p_type = $type) RETURN p.p_partkey AS id", {"brand": "Brand#13", "type": None})


@query("b13_dynamic_filter", "select o_orderkey as id from orders where o_orderstatus = 'O' and o_totalprice >= 1000 and o_orderpriority in ('1-URGENT', '2-HIGH')")
def b13(t):
    given = {"o_orderstatus": "O", "o_custkey": None, "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_totalprice": (1000, None)}
    return t.orders.where(scalar.all_given(given)).select(F.col("o_orderkey").alias("id"))


@query("b07_list_membership", "select o_orderkey as id, 4 = any (l) as has_four, len(l) as n, l[1] as first from (select l_orderkey as o_orderkey, list(l_linenumber order by l_linenumber) as l from lineitem group by 1)")
def b07(t):
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("tags"))
    g = PropertyGraph().add_node("Lines", lists, "k")
    return cypher(g, "MATCH (x:Lines) RETURN x.k AS id, 4 IN x.tags AS has_four, size(x.tags) AS n, x.tags[0] AS first")


@query("b18_time", "select event_id, ts > timestamp '2024-01-02 00:00:00' - interval 15 minute as late, ts + interval 90 second < timestamp '2024-01-01 12:00:00' as early from events")
def b18(t):
    g = PropertyGraph().add_node("Event", t.events.withColumn("ts", F.col("ts").cast("timestamp")), "event_id")
    return cypher(g, "MATCH (e:Event) RETURN e.event_id AS event_id, e.ts > timestamp('2024-01-02T00:00:00Z') - duration({minutes: 15}) AS late, e.ts + duration({seconds: 90}) < timestamp('2024-01-01T12:00:00') AS early")


@query("b28_call_yield", "select s_suppkey as s, n_name as nation from supplier join nation on n_nationkey = s_nationkey where contains(lower(s_name), '7')")
def b28(t):
    return cypher(t.g, "CALL nodes_containing('Supplier', 's_name', '7') YIELD key AS k WITH k MATCH (s:Supplier)-[:BASED_IN]->(n:Nation) WHERE s.s_suppkey = k RETURN s.s_suppkey AS s, n.n_name AS nation")


@query("b32_typed_values", "select r_regionkey as k, 0 as n, cast(r_regionkey as varchar) as text from region")
def b32(t):
    return cypher(t.g, "MATCH (r:Region) RETURN r.r_regionkey AS k, size(CAST([] AS STRING[])) AS n, CAST(r.r_regionkey AS STRING) AS text")


#: Customers and suppliers -> nations -> regions, of all rows; the kind is in the key, so that no two nodes share one.
_UP = "select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation"
_SEEDS = "select 'c' || c_custkey as seed from customer union all select 's' || s_suppkey from supplier"


def _up(t):
    node = lambda kind, c, name: F.concat(F.lit(kind), F.col(c).cast("string")).alias(name)
    lives = t.customer.select(node("c", "c_custkey", "src"), node("n", "c_nationkey", "dst"))
    based = t.supplier.select(node("s", "s_suppkey", "src"), node("n", "s_nationkey", "dst"))
    edges = lives.unionByName(based).unionByName(t.nation.select(node("n", "n_nationkey", "src"), node("r", "n_regionkey", "dst")))
    return edges, lives.unionByName(based).select(F.col("src").alias("node"))


@query("c14_variable_length", f"with recursive e as ({_UP}), r as (select seed, seed as node, 0 as depth from ({_SEEDS}) union select seed, dst, depth + 1 from r join e on src = node where depth < 3) select seed, node, min(depth) as depth from r group by 1, 2")
def c14(t):
    return paths.hops(*_up(t), 0, 3)


@query("f08_closure", f"with recursive e as ({_UP}), r as (select seed, seed as node from ({_SEEDS}) union select seed, dst from r join e on src = node) select seed, node from r")
def f08(t):
    return paths.closure(*_up(t))


@query("c16_alternated_rels", "select n_name as nation, count(*) as n from (select c_nationkey as k from customer union all select s_nationkey from supplier) join nation on n_nationkey = k group by 1")
def c16(t):
    return cypher(t.g, "MATCH (n:Nation)<-[:LIVES_IN|BASED_IN]-(x) RETURN n.n_name AS nation, count(*) AS n")


@query("c17_edge_property", "select l_orderkey as o, p_name as part, l_quantity as q from lineitem join part on p_partkey = l_partkey where l_linenumber = 1 and l_quantity > 45")
def c17(t):
    return cypher(t.g, "MATCH (o:Order)-[r:HAS_PART {l_linenumber: 1}]->(p:Part) WHERE r.l_quantity > 45 RETURN o.o_orderkey AS o, p.p_name AS part, r.l_quantity AS q")


@query("c18_neighbours", "select a.o_orderkey as a, b.o_orderkey as b from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey")
def c18(t):
    a, b = t.orders.selectExpr("o_orderkey as a", "o_custkey as k"), t.orders.selectExpr("o_orderkey as b", "o_custkey as k")
    return a.join(b, "k").where("a <> b").select("a", "b")


@query("c19_derived_edge", "select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on l_orderkey = o_orderkey")
def c19(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query("c24_context", "select o_orderkey as id, c_name as customer, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey), '') as lines, count(l_linenumber) as n from orders join customer on c_custkey = o_custkey left join lineitem on l_orderkey = o_orderkey group by 1, 2")
def c24(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    text = F.coalesce(F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ","), F.lit(""))
    out = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return out.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("customer"), text.alias("lines"), F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n"))


@query("c26_latest_lineage", "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by event_type = 'purchase' desc, ts desc, event_id) = 1")
def c26(t):
    from weftgraph.operators.upsert import richest

    return richest(t.events, ["user_id"], F.col("event_type") == "purchase", [F.col("ts"), -F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("d03_upsert", "select o_orderkey as k, case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as status from orders")
def d03(t):
    old = t.orders.selectExpr("o_orderkey as k", "o_orderstatus as status")
    return upsert.upsert(old, old.where("k % 10 = 0").withColumn("status", F.lit("X")), ["k"])


@query("d04_merge_edges", "select distinct o_custkey as src, l_suppkey as dst from orders join lineitem on l_orderkey = o_orderkey")
def d04(t):
    e = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_custkey as src", "l_suppkey as dst", "l_quantity")
    return upsert.merge_edges(e.where("l_quantity <= 40 or l_quantity is null").select("src", "dst").distinct(), e.where("l_quantity > 40").select("src", "dst"))


@query("d06_keep_first", "select s_suppkey as k, case when s_suppkey % 2 = 0 then s_name else 'new' end as first_name, 'new' as name from supplier")
def d06(t):
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("first_name"), F.col("s_name").alias("name"))
    return upsert.upsert(old, old.withColumns({"first_name": F.lit("new"), "name": F.lit("new")}), ["k"], ["first_name"])


@query("d08_detach_delete", "select (select count(*) from orders where o_orderstatus <> 'F') as nodes, (select count(*) from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus <> 'F') as edges")
def d08(t):
    lines = t.lineitem.selectExpr("l_orderkey as src", "-1 - l_partkey as dst")
    left, e = upsert.detach_delete(t.orders, "o_orderkey", t.orders.where("o_orderstatus = 'F'"), {"HAS_PART": lines})
    return left.agg(F.count(F.lit(1)).alias("nodes")).join(e["HAS_PART"].agg(F.count(F.lit(1)).alias("edges")))
