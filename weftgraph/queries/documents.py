"""Documents, JSON, hydration, text, topology and governance (F, G, H, I, J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.functions import jsonops, scalar
from weftgraph.operators import govern, hydrate, paths, search, topology, upsert
from weftgraph.queries import query
from weftgraph.sources import pages


@query("f03_content_dedup", "select sha1(text) as hash, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def f03(t):
    return t.documents.groupBy(F.sha1("text").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("f06_unique_names", "select doc_id, case when r = 1 then source else source || '_' || r end as name from (select doc_id, source, row_number() over (partition by source order by doc_id) as r from documents)")
def f06(t):
    return upsert.unique_names(t.documents.select("doc_id", "source"), "source", [F.col("doc_id")]).select("doc_id", "name")


@query("f09_richest_wins", "select lang, source, doc_id from documents qualify row_number() over (partition by lang, source order by n_chars desc, doc_id) = 1")
def f09(t):
    best = F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id")))
    return t.documents.groupBy("lang", "source").agg(best.alias("doc_id"))


@query("f10_merge_outcome", "select doc_id, case when b is null then 'new' when n_chars > b then 'replaced' else 'skipped' end as outcome from (select doc_id, n_chars, max(n_chars) over (partition by lang, source order by doc_id rows between unbounded preceding and 1 preceding) as b from documents)")
def f10(t):
    return upsert.merge_outcomes(t.documents, ["lang", "source"], F.col("n_chars"), [F.col("doc_id")]).select("doc_id", "outcome")


@query("g19_variant_ids", "select doc_id, source || case when (length(text), sha1(text)) = max((length(text), sha1(text))) over (partition by source) then '' else '@' || substr(sha1(text), 1, 12) end as variant_id from documents")
def g19(t):
    return upsert.variant_ids(t.documents.select("doc_id", "source", "text"), ["source"], "text", F.col("source")).select("doc_id", "variant_id")


@query("f26_path_module", "select page_id, regexp_extract(url, '(?:^|/)([^/:]*):', 1) as module, length(url) - length(replace(url, '/', '')) as slashes from pages")
def f26(t):
    return t.pages.select("page_id", scalar.module_of_path(F.col("url")).alias("module"), (F.length("url") - F.length(F.replace("url", F.lit("/")))).cast("long").alias("slashes"))


@query("g09_pointers", "select page_id, replace(replace(url, '~', '~0'), '/', '~1') as escaped, url as back from pages")
def g09(t):
    e = jsonops.pointer_escape(F.col("url"))
    return t.pages.select("page_id", e.alias("escaped"), jsonops.pointer_unescape(e).alias("back"))


@query("g04_shred_nodes", "select kind, count(*) as n from (select 'object' as kind from events union all select case json_type(v) when 'VARCHAR' then 'string' when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'number' end from (select unnest(json_extract(props, '$.*')) as v from events)) group by 1")
def g04(t):
    return jsonops.shred_table(t.events, "event_id", "props").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("h12_json_fields", "select event_id, k as name, json_extract_string(props, '$.' || k) as value_json from (select event_id, props, unnest(json_keys(props)) as k from events)")
def h12(t):
    return hydrate.fields(t.events, "event_id", "props").select("event_id", "name", "value_json")


@query("h23_freshness", "select event_id, case when event_id % 11 = 0 then 'unknown' when epoch_us((select max(ts) from events)) // 1000000 - epoch_us(ts) // 1000000 > 86400 then 'stale' else 'fresh' end as state from events")
def h23(t):
    now = t.events.agg(F.max("ts").cast("timestamp").alias("as_of"))
    at = F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("timestamp"))
    return t.events.join(F.broadcast(now)).select("event_id", hydrate.freshness(at, F.col("as_of"), F.lit(86400)).alias("state"))


@query("j05_freshness_scan", "select event_type as label, count(*) as rows_affected, 0::bigint as never, max((epoch_us(m) // 1000000 - epoch_us(ts) // 1000000))::bigint as max_age_s from events, (select max(ts) as m from events) where epoch_us(m) // 1000000 - epoch_us(ts) // 1000000 > 900 group by 1")
def j05(t):
    now = t.events.agg(F.max("ts").cast("timestamp").alias("as_of"))
    return govern.freshness_warnings(t.events.join(F.broadcast(now)), F.col("event_type"), F.col("ts").cast("timestamp"), F.col("as_of"))


_BM25 = """with d as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents), s as (select count(*) as n, avg(len(w)) as a from d),
p as (select id, len(w) as l, unnest(w) as term from d), f as (select term, id, l, count(*) as tf from p where term in ('the', 'idiot', 'ering') group by 1, 2, 3), q as (select term, count(*) as df from f group by 1)
select id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) as score from f join q using (term), s group by 1 order by score desc, id limit 10"""


@query("i02_bm25", _BM25)
def i02(t):
    return search.bm25(t.documents, "doc_id", ["text"], "the idiot ering")


@query("i04_contains_fallback", "select doc_id from documents where contains(lower(text), 'worthless') or contains(lower(source), 'worthless')")
def i04(t):
    return search.fallback(t.documents, ["text", "source"], "Worthless").select("doc_id")


@query("i05_keyword_score", "select p_partkey as id, 3 * contains(lower(p_name), 'a')::int + 2 * contains(lower(p_type), 'a')::int + contains(lower(p_brand), 'a')::int + 3 * contains(lower(p_name), '1')::int + 2 * contains(lower(p_type), '1')::int + contains(lower(p_brand), '1')::int as score from part where (contains(lower(p_name), 'a') or contains(lower(p_type), 'a') or contains(lower(p_brand), 'a')) and (contains(lower(p_name), '1') or contains(lower(p_type), '1') or contains(lower(p_brand), '1')) order by score desc, id limit 40")
def i05(t):
    return search.keywords(t.part, {"p_name": 3, "p_type": 2, "p_brand": 1}, "A 1", ["p_partkey"]).selectExpr("p_partkey as id", "score")


@query("i07_suggest", "select distinct url from pages where contains(lower(url), 'http:') or contains(lower(url), 'page') or contains(lower(url), 'example') order by length(url), url limit 5")
def i07(t):
    return search.suggest(t.pages, "url", "/page/http:/example")


@query("i08_path_tree", "with p as (select list_filter(string_split(url, '/'), lambda x: x <> '') as p, case page_id % 3 when 0 then 'GET' when 1 then 'POST' else 'DELETE' end as m, page_id % 4 = 0 as d from pages) select '/' || array_to_string(p[1:k], '/') as prefix, k as depth, count(*) as n_paths, string_agg(distinct m, ',' order by m) as methods, bool_or(d) as deprecated from (select p, m, d, unnest(range(1, len(p) + 1)) as k from p) group by 1, 2")
def i08(t):
    method = F.when(F.col("page_id") % 3 == 0, "GET").when(F.col("page_id") % 3 == 1, "POST").otherwise("DELETE")
    rows = t.pages.select("url", method.alias("m"), "page_id")
    return topology.path_tree(rows, "url", "m", F.col("page_id") % 4 == 0).withColumn("depth", F.col("depth").cast("long"))


@query("i10_page_text")
def i10(t):
    return pages.page_text(t.pages)


@query("i11_page_sections")
def i11(t):
    return pages.page_sections(t.pages)


@query("a21_links", "select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"#]+)', 1))) as link from pages")
def a21(t):
    return t.pages.select("page_id", F.explode(pages.links(F.col("html"))).alias("link"))


@query("i14_link_aggregation", "select o_custkey as a, l_suppkey as b, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag)) as first_price, string_agg(l_partkey::varchar, ',' order by l_orderkey, l_linenumber, l_partkey) as parts, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_returnflag)) as last_flag, count(*) as n_links from orders join lineitem on l_orderkey = o_orderkey group by 1, 2")
def i14(t):
    links = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).withColumnsRenamed({"o_custkey": "a", "l_suppkey": "b"})
    return topology.aggregate_links(links, "a", "b", {"first_price": "l_extendedprice"}, {"parts": "l_partkey"}, {"last_flag": "l_returnflag"}, F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"))


@query("i15_managed_split", "select case when target = 'unmanaged' then least(s, d) else s end as src, case when target = 'unmanaged' then greatest(s, d) else d end as dst, target from (select case when l_orderkey % 3 = 0 then 'tpd_' else 'dev_' end || l_orderkey as s, case when l_partkey % 3 = 0 then 'tpd_' else 'dev_' end || l_partkey as d, case when l_orderkey % 3 = 0 or l_partkey % 3 = 0 then 'unmanaged' else 'managed' end as target from lineitem where not (l_orderkey % 3 = 0 and l_partkey % 3 = 0))")
def i15(t):
    name = lambda c: F.concat(F.when(F.col(c) % 3 == 0, "tpd_").otherwise("dev_"), F.col(c).cast("string"))
    return topology.split_managed(t.lineitem.select(name("l_orderkey").alias("src"), name("l_partkey").alias("dst")))


@query("i17_precedence", "select o_custkey as id, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) as o_orderkey, min(o_orderpriority) as o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1")
def i17(t):
    return topology.by_precedence(t.orders, ["o_custkey"], "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).withColumnRenamed("o_custkey", "id")


@query("i19_simple_graph", "select least(l_suppkey, l_partkey) as src, greatest(l_suppkey, l_partkey) as dst, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) as q from lineitem where l_suppkey <> l_partkey group by 1, 2")
def i19(t):
    rows = t.lineitem.selectExpr("l_suppkey as src", "l_partkey as dst", "l_quantity as q", "l_orderkey", "l_linenumber")
    return topology.undirected(rows, F.struct("l_orderkey", "l_linenumber", "q")).select("src", "dst", "q")


#: Customer -> nation <- supplier of all rows; the node's kind is in its key, so that no two nodes share one.
_PLACES = "select 'c' || c_custkey as src, 'n' || c_nationkey as dst from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier"


def _places(t):
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    lives = t.customer.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"))
    based = t.supplier.select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst"))
    return lives.unionByName(based).where("src is not null and dst is not null")


@query("i20_components", f"with recursive e as (select * from ({_PLACES}) where src is not null and dst is not null), b as (select src, dst from e union select dst, src from e), r as (select src as node, src as lab from b union select r.node, b.dst from r join b on r.lab = b.src) select node, min(lab) as component from r group by 1")
def i20(t):
    return paths.components(_places(t))


#: What the graph of _PLACES is: a star for each nation.
_STARS = "select k, count(*) as m from (select c_nationkey as k from customer union all select s_nationkey from supplier) where k is not null group by 1"


@query("i21_distances", f"select max(case when m > 1 then 2 else 1 end)::int as diameter, round(sum(2 * m * (m - 1) + 2 * m) / sum(m * (m - 1) + 2 * m), 2) as mean_path from ({_STARS})")
def i21(t):
    d = paths.lengths(_places(t))
    n = F.col("n_nodes").cast("decimal(19,0)")
    return d.agg(F.max("diameter").alias("diameter"), F.round(F.sum("total").cast("double") / F.sum(n * (n - 1)).cast("double"), 2).alias("mean_path"))


@query("i22_bridges_and_cut_points", f"select 'bridge' as kind, least(src, dst) as a, greatest(src, dst) as b from ({_PLACES}) where src is not null and dst is not null union all select 'articulation', 'n' || k, null from ({_STARS}) where m > 1")
def i22(t):
    return paths.cuts(_places(t))


@query("i24_weak_links", "select l_orderkey as o, l_linenumber as n, case when l_returnflag = 'N' then 'no_lag' when l_linestatus <> 'O' then 'health' end as reason from lineitem where l_returnflag = 'N' or l_linestatus <> 'O'")
def i24(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("lag"), F.when(F.col("l_linestatus") == "O", "Good").otherwise("Bad").alias("health"), F.lit("FORWARDING").alias("stp"))
    return topology.weak_links(rows).selectExpr("l_orderkey as o", "l_linenumber as n", "reason")


def _rank_sql(turns: int, edges: str) -> str:
    out = f"with e as materialized (select distinct src, dst from ({edges})), nodes as materialized (select src as node from e union select dst from e), deg as materialized (select src, count(*) as deg from e group by 1), n as (select count(*)::double as n from nodes), r0 as materialized (select node, 1.0::double / n as rank from nodes, n)"
    for k in range(1, turns + 1):
        p = f"r{k - 1}"
        out += f", r{k} as materialized (select nodes.node, 0.15 / n + 0.85 * (select coalesce(sum(rank), 0) from {p} where node not in (select src from deg)) / n + 0.85 * coalesce(g.v, 0) as rank from nodes cross join n left join (select e.dst, sum({p}.rank / deg.deg) as v from e join {p} on {p}.node = e.src join deg on deg.src = e.src group by 1) g on g.dst = nodes.node)"
    return out + f" select node, round(rank, 8) as rank from r{turns}"


@query("i25_pagerank", _rank_sql(5, f"select * from ({_PLACES}) where src is not null and dst is not null"))
def i25(t):
    return paths.pagerank(_places(t), 5).select("node", F.round("rank", 8).alias("rank"))


@query("j03_cell_cap", "select doc_id, octet_length(encode(text)) > 4096 as truncated, case when octet_length(encode(text)) > 4096 then octet_length(encode(text)) else 0 end::bigint as size_bytes from documents")
def j03(t):
    c = govern.cap_cell(F.col("text"))
    cut = F.octet_length("text") > 4096
    size = F.when(cut, F.get_json_object(c, "$.size_bytes").cast("long")).otherwise(F.lit(0).cast("long"))
    return t.documents.select("doc_id", (cut & (c != F.col("text"))).alias("truncated"), size.alias("size_bytes"))


@query("j04_byte_cap", "select doc_id, s::bigint as running_bytes from (select doc_id, sum(octet_length(encode(text))) over (order by doc_id) as s from documents) where s <= 50000")
def j04(t):
    return govern.cap_bytes_by_id(t.documents, "doc_id", F.col("text"), govern.BYTES).select("doc_id", "running_bytes")


@query("j12_stale_count", "select count(*) as n, sum(case when epoch_us(m) // 1000000 - epoch_us(ts) // 1000000 > 900 then 1 else 0 end)::bigint as stale from events, (select max(ts) as m from events)")
def j12(t):
    now = t.events.agg(F.max("ts").alias("m"))
    old = F.unix_timestamp(F.col("m").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")) > 900
    return t.events.join(F.broadcast(now)).agg(F.count(F.lit(1)).alias("n"), F.count_if(old).alias("stale"))


@query("h24_latest_scope", "select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by 1, 2")
def h24(t):
    rows = t.events.select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    return hydrate.latest(rows, ["user_id", "event_type"], "at").select("user_id", "event_type", "value")


@query("s01_windowed_events", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def s01(t):
    w = F.window(F.col("ts"), "1 hour")
    out = t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("w01_running_order", "select o_custkey as cust, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as nth from orders")
def w01(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("k"), F.row_number().over(w).cast("long").alias("nth"))
