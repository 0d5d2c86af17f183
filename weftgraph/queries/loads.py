"""Sources, writers, loaders and guards (A, D, I, J) over the driver's rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType

from weftgraph.functions import jsonops
from weftgraph.operators import audit, context, govern, hydrate, loaders, semantic, topology, upsert
from weftgraph.plans import writers
from weftgraph.queries import query
from weftgraph.session import shared_folder
from weftgraph.sources import pager

_text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- rows and writers
@query("a10_typed_rows", "select o_orderkey as id, case when o_orderkey % 3 = 0 then '' else o_orderpriority end as label, 0 as n_tags, false as flag, case when o_orderkey % 2 = 0 then null else 0 end as n_types from orders")
def a10(t):
    schema = StructType().add("id", LongType()).add("label", StringType()).add("tags", ArrayType(StringType())).add("flag", BooleanType()).add("types", ArrayType(StringType()))
    types = F.when(F.col("o_orderkey") % 2 == 1, F.array().cast("array<string>"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("label"), types.alias("types"))
    return writers.typed_rows(rows, schema, ("types",)).select("id", "label", F.size("tags").alias("n_tags"), "flag", F.when(F.col("types").isNotNull(), F.size("types")).alias("n_types"))


@query("a11_batched_writer", "select 'customer' as name, count(*) as n from customer union all select 'lives_in', count(distinct (c_custkey, c_nationkey)) from customer union all select 'nation', count(distinct c_nationkey) from customer")
def a11(t):
    def graph(rows):
        return {"customer": rows.select("c_custkey", "c_name"), "nation": rows.select("c_nationkey"), "lives_in": rows.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"))}

    parts = [graph(t.customer.where(F.col("c_custkey") % 4 == k)) for k in range(4)]
    return writers.write_tables(writers.together(parts), shared_folder(t.spark), {"customer": ["c_custkey"], "nation": ["c_nationkey"], "lives_in": ["src", "dst"]}).withColumnRenamed("table", "name")


@query("f13_only_new", "select o_orderkey as id from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def f13(t):
    return writers.only_new(t.orders.select(F.col("o_orderkey").alias("id")), t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("id")), ["id"])


@query("d05_merge_edge_props", "select src, dst, arg_max(q, o) as q from (select o_custkey as src, l_suppkey as dst, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 as o, l_quantity as q from orders join lineitem on l_orderkey = o_orderkey) group by 1, 2 having count(*) = count(distinct o)")
def d05(t):
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    o = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100
    last = rows.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.max_by("l_quantity", o).alias("q"), F.count(F.lit(1)).alias("n"), F.count_distinct(o).alias("d")).where("n = d").drop("n", "d")
    old = last.withColumn("q", F.lit(-1.0))
    return upsert.upsert(old, last, ["src", "dst"])


@query("d02_create_edges", "select c_custkey as src, s_suppkey as dst from customer join supplier on s_nationkey = c_nationkey where c_acctbal > 9000 and s_acctbal > 5000")
def d02(t):
    from weftgraph.plans.cypher import cypher

    found = cypher(t.g, "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)<-[:BASED_IN]-(s:Supplier) WHERE c.c_acctbal > 9000 AND s.s_acctbal > 5000 RETURN c.c_custkey AS src, s.s_suppkey AS dst")
    return upsert.merge_edges(found.limit(0), found)


@query("d07_delete_and_carry", "select s_suppkey as id, case when s_suppkey % 2 = 0 then s_name end as note, 'new' as body from supplier where s_nationkey < 20")
def d07(t):
    old = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("note"), F.lit("old").alias("body"))
    new = t.supplier.where("s_nationkey < 20").select(F.col("s_suppkey").alias("id"), F.lit(None).cast("string").alias("note"), F.lit("new").alias("body"))
    return upsert.replace_all(old, new, ["id"], ["note"])


# ---- sources
_PAGES = "case when o_orderkey % 5 = 0 then 'PAGINATION_LOOP' when o_orderkey % 5 = 1 then 'ITEM_ARRAY_NOT_FOUND' when o_orderkey % 5 = 2 then 'PAGINATION_TRUNCATED' else '' end"


@query("a25_paged_calls", f"select o_orderkey as id, {_PAGES} as code, case o_orderkey % 5 when 3 then 5 when 4 then 4 else 0 end as n_items from orders")
def a25(t):
    k = F.col("o_orderkey") % 5
    page = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page")
    rows = t.orders.select("o_orderkey", page)
    two = '"items":[1,2]'
    body = (
        F.when(k == 0, _text("{", two, ',"next":"c"}'))
        .when(k == 1, F.lit('{"errors":[1],"x":1}'))
        .when(k == 2, _text("{", two, ',"next":"', F.col("page"), '"}'))
        .when(k == 3, F.when(F.col("page") < 2, _text("{", two, ',"total":5}')).otherwise(F.lit('{"items":[1],"total":5}')))
        .otherwise(F.when(F.col("page") < 2, _text("{", two, ',"next":"', F.col("page"), '"}')).otherwise(F.lit('{"items":[],"next":null}')))
    )
    pages = rows.select(F.col("o_orderkey").alias("call_id"), "page", body.alias("body"))
    return pager.collected(pages, most=4, size=2).select(F.col("call_id").alias("id"), "code", "n_items")


@query("j16_capped_pages", "select o_orderkey as id, case when o_orderkey % 2 = 0 then 'RESULT_TOO_LARGE' else '' end as code, case when o_orderkey % 2 = 0 then 0 else 1 end as n_items from orders")
def j16(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.rpad(F.lit("x"), 200, "x")).otherwise("x")
    pages = t.orders.select(F.col("o_orderkey").alias("call_id"), F.lit(0).alias("page"), F.to_json(F.struct(F.array(text).alias("items"))).alias("body"))
    return pager.collected(pages, cap_bytes=100).select(F.col("call_id").alias("id"), "code", "n_items")


@query("a20_markdown_specs", "select p_partkey as id, case when p_partkey % 3 > 0 then '{\"paths\": {\"/' || p_partkey || '\": {}}}' end as spec, case when p_partkey % 3 = 1 then '[1]' end as example from part")
def a20(t):
    spec = _text('{"paths": {"/', F.col("p_partkey"), '": {}}}')
    block = lambda c: _text("```json\n", c, "\n```\n")
    k = F.col("p_partkey") % 3
    page = F.when(k == 0, block(F.lit('{"a": 1}'))).when(k == 1, F.concat(block(F.lit("{bad")), block(F.lit('{"a": 1}')), block(spec), F.lit("text\n"), block(F.lit("[1]")), block(F.lit("[2]")))).otherwise(F.concat(F.lit("# title\n"), block(spec)))
    return t.part.select(F.col("p_partkey").alias("id"), loaders.markdown_spec(page).alias("m")).select("id", "m.spec", "m.example")


@query("a22_sidebar_services", "select 's' || n_nationkey as slug, '/docs/x/services/s' || n_nationkey || '/public' as link from nation where n_regionkey = 1")
def a22(t):
    link = lambda c: _text("/docs/x/services/s", c, "/public/")
    item = F.struct(F.lit("x").alias("label"), link(F.col("n_nationkey")).alias("link"))
    own = t.nation.groupBy().agg(F.collect_list(F.when(F.col("n_regionkey") == 1, item)).alias("a"), F.collect_list(F.when(F.col("n_regionkey") != 1, item)).alias("b"))
    base = F.array(F.struct(F.lit("all").alias("label"), F.lit("/docs/x/services/").alias("link")))
    sidebar = F.to_json(F.struct(F.array(F.struct(F.lit("Guides").alias("label"), F.col("b").alias("items")), F.struct(F.lit("Services").alias("label"), F.concat(base, "a").alias("items"))).alias("items")))
    return loaders.services(own.select(sidebar.alias("sidebar")), "/docs/x/services")


@query("a22_spec_links", "select n_nationkey as id, 'a:/v1,b:/v2/x' as specs from nation")
def a22b(t):
    text = F.lit('[{"link": "/docs/services/s/v1/openapi/a/"}, {"link": "/docs/services/s/v3/openapi/a/"}, {"link": "/docs/services/s/v2/x/openapi/b/get"}, {"link": "/docs/services/s/v1/openapi/changelog/"}]')
    links = loaders.spec_links(text, "s")
    return t.nation.select(F.col("n_nationkey").alias("id"), F.array_join(F.transform(links, lambda p: F.concat_ws(":", p["name"], p["path"])), ",").alias("specs"))


@query("a23_source_counters", "select event_type as source, count(*) as discovered, count(*) filter (event_id % 3 = 0) as cached, count(*) filter (event_id % 3 = 1) as fetched, count(*) filter (event_id % 3 = 2) as missing, count(*) filter (event_id % 6 = 5) as no_block, count(*) filter (event_id % 6 = 2) as unknown from events group by 1")
def a23(t):
    k = F.col("event_id") % 3
    rows = t.events.select(F.col("event_type").alias("source"), F.when(k == 0, "cached").when(k == 1, "fetched").otherwise("missing").alias("outcome"), F.when(F.col("event_id") % 2 == 1, "no_block").alias("reason"))
    why = lambda name: F.coalesce(F.col("failure_reasons")[name], F.lit(0)).alias(name)
    return loaders.source_counters(rows).select("source", "discovered", "cached", "fetched", "missing", why("no_block"), why("unknown"))


@query("i12_scrape_report", "select count(*) as pages, 0 as cached, 0 as fetched, count(*) as failed, true as blocked from pages")
def i12(t):
    return loaders.scrape_report(t.pages.select("page_id", F.lit("failed").alias("outcome"), F.lit(403).alias("status"))).select("pages", F.col("cached").cast("int").alias("cached"), F.col("fetched").cast("int").alias("fetched"), "failed", "blocked")


@query("a29_cached_outcomes", "select count(*) filter (o_orderkey % 3 = 0) as hits, count(*) filter (o_orderkey % 3 > 0) as misses from orders")
def a29(t):
    docs = t.orders.select(F.col("o_orderkey").alias("id"), _text('{ "id": ', F.col("o_orderkey"), "}").alias("body"))
    cache = t.orders.where(F.col("o_orderkey") % 3 == 0).select(jsonops.content_hash(_text('{"id":', F.col("o_orderkey"), "}")).alias("digest"), F.lit("ok").alias("status"))
    return loaders.with_cached_outcomes(docs, "body", cache)[1]


@query("a18_sampled_documents", "select doc_id from documents qualify row_number() over (partition by source order by doc_id) <= 3")
def a18(t):
    return loaders.sampled_documents(t.documents.select("doc_id", "source"), "source", "doc_id", 3).select("doc_id")


@query("a38_first_route", "select o_orderkey as id, case when o_orderkey % 4 = 0 then 'bundle' when o_orderkey % 4 = 1 then 'page' when o_orderkey % 4 = 2 then 'cache' end as route, case when o_orderkey % 4 < 3 then 'b' || o_orderkey % 4 end as body from orders")
def a38(t):
    k = F.col("o_orderkey") % 4
    routes = [F.when(k == n, _text("b", k)).otherwise(F.when(k == 3, "")).alias(name) for n, name in enumerate(("bundle", "page", "cache"))]
    return loaders.first_route(t.orders.select(F.col("o_orderkey").alias("id"), *routes), "id", ["bundle", "page", "cache"]).select("id", "route", "body")


@query("a33_version_gate", "select s_suppkey as id, case when s_suppkey % 4 = 0 then 'version' when s_suppkey % 4 = 1 then 'tag' when s_suppkey % 4 = 2 then 'digest' end as problem, s_suppkey % 4 in (1, 3) as installed from supplier")
def a33(t):
    k = F.col("s_suppkey") % 4
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.when(k == 0, 6).otherwise(7).alias("version"), F.when(k == 1, "v1").otherwise("v2").alias("tag"), F.when(k == 2, "x").otherwise("d").alias("digest"), F.lit("a").alias("asset"), F.when(k == 2, "n").otherwise("m").alias("member"), F.when(k == 0, "other").when(k == 1, "").otherwise("default").alias("projection"))
    return loaders.version_gate(rows, 7, "v2", "d").select("id", "problem", loaders.install_matches("a", "m", "default").alias("installed"))


@query("a37_area_counts", "select case when s_suppkey % 2 = 0 then 'even' else 'odd' end as area, count(*) as n from supplier group by 1")
def a37(t):
    paths = t.supplier.select(_text(F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd"), "/", F.col("s_suppkey"), ".json").alias("path"))
    return loaders.area_counts(paths, ["even", "odd"])


@query("a35_envelope_records", "select o_orderkey as id, case o_orderkey % 6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 1 when 4 then 0 end as n from orders")
def a35(t):
    k = F.col("o_orderkey") % 6
    body = F.when(k == 0, '{"items": 5, "result": [1]}').when(k == 1, '{"items": [1, 2], "result": [1]}').when(k == 2, '{"cat": [1, 2, 3]}').when(k == 3, '{"name": "x", "items": 1}').when(k == 4, "[]").otherwise('{"x": [1]}')
    return t.orders.select(F.col("o_orderkey").alias("id"), F.size(loaders.records(body, F.lit("cat"))).alias("s")).select("id", F.when(F.col("s") >= 0, F.col("s")).alias("n"))


@query("a36_categories", "select distinct lower(c_mktsegment) as category from customer union select 'x-' || r_name from region")
def a36(t):
    low = F.lower("c_mktsegment")
    found = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, _text('{"name": "', low, '"}')).otherwise(_text('"', low, '"')).alias("v")).unionByName(t.region.select(_text('{"category": "x-', F.col("r_name"), '"}').alias("v")))
    return loaders.categories(found, "v", ["none"])


# ---- loads
@query("i13_hierarchy", "select 'COLLECTION_HAS_SITE' as rel, 'r' || n_regionkey as src, n_nationkey::varchar as dst from nation where n_nationkey % 3 > 0 and n_nationkey % 7 > 0 union all select 'ORG_HAS_SITE', 'org', n_nationkey::varchar from nation where n_nationkey % 3 = 0 and n_nationkey % 7 > 0")
def i13(t):
    key, k = F.col("n_nationkey"), F.col("n_nationkey")
    rows = t.nation.select(F.when(k % 2 == 0, key.cast("string")).otherwise("").alias("id"), key.alias("siteId"), F.when(k % 7 > 0, F.col("n_name")).alias("name"), F.lit(" ").alias("siteName"), F.when(k % 3 > 0, _text("r", F.col("n_regionkey"))).otherwise("").alias("collectionId"))
    return loaders.hierarchy(rows, "org")[1]


@query("i16_assignments", "select distinct o_orderpriority || ':' || o_custkey as profile_id, 'ASSIGNED_TO_' || upper(c_mktsegment) as rel, c_custkey as scope from orders join customer on c_custkey = o_custkey where c_custkey % 5 > 0")
def i16(t):
    profiles = t.orders.select(F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("id"), F.array("o_custkey", F.lit(-1).cast("long")).alias("scopes"))
    scopes = t.customer.where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("scope"), F.col("c_mktsegment").alias("scope_type"))
    return loaders.assignments(profiles, scopes)


@query("i18_keyed_parts", "select o || ':' || i as part_id, o as owner, i as index, p as part from (select l_orderkey as o, l_partkey as p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as i from lineitem)")
def i18(t):
    owners = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))
    return loaders.keyed_parts(owners, "l_orderkey", "parts").withColumn("index", F.col("index").cast("long"))


@query("i27_job_states", "select count(*) as jobs, count(*) filter (n_nationkey % 5 = 0) as success, count(*) filter (n_nationkey % 5 = 1) as partial, count(*) filter (n_nationkey % 5 = 2) as failed, count(*) filter (n_nationkey % 5 = 3) as error, count(*) filter (n_nationkey % 5 = 4) as cancelled, 'partial' as state from nation")
def i27(t):
    names = F.array(*[F.lit(x) for x in ("success", "partial", "failed", "error", "cancelled")])
    return loaders.job_states(t.nation.select(names[(F.col("n_nationkey") % 5).cast("int")].alias("status")))


@query("i28_script_catalogue", "select p_name as filename from part where p_brand = 'Brand#13'")
def i28(t):
    return loaders.scripts(t.part.select(F.col("p_name").alias("filename"), F.array("p_brand", "p_type").alias("tags")), "Brand#13").select("filename")


@query("i29_doc_sections", "select page_id, url from pages where url like '%.com%' order by url, page_id limit 20")
def i29(t):
    rows = t.pages.select("page_id", "url", F.when(F.col("url").contains(".com"), "com").otherwise("net").alias("source"), F.col("html").alias("raw"))
    return govern.listed(rows, {"source": "com", "raw": ""}, [F.col("url"), F.col("page_id")], 20, ["raw"]).select("page_id", "url")


@query("i06_endpoint_detail", "select p_partkey as id, p_name as summary from part where p_partkey = 7")
def i06(t):
    endpoints = t.part.select(F.col("p_partkey").alias("id"), _text("GET:/p/", F.col("p_partkey")).alias("endpoint_id"), F.lit("GET").alias("method"), _text("/p/", F.col("p_partkey")).alias("path"), F.col("p_name").alias("summary"))
    return context.resolved_endpoint(endpoints, path="p/7").select("id", "summary")


@query("c29_optional_detail", "select o_orderkey as id, c_name as detail from orders left join (select * from customer where c_custkey % 3 = 0) on c_custkey = o_custkey")
def c29(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"))
    return context.with_detail(rows, "c_custkey", t.customer.where("c_custkey % 3 = 0"), "c_name").select("id", "detail")


# ---- governance
@query("j09_batch_fetch", "select x.k as id, c_name as name, c_custkey is not null as found from (values (3), (1), (99999999)) as x(k) left join customer on c_custkey = x.k")
def j09(t):
    return govern.fetch_batch(t.customer.select("c_custkey", "c_name"), "c_custkey", [3, 1, 99999999]).select(F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("name"), "found")


@query("j14_error_hints", "select o_orderkey as id, case o_orderkey % 5 when 0 then 'check the scope: read, write' when 1 then 'no such path; like it are /a, /b' when 2 then 'no such path' when 3 then 'check the parameters' else '' end as hint from orders")
def j14(t):
    k = F.col("o_orderkey") % 5
    status = F.element_at(F.array(*[F.lit(x) for x in (403, 404, 404, 400, 500)]), (k + 1).cast("int"))
    like = F.when(k == 1, F.array(F.lit("/a"), F.lit("/b"))).otherwise(F.array().cast("array<string>"))
    return t.orders.select(F.col("o_orderkey").alias("id"), govern.error_hint(status, F.lit("no"), F.array(F.lit("read"), F.lit("write")), like).alias("hint"))


@query("h33_readiness", "select s_suppkey as provider, s_nationkey < 15 as configured, s_acctbal > 0 as can_hydrate from supplier")
def h33(t):
    settings = t.supplier.select(F.col("s_suppkey").alias("provider"), F.lit("u").alias("base_url"), F.when(F.col("s_nationkey") < 15, "key").otherwise(" ").alias("credentials"), (F.col("s_acctbal") > 0).alias("client"))
    return hydrate.readiness(settings).select("provider", "configured", "can_hydrate")


@query("e37_sync_health", "select s_suppkey as id, case s_suppkey % 5 when 0 then 'error' when 1 then 'error' when 4 then 'ok' else 'degraded' end as status, case s_suppkey % 5 when 0 then 'timeout' when 1 then 'nothing was read' when 2 then 'some are missing' when 3 then 'some come from the cache' else '' end as reason from supplier")
def e37(t):
    k = F.col("s_suppkey") % 5
    got = audit.sync_health(F.lit(9), F.when(k == 1, 0).otherwise(5), F.when(k == 3, 2).otherwise(0), F.when(k == 2, 1).otherwise(0), F.when(k == 0, "timeout"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), got.alias("h")).select("id", "h.status", "h.reason")


@query("e38_workflow_health", "with m as (select max(ts) as m from events), l as (select user_id, arg_max({'s': event_id % 4, 'seen': ts}, ts) as r from events where event_type in ('click', 'view') group by 1) select user_id as workflow, case when r.s = 0 and epoch_us(m) // 1000000 - epoch_us(r.seen) // 1000000 > 7200 then 'hangs' when r.s = 1 then 'failed' when epoch_us(m) // 1000000 - epoch_us(r.seen) // 1000000 > 129600 then 'too old' end as problem from l, m where r.s = 1 or (r.s = 0 and epoch_us(m) // 1000000 - epoch_us(r.seen) // 1000000 > 7200) or (epoch_us(m) // 1000000 - epoch_us(r.seen) // 1000000 > 129600)")
def e38(t):
    now = t.events.agg(F.max("ts").cast("timestamp")).first()[0]
    k = F.col("event_id") % 4
    event = F.when(F.col("event_type") == "click", "push").when(F.col("event_type") == "view", "schedule").otherwise("pull_request")
    runs = t.events.select(F.col("user_id").alias("workflow"), event.alias("event"), F.when(k == 0, "running").otherwise("completed").alias("status"), F.when(k == 1, "failure").when(k > 1, "success").alias("conclusion"), F.col("ts").cast("timestamp").alias("started_at"))
    return audit.workflow_health(runs, F.lit(now))


@query("e36_corpus_report", "select case when p_size % 10 = 0 then 'failed' else 'ok' end as status, count(*) as n, sum(p_size) as n_nodes, least(count(*), 25) as n_samples, min(p_partkey)::varchar as first from part group by 1")
def e36(t):
    rows = t.part.select(F.format_string("%012d", "p_partkey").alias("path"), F.when(F.col("p_size") % 10 == 0, "failed").otherwise("ok").alias("status"), F.lit("").alias("message"), F.col("p_size").cast("long").alias("n_nodes"))
    return audit.corpus_report(rows).select("status", "n", "n_nodes", F.size("samples").cast("long").alias("n_samples"), F.col("samples")[0]["path"].cast("long").cast("string").alias("first"))


@query("g19_catalogue_rank", "select p_partkey as id, dense_rank() over (partition by p_brand order by length(p_name) desc, sha1(p_name) desc) as rank from part")
def g19_rank(t):
    return t.part.select(F.col("p_partkey").alias("id"), semantic.catalogue_rank(t.part, ["p_brand"], "p_name").cast("long").alias("rank"))


@query("i08_rendered_tree", "select '## ' || p_brand || ' (' || count(distinct p_type) || ')' as head, p_brand as category from part group by 2")
def i08_tree(t):
    rows = t.part.select(F.col("p_brand").alias("category"), F.lit("GET").alias("method"), F.concat(F.lit("/api/"), F.replace("p_type", F.lit(" "), F.lit("/"))).alias("path"), F.lit(False).alias("deprecated"))
    return topology.rendered_trees(rows).select(F.substring_index("text", "\n", 1).alias("head"), "category")


