"""Hydration (H): responses, facts, candidates and plans that are made from the driver's rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import jsonops
from weftgraph.operators import hydrate
from weftgraph.queries import query

_text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _responses(t):
    """observation_id and rawJson of each order: an envelope with items, one with other lists, a bare list, one object."""
    line = F.struct(_text("L", F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("serial"), F.col("l_quantity").alias("qty"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("l"))
    errors = F.sequence(F.lit(1), F.lit(200))
    rows = t.orders.join(lines, "o_orderkey", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<serial:string,qty:double>>")))
    kind = F.col("o_orderkey") % 4
    one = F.array(F.struct(F.lit(1).alias("x")))
    raw = (
        F.when(kind == 0, F.to_json(F.struct(errors.alias("errors"), F.col("l").alias("items"))))
        .when(kind == 1, F.to_json(F.struct(errors.alias("errors"), F.col("l").alias("data"), one.alias("one"))))
        .when(kind == 2, F.to_json("l"))
        .otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.size("l").alias("lines"))))
    )
    return rows.select(F.col("o_orderkey").alias("observation_id"), raw.alias("rawJson"))


_COUNTED = "(select o_orderkey as o, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1)"


@query("h11_observed_objects", f"select o as id, i as item_index, case o % 4 when 0 then '/items/' || i when 1 then '/data/' || i else '/' || i end as pointer from {_COUNTED}, unnest(range(0, n)) as r(i) where o % 4 < 3 union all select o, -1, '' from {_COUNTED} where o % 4 = 3 union all select o, 0, '/one/0' from {_COUNTED} where o % 4 = 1 and n = 0")
def h11(t):
    return hydrate.objects(_responses(t)).select(F.col("observation_id").alias("id"), F.col("item_index").cast("long").alias("item_index"), "pointer")


@query("h10_item_count", f"select o as id, case o % 4 when 0 then 'items' when 1 then (case when n = 0 then 'one' else 'data' end) else '' end as item_key, case o % 4 when 3 then 1 when 1 then greatest(n, 1) else n end as n from {_COUNTED}")
def h10(t):
    raw = F.col("rawJson")
    return _responses(t).select(F.col("observation_id").alias("id"), hydrate.item_key(raw).alias("item_key"), hydrate.item_count(raw).cast("long").alias("n"))


@query("a26_pager_key", "select o_orderkey as id, case o_orderkey % 4 when 0 then 'items' when 1 then 'data' end as item_key from orders")
def a26(t):
    return _responses(t).select(F.col("observation_id").alias("id"), hydrate.pager_key(F.col("rawJson")).alias("item_key"))


_CANON = "'{\"a\":\"' || event_type || '\",\"b\":{\"x\":[' || user_id || ',null,true],\"y\":\"' || event_id || '\"}}'"


@query("h14_canonical_hash", f"select event_id, sha256({_CANON}) as hash, octet_length(encode({_CANON})) as size from events")
def h14(t):
    raw = _text('{ "b" : {"y":"', F.col("event_id"), '", "x": [ ', F.col("user_id"), ', null,true ]},\n "a":"', F.col("event_type"), '" }')
    return t.events.select("event_id", jsonops.content_hash(raw).alias("hash"), F.octet_length(jsonops.canonical(raw)).cast("long").alias("size"))


def _objects(t):
    """Objects of six kinds, by event: what identifies them, and how well, differs."""
    k = F.col("event_id") % 6
    i = F.col("event_id").cast("string")
    raw = (
        F.when(k == 0, _text('{"Serial":"S', i, '","name":"n"}'))
        .when(k == 1, _text('{"serial":"S","id":', i, "}"))
        .when(k == 2, _text('{"uid":"é', i, '"}'))
        .when(k == 3, _text('{"hostname":"x","uid":"u', i, '"}'))
        .when(k == 4, F.lit('{"serial":"","name":null,"value":3}'))
        .otherwise(_text('{"name":"n', i, '","siteId":true}'))
    )
    schema = F.when(F.col("event_id") % 3 == 0, F.lit("src:schemas:Device#x"))
    cols = [i.alias("observation_id"), _text("o", i).alias("object_id"), _text("r", i).alias("run_id"), _text("GET:/v1/", F.col("event_type")).alias("endpoint_id"), schema.alias("schema_component_id")]
    return t.events.select("event_id", raw.alias("raw"), *cols)


_IDENT = "case event_id % 6 when 0 then 'Serial=S' || event_id when 1 then 'id=' || event_id when 2 then 'uid=é' || event_id when 3 then 'uid=u' || event_id when 4 then '' else 'siteId=True' end"
_KIND = "case when event_id % 3 = 0 then 'Device' else event_type end"
_FACT = f"case when event_id % 6 <> 4 then 'fact:' || sha256('{{\"endpoint_id\":\"GET:/v1/' || event_type || '\",\"entity_type\":\"' || {_KIND} || '\",\"identity_key\":\"' || replace({_IDENT}, 'é', '\\u00e9') || '\",\"object_id\":\"o' || event_id || '\",\"observation_id\":\"' || event_id || '\"}}') end"


@query("h16_identity_facts", f"select event_id, {_IDENT} as identity_key, case event_id % 6 when 0 then 'Serial' when 1 then 'id' when 4 then '' when 5 then 'siteId' else 'uid' end as identity_field, {_KIND} as entity_type, case event_id % 6 when 1 then 'high' when 2 then 'low' else 'medium' end as confidence, {_FACT} as fact_id, case when event_id % 6 = 4 then 'identity_unknown' end as skipped from events")
def h16(t):
    return hydrate.facts(_objects(t)).select("event_id", "identity_key", "identity_field", "entity_type", "confidence", "fact_id", "skipped")


@query("h21_provenance", f"select unnest([{{'rel': 'OBSERVATION_MATERIALIZED_FACT', 'src': event_id::varchar, 'dst': f}}, {{'rel': 'FACT_FROM_OBJECT', 'src': f, 'dst': 'o' || event_id}}, {{'rel': 'FACT_FROM_RUN', 'src': f, 'dst': 'r' || event_id}}, {{'rel': 'FACT_FROM_API', 'src': f, 'dst': 'GET:/v1/' || event_type}}], recursive := true) from (select *, {_FACT} as f from events where event_id % 6 <> 4)")
def h21(t):
    return hydrate.provenance(hydrate.facts(_objects(t)))


@query("h22_promote", "select event_type as entity_type, json_extract_string(props, '$.k') as k, arg_max(event_id, (ts, event_id)) as latest_fact_id, count(*) as fact_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at from events group by 1, 2")
def h22(t):
    facts = t.events.select(F.col("event_type").alias("entity_type"), F.get_json_object("props", "$.k").alias("k"), F.col("event_id").alias("fact_id"), "ts")
    out = hydrate.promote(facts, ["entity_type", "k"], "ts", F.struct("ts", "fact_id"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


@query("h18_object_schema", "select l_orderkey as o, l_linenumber as n, l_partkey as p, 'c' || case when l_linenumber = 1 or l_partkey % 5 = 0 then l_suppkey::varchar when l_suppkey % 2 = 0 then l_suppkey || ':item' else l_suppkey || ':type' end as resolved from lineitem")
def h18(t):
    key = _text("c", F.col("s_suppkey"))
    item = F.when(F.col("s_suppkey") % 2 == 0, _text(key, ":item"))
    properties = t.supplier.select(key.alias("parent_component_id"), F.lit("items").alias("name"), item.alias("item_component_id"), _text(key, ":type").alias("type_component_id"))
    pointer = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_partkey") % 5 == 0, _text("/", F.col("l_linenumber"))).otherwise(_text("/items/", F.col("l_linenumber")))
    index = F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("l_linenumber"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), _text("c", F.col("l_suppkey")).alias("schema_component_id"), index.alias("item_index"), pointer.alias("pointer"))
    return hydrate.object_schema(rows, properties).select("o", "n", "p", F.col("resolved_component_id").alias("resolved"))


# ---- endpoints: parts as endpoints, lines as their parameters and responses, suppliers as schemas
def _endpoints(t):
    key = F.col("p_partkey")
    method = F.when(key % 7 == 0, "POST").otherwise("GET")
    path = F.when(F.col("p_size") % 9 == 0, _text("/p/{id}/", key)).otherwise(_text("/p/", key))
    return t.part.select(key.alias("endpoint_id"), method.alias("method"), path.alias("path"), F.col("p_name").alias("summary"), F.col("p_type").alias("operationId"))


def _parameters(t):
    n = F.col("l_linenumber")
    name = F.element_at(F.array(*[F.lit(x) for x in ("limit", "offset", "next", "cursor", "filter", "id", "sort")]), n)
    place = F.when(n == 6, "path").when(n == 7, "header").otherwise("Query")
    return t.lineitem.select(F.col("l_partkey").alias("endpoint_id"), name.alias("name"), place.alias("location"), n.isin(1, 6).alias("required")).distinct()


def _endpoint_responses(t):
    status = F.when(F.col("l_returnflag") == "N", "200").when(F.col("l_returnflag") == "R", "201").otherwise("404")
    component = F.when(F.col("l_linestatus") == "F", _text("src:schemas:", F.col("l_suppkey")))
    shape = F.when(F.col("l_suppkey") % 3 == 0, "array").otherwise("object")
    return t.lineitem.select(F.col("l_partkey").alias("endpoint_id"), status.alias("status"), F.lit("application/json").alias("content_type"), component.alias("component_id"), shape.alias("body_shape"), F.lit("").alias("schema_type"))


def _hints(t):
    names = F.element_at(F.array(F.array(F.lit("name"), F.lit("serial"), F.lit("zone")), F.array(F.lit("name")), F.array().cast("array<string>"), F.array(F.lit("other"), F.lit("id"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t.supplier.select(_text("src:schemas:", F.col("s_suppkey")).alias("component_id"), F.explode(names).alias("name"))


_PARAMS = "params as (select l_partkey as p, bool_or(l_linenumber = 1) as lim, bool_or(l_linenumber = 2) as off, bool_or(l_linenumber = 3) as nxt, bool_or(l_linenumber = 4) as cur, bool_or(l_linenumber = 6) as pth from lineitem group by 1)"
_ROOTS = "roots as (select l_partkey as p, arg_min(struct_pack(s := st, k := l_suppkey), (not starts_with(st, '2'), st, 'src:schemas:' || l_suppkey)) as r from (select *, case l_returnflag when 'N' then '200' when 'R' then '201' else '404' end as st from lineitem where l_linestatus = 'F') group by 1)"
_STYLE = "case when lim and off then 'offset' when lim and nxt then 'cursor' when cur then 'cursor' when lim then 'bounded_list' else 'none_detected' end"
_PLANNED = f"""with {_PARAMS}, {_ROOTS}, e as (select p_partkey, p_size, case when p_partkey % 7 = 0 then 'POST' else 'GET' end as method, r, coalesce(lim, false) as lim, coalesce(off, false) as off, coalesce(nxt, false) as nxt, coalesce(cur, false) as cur, coalesce(pth, false) as pth
from part left join params on params.p = p_partkey left join roots on roots.p = p_partkey), c as (select *, {_STYLE} as style, lim and (off or nxt) as medium, case r.k % 4 when 0 then 'serial' when 1 then 'name' when 3 then 'id' else '' end as hint from e)"""
_CANDIDATE = f"""{_PLANNED}
select p_partkey as id, case when pth or p_size % 9 = 0 then 'parameterized_lookup' when style <> 'none_detected' or (r is not null and r.k % 3 = 0) or lim or off or nxt or cur then 'collection' else 'single_or_unknown' end as shape, style, coalesce(r.s, '') as status, coalesce(hint, '') as first_hint,
case when method <> 'GET' and r is null then 'not_get,no_response_schema' when method <> 'GET' then 'not_get' when r is null then 'no_response_schema' else '' end as blockers,
case when method <> 'GET' then 'unsupported' when r is null then 'low' when hint in ('serial', 'id') and medium then 'high' when hint <> '' then 'medium' else 'low' end as confidence from c"""


def _candidates(t):
    return hydrate.candidates(_endpoints(t), _parameters(t), _endpoint_responses(t), _hints(t))


@query("h02_candidates", _CANDIDATE)
def h02(t):
    first = F.coalesce(F.get(F.col("identity.fields"), F.lit(0)), F.lit(""))
    return _candidates(t).select(F.col("endpoint_id").alias("id"), F.col("execution_shape").alias("shape"), F.col("paging.style").alias("style"), F.coalesce("root.status", F.lit("")).alias("status"), first.alias("first_hint"), F.array_join("blockers", ",").alias("blockers"), "confidence")


@query("h01_search_endpoints", "select p_partkey as id, case when p_size % 9 = 0 then '/p/{id}/' || p_partkey else '/p/' || p_partkey end as path from part where p_partkey % 7 <> 0 and (contains(lower(p_name), 'st') or contains(lower(p_type), 'st')) and exists (select 1 from lineitem where l_partkey = p_partkey and l_linestatus = 'F') order by path, id limit 25")
def h01(t):
    return hydrate.search_endpoints(_endpoints(t), " ST", 25, "src", _endpoint_responses(t)).select(F.col("endpoint_id").alias("id"), "path")


_STATE = "case when p_size % 5 = 0 then null when p_size % 5 = 1 then 'stale' when p_size % 5 = 2 then 'unknown' else 'fresh' end"
_ACTION = f"""{_PLANNED}, s as (select *, {_STATE} as state, p_size * 10 as age from c),
a as (select *, case when p_size % 10 = 9 then 'select_matching_provider' when method <> 'GET' or r is null then 'unsupported' when cur then 'ask_for_parameters'
when p_size % 3 = 0 and state is null then 'configure_provider_or_use_existing_graph' when state is null then 'hydrate_endpoint'
when state = 'fresh' and age < 300 and p_partkey % 2 = 0 then 'use_materialized_facts' when state = 'fresh' and age < 300 then 'materialize_existing_observation'
when p_size % 3 = 0 then 'use_stale_observation_or_configure_provider' else 'refresh_hydration' end as action from s)"""


def _plans(t):
    state = t.part.select(F.col("p_partkey").alias("endpoint_id"), "p_size", "p_brand")
    rows = _candidates(t).join(state, "endpoint_id")
    k = F.col("p_size") % 5
    state = F.when(k == 1, "stale").when(k == 2, "unknown").when(k > 2, "fresh")
    wrong = F.when(F.array_contains("query_names", "cursor"), F.array(F.lit("query:cursor"))).otherwise(F.array().cast("array<string>"))
    action = hydrate.plan_action(
        endpoint_provider=F.when(F.col("p_size") % 10 == 9, "b").otherwise("a"), provider=F.lit("a"), blockers=F.col("blockers"), errors=wrong, can_hydrate=F.col("p_size") % 3 != 0, observed=k != 0,
        state=state, age_seconds=F.col("p_size") * 10, fact_count=F.when(F.col("endpoint_id") % 2 == 0, 3).otherwise(0), freshness_target=F.lit(300),
    )
    return rows.select("endpoint_id", "p_brand", action.alias("action"))


@query("h25_action_plan", f"{_ACTION} select p_partkey as id, action from a")
def h25(t):
    return _plans(t).select(F.col("endpoint_id").alias("id"), "action")


@query("h26_best_action", f"{_ACTION}, n as (select *, list_position(['{"', '".join(hydrate.ACTIONS)}'], action) as rank from a join part using (p_partkey)) select p_brand as brand, arg_min(action, (rank, -p_partkey)) as action, arg_min(p_partkey, (rank, -p_partkey)) as id from n group by 1")
def h26(t):
    return hydrate.best_action(_plans(t).withColumn("ord", F.col("endpoint_id")), ["p_brand"]).select(F.col("p_brand").alias("brand"), "action", F.col("endpoint_id").alias("id"))


@query("h34_call_plans", f"{_ACTION} select p_partkey as id, case when action in ('hydrate_endpoint', 'refresh_hydration') then 'hydrate_runtime_endpoint' when action = 'materialize_existing_observation' then 'materialize_runtime_facts' end as tool, case when action in ('hydrate_endpoint', 'refresh_hydration') then p_partkey::varchar when action = 'materialize_existing_observation' then 'obs' || p_partkey end as target from a")
def h34(t):
    key = F.col("endpoint_id").cast("string")
    plan = hydrate.call_plan(F.col("action"), key, F.lit("a"), _text("obs", key))
    return _plans(t).select(F.col("endpoint_id").alias("id"), plan.alias("plan")).select("id", "plan.tool", F.coalesce(F.col("plan.args")["endpoint_id"], F.col("plan.args")["observation_id"]).alias("target"))


@query("h28_provider_alias", "select c_custkey as id, case lower(trim(c_mktsegment)) when 'building' then 'works' when 'machinery' then 'works' when 'household' then 'home' else '' end as provider from customer")
def h28(t):
    alias = {"works": ["building", "machinery"], "home": ["household"]}
    return t.customer.select(F.col("c_custkey").alias("id"), hydrate.provider_of(_text(" ", F.col("c_mktsegment"), " "), alias).alias("provider"))


@query("h09_call_checks", "select o_orderkey as id, case when not coalesce(bool_or(l_linenumber = 1), false) then 'path:one' || case when coalesce(bool_or(l_linenumber = 3), false) then '' else ',query:three' end when coalesce(bool_or(l_linenumber = 3), false) then '' else 'query:three' end as errors, coalesce(string_agg(distinct 'x' || l_linenumber, ',' order by 'x' || l_linenumber) filter (l_linenumber > 4), '') as unknown from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def h09(t):
    texts = lambda *v: F.array(*[F.lit(x) for x in v])
    n = F.collect_set("l_linenumber")
    given = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(n.alias("n"))
    path = F.when(F.array_contains("n", 1), texts("one")).otherwise(F.array().cast("array<string>"))
    names = F.transform(F.array_sort("n"), lambda x: F.when(x == 3, "three").otherwise(_text("x", x)))
    errors = hydrate.call_errors(texts("one"), texts("one", "three"), path, names)
    found = hydrate.body_findings(texts("three"), texts("three", "x1", "x2", "x4"), names)
    return given.select(F.col("o_orderkey").alias("id"), F.array_join(errors, ",").alias("errors"), F.array_join(found["warnings"], ",").alias("unknown"))


def _observations(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("endpoint_id"), F.when(F.col("event_id") % 13 != 0, ts).alias("observedAt"), (F.col("event_id") % 3 * 7200).alias("staleAfterSeconds"), F.col("props").alias("rawJson"), F.col("event_type").alias("kind"))


@query("h31_endpoint_state", "with o as (select user_id, event_id, case when event_id % 13 <> 0 then ts end as seen, event_id % 3 * 7200 as ttl from events), l as (select user_id, arg_max({'i': event_id, 'seen': seen, 'ttl': ttl}, (seen is not null, seen, event_id)) as o from o group by 1), m as (select max(ts) as m from events) select c_custkey as id, case when o is null then 'missing' when o.seen is null then 'unknown' when o.ttl <= 0 or epoch_us(m) // 1000000 - epoch_us(o.seen) // 1000000 > o.ttl then 'stale' else 'fresh' end as state, o.i as observation_id from m, customer left join l on user_id = c_custkey")
def h31(t):
    now = t.events.agg(F.max("ts").cast("timestamp").alias("as_of"))
    stamped = _observations(t)
    last = hydrate.endpoint_states(t.customer.select(F.col("c_custkey").alias("endpoint_id")), stamped, F.lit(now.first()[0]))
    return last.select(F.col("endpoint_id").alias("id"), "state", "observation_id")


@query("h27_ledger", "select event_id as id, case when event_id % 9 = 0 or event_id % 4 = 1 then 'error' else 'success' end as status, case when event_id % 9 = 0 then 'timeout' when event_id % 4 = 1 then 'response of 120 bytes is over the cap' else '' end as error, case event_id % 4 when 0 then 15 when 1 then 120 when 2 then 2 else 7 end as bytes, case when event_id % 9 = 0 or event_id % 4 = 1 then 0 when event_id % 4 = 0 then 2 when event_id % 4 = 2 then 0 else 1 end as items, sha256('{\"a\":1,\"id\":' || event_id || '}') as request_hash from events")
def h27(t):
    k = F.col("event_id") % 4
    response = F.when(k == 0, F.lit('{"items":[1,2]}')).when(k == 1, F.rpad(F.lit("[1]"), 120, " ")).when(k == 2, F.lit("[]")).otherwise(F.lit('{"a":1}'))
    calls = t.events.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("endpoint_id"), _text('{"id": ', F.col("event_id"), ', "a": 1}').alias("request"), response.alias("response"), F.when(F.col("event_id") % 9 == 0, "timeout").alias("error"), F.lit(5).alias("duration_ms"))
    return hydrate.ledger(calls, 100).select(F.col("run_id").alias("id"), "status", "error", F.col("response_bytes").alias("bytes"), F.col("item_count").alias("items"), "request_hash")


@query("h29_readers", "select event_id as observation_id, user_id as endpoint_id from events where event_type = 'purchase' and user_id = 7 order by ts desc, event_id limit 25")
def h29(t):
    from weftgraph.operators.govern import listed

    return listed(t.events.select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("endpoint_id"), "event_type", "ts", F.col("props").alias("rawJson")), {"event_type": "purchase", "endpoint_id": 7}, [F.desc("ts"), F.col("observation_id")], 25, ["rawJson"]).select("observation_id", "endpoint_id")


@query("h32_observation_detail", "with r as (select l_orderkey as o, l_linenumber as n, l_partkey as p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k from lineitem) select o_orderkey as id, coalesce((select string_agg(n || ':' || p || ':p,q', ';' order by n, p) from r where o = o_orderkey and k <= 3), '') as objects from orders")
def h32(t):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("observation_id"), F.col("l_linenumber").alias("item_index"), _text(F.col("l_partkey")).alias("pointer"), F.col("l_partkey").alias("p"), r.alias("r"), "l_suppkey")
    objs = lines.select("observation_id", _text(F.col("observation_id"), "-", F.col("r")).alias("object_id"), "item_index", F.format_string("/%09d/%09d", "p", "l_suppkey").alias("pointer"))
    member = F.explode(F.array(*[F.lit(x) for x in ("z", "q", "p")])).alias("name")
    flds = objs.select("object_id", member).select("object_id", "name", F.lit("1").alias("value_json"), F.lit("number").alias("kind"))
    observations = t.orders.select(F.col("o_orderkey").alias("observation_id"), F.lit("{}").alias("rawJson"))
    detail = hydrate.observation_detail(observations, objs, flds, 3, 2)
    shown = F.transform("objects", lambda o: F.concat_ws(":", o["item_index"], F.substring(o["pointer"], 2, 9).cast("long"), F.array_join(F.transform(o["fields"], lambda f: f["name"]), ",")))
    return detail.select(F.col("observation_id").alias("id"), F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("objects"))
