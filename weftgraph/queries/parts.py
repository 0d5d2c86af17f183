"""Small parts of the engine, each over rows of its own or the driver's: values, guards, trees, rules and tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import jsonops, scalar
from weftgraph.operators import audit, decompose, export, govern, hydrate, normalise, search, semantic, shapes, topology
from weftgraph.plans import writers
from weftgraph.plans.cypher import CypherError, cypher
from weftgraph.plans.graph import PropertyGraph
from weftgraph.queries import query
from weftgraph.queries.apidocs import _REF, _counts, _each, _layer, _specs
from weftgraph.session import shared_folder
from weftgraph.sources import files, pages
from weftgraph.streaming import observations

_text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _cases(name: str, cases: list[tuple], columns: list[str], kinds: str):
    """A query over a list of stated cases: the last column is what is expected, the others say the case."""

    def values(rows):
        show = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"
        return ", ".join("(" + ", ".join(show(x) for x in r) + ")" for r in rows)

    def register(f):
        query(name, f"select * from (values {values([(i, r[-1]) for i, r in enumerate(cases)])}) as c(id, {columns[-1]})")(lambda t: f(t, t.spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(cases)], f"id int, {kinds}")).select("id", columns[-1]))
        return f

    return register


# ---- values
@_cases("b35_truthy", [("true", True), ("TRUE", True), ("yes", False), ("1", False), (None, False), ("", False)], ["x", "y"], "x string")
def b35(t, df):
    return df.withColumn("y", scalar.truthy(F.col("x")))


@_cases("b36_safe_parse", [("7", 7), (" 7 ", 7), ("7.5", 0), ("x", 0), (None, 0), ("-3", -3)], ["x", "y"], "x string")
def b36(t, df):
    return df.withColumn("y", scalar.safe_int(F.trim("x")))


@_cases("b36_safe_time", [("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05+01:00", "2024-01-02 02:04:05"), ("no", None), (None, None), ("2024-01-02", "2024-01-02 00:00:00")], ["x", "y"], "x string")
def b36t(t, df):
    return df.withColumn("y", F.date_format(scalar.safe_time(F.col("x")), "yyyy-MM-dd HH:mm:ss"))


@_cases("b37_normal_path", [("/a", "/a"), (" a/b ", "/a/b"), ("", "/"), ("a", "/a")], ["x", "y"], "x string")
def b37(t, df):
    return df.withColumn("y", scalar.normal_path(F.col("x")))


@_cases("b30_clamped_limits", [("5", 5), ("0", 25), ("-1", 25), ("x", 25), ("9999", 200), (None, 25)], ["x", "y"], "x string")
def b30(t, df):
    return df.sparkSession.createDataFrame([(r["id"], scalar.clamp(r["x"], 25, 200)) for r in df.collect()], "id int, y int")  # six values of a client's


@query("b34_case_folded", "select c_custkey as id from customer where upper(c_name) = 'CUSTOMER#000000007'")
def b34(t):
    return cypher(t.g, "MATCH (c:Customer) WHERE toUpper(c.c_name) = toUpper($name) RETURN c.c_custkey AS id", {"name": "customer#000000007"})


@query("b15_coalesce", "select o_orderkey as id, coalesce(case when o_orderstatus = 'P' then null else o_orderstatus end, 'none') as status from orders")
def b15(t):
    g = PropertyGraph().add_node("Order", t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")), "o_orderkey")
    return cypher(g, "MATCH (o:Order) RETURN o.o_orderkey AS id, coalesce(o.status, 'none') AS status")


@query("b29_quoted_names", "select r_regionkey as the_key, r_name as name from region")
def b29(t):
    return cypher(t.g, "MATCH (`r`:Region) RETURN `r`.`r_regionkey` AS `the_key`, r.r_name AS name")


@query("b31_constants", "select 1 as one, 'x' as letter, true as flag, [1, 2][2] as second")
def b31(t):
    return cypher(t.g, "RETURN 1 AS one, 'x' AS letter, true AS flag, [1, 2][1] AS second")


# ---- graph tables
@query("a08_load_nodes", "select count(*) + 2 as n, max(r_regionkey) + 2 as last from region")
def a08(t):
    last = t.region.agg(F.max("r_regionkey")).first()[0]
    more = t.spark.createDataFrame([(last + 1, "NEW"), (last + 2, None)], t.region.schema)
    g = PropertyGraph().add_node("Region", t.region, "r_regionkey").load_nodes("Region", more)
    return cypher(g, "MATCH (r:Region) RETURN count(*) AS n, max(r.r_regionkey) AS last")


@query("a09_load_edges", "select n_name as nation, 2 as n from nation where n_nationkey < 5 union all select n_name, 1 from nation where n_nationkey >= 5")
def a09(t):
    g = PropertyGraph().add_node("Nation", t.nation, "n_nationkey").add_node("Region", t.region, "r_regionkey")
    g.add_rel("IN", t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")), "Nation", "Region")
    g.load_rels("IN", t.nation.where("n_nationkey < 5").select(F.col("n_nationkey").alias("src"), F.lit(0).alias("dst")))
    return cypher(g, "MATCH (n:Nation)-[:IN]->(r:Region) RETURN n.n_name AS nation, count(*) AS n")


@query("a15_added_column", "select r_regionkey as id, null::varchar as note, r_name as name from region")
def a15(t):
    g = PropertyGraph().add_node("Region", t.region, "r_regionkey").add_column("Region", "note", "string").add_column("Region", "r_name", "string")
    return cypher(g, "MATCH (r:Region) RETURN r.r_regionkey AS id, r.note AS note, r.r_name AS name")


@query("a17_schema_hint", "select 'Region(r_regionkey, r_name) | ' as hint, 'Region has no property x; it has r_regionkey, r_name.' as told, 'There is no label Y; labels are Region.' as missing")
def a17(t):
    g = PropertyGraph().add_node("Region", t.region, "r_regionkey")
    return t.spark.createDataFrame([(g.hint(), g.property_hint("Region", "x"), g.property_hint("Y", "x"))], "hint string, told string, missing string")


@query("d01_create_nodes", "select 'Site' as kind, count(*) as n from supplier union all select 'Region', count(*) from region")
def d01(t):
    g = PropertyGraph().add_node("Site", t.supplier.limit(0).select("s_suppkey", "s_name"), "s_suppkey").add_node("Region", t.region, "r_regionkey")
    g.load_nodes("Site", t.supplier.select("s_suppkey", "s_name"))
    return reduce(DataFrame.union, [g.node(k).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k in ("Site", "Region")])


# ---- files
@query("a24_fresh_or_stale", "select o_orderkey as id, case when o_orderkey % 3 = 0 then 'old' when o_orderkey % 2 = 0 then 'new' else 'old' end as body, case when o_orderkey % 3 = 0 then 'cached' when o_orderkey % 2 = 0 then 'fetched' else 'stale' end as outcome from orders")
def a24(t):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    at = F.when(F.col("o_orderkey") % 3 == 0, now - F.expr("interval 1 hour")).otherwise(now - F.expr("interval 2 days"))
    cached = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("old").alias("body"), at.alias("fetched_at"))
    return files.fresh_or_stale(cached, t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("body")), "id", now, 86400)


@query("a30_swapped_table", "select count(*) as n, 'second' as version from supplier")
def a30(t):
    path = f"{shared_folder(t.spark)}/swapped"
    files.swap_table(t.customer.select(F.lit("first").alias("version")), path)
    files.swap_table(t.supplier.select(F.lit("second").alias("version")), path)
    return t.spark.read.parquet(path).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@query("a31_capped_json", "select doc_id, case when 15 + length(doc_id::varchar) + octet_length(encode(text)) <= 240 then 'whole' when doc_id % 5 > 0 then 'redacted' else 'stub' end as form from documents where text is not null")
def a31(t):
    plain = F.regexp_replace("text", r'[\\"\x00-\x1f]', " ")
    kept = F.when(F.col("doc_id") % 5 == 0, F.rpad(F.lit(""), 300, "s"))
    whole, less = F.struct(F.col("doc_id").alias("i"), plain.alias("raw")), F.struct(F.col("doc_id").alias("i"), kept.alias("kept"))
    out = files.capped_json(whole, less, 240)
    form = F.when(out.contains('"raw"'), "whole").when(out.contains('"error"'), "stub").otherwise("redacted")
    return t.documents.where("text is not null").select("doc_id", form.alias("form"))


# ---- guards and envelopes
@_cases("d09_read_guard", [("MATCH (r:Region) RETURN r.r_name AS x", "ok"), ("MATCH (r:Region) DELETE r", "DELETE is not allowed in a read query"), ("CREATE (r:Region) RETURN r", "CREATE is not allowed in a read query"), ("MATCH (r:Region) WHERE r.r_name = 'set' RETURN r.r_name AS x", "ok")], ["q", "said"], "q string")
def d09(t, df):
    def say(q):
        try:
            cypher(t.g, q)
            return "ok"
        except CypherError as e:
            return str(e)

    return df.sparkSession.createDataFrame([(r["id"], say(r["q"])) for r in df.collect()], "id int, said string")


@_cases("d10_write_guard", [("MERGE (a:X)", None), ("DROP TABLE x", "DROP is not allowed"), ("MATCH (a) RETURN a", "it changes nothing: CREATE, MERGE, SET, DELETE or REMOVE is needed"), ("MATCH (a) SET a.x = 'copy'", None)], ["q", "said"], "q string")
def d10(t, df):
    return df.sparkSession.createDataFrame([(r["id"], govern.write_problem(r["q"])) for r in df.collect()], "id int, said string")


@_cases("d11_literals", [("it's", "it's"), ("a\\b", "a\\b"), ('say "x"', 'say "x"'), ("", "")], ["x", "back"], "x string")
def d11(t, df):
    return df.sparkSession.createDataFrame([(r["id"], cypher(t.g, f"RETURN {govern.literal(r['x'])} AS x").first()["x"]) for r in df.collect()], "id int, back string")


@query("j01_query_runner", "select 'rows' as part, 200 as n union all select 'truncated', 1 union all select 'over', 1")
def j01(t):
    many = t.spark.range(300)
    cut, over = govern.run(many), govern.run(t.spark.range(2500))
    return t.spark.createDataFrame([("rows", len(cut["rows"])), ("truncated", int(cut["truncated"])), ("over", int("error" in over))], "part string, n int")


@query("j08_batch_queries", "select 2 as ok, 1 as failed, (select count(*) from region) as first_rows")
def j08(t):
    batch = govern.run_batch(["MATCH (r:Region) RETURN r.r_name AS x", "MATCH (", "RETURN 1 AS x"], lambda q: govern.run(cypher(t.g, q)))
    return t.spark.createDataFrame([(batch["ok"], batch["failed"], batch["results"][0]["row_count"])], "ok int, failed int, first_rows int")


@query("j06_alias_labels", "select * from (values ('c', 'Customer'), ('o', 'Order')) as x(alias, label)")
def j06(t):
    return t.spark.createDataFrame(sorted(govern.alias_labels("MATCH (o:Order)-[r:PLACED_BY]->(c:Customer) WHERE (o:Old) RETURN c").items()), "alias string, label string")


@_cases("j11_focused_views", [("MATCH (c:Customer)-[:LIVES_IN]->(n:Nation) RETURN n.n_name", None), ("MATCH (o:Order) RETURN o.o_orderkey", "Order is not in people"), ("MATCH (c:Customer)-[:LIVES_IN|BASED_IN]->(n) RETURN n", "BASED_IN is not in people")], ["q", "said"], "q string")
def j11(t, df):
    govern.VIEWS["people"] = {"Customer", "Nation", "LIVES_IN"}
    return df.sparkSession.createDataFrame([(r["id"], govern.view_problem("people", r["q"])) for r in df.collect()], "id int, said string")


@query("j13_latest_observations", "select user_id, max(event_id) as event_id from events group by 1")
def j13(t):
    folder = shared_folder(t.spark)
    step = observations.latest_state(folder, ["user_id"], "event_id")
    for k in range(3):  # three polls, each of which appends what it saw
        step(t.events.where(F.col("event_id") % 3 == k).select("user_id", "event_id"), k)
    return t.spark.read.parquet(f"{folder}/v2")


@query("j15_validation_text", "select '1 errors, 1 warnings\n- error: missing query parameter x\n- warning: unknown field y\nfields: a, b' as said")
def j15(t):
    return t.spark.createDataFrame([(govern.validation_text(["missing query parameter x"], ["unknown field y"], ["a", "b"]),)], "said string")


# ---- audits
@query("e09_duplicate_names", "select l_orderkey as parent, l_linenumber as name, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def e09(t):
    return audit.duplicate_keys(t.lineitem.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("name")), ["parent", "name"])


@query("e18_alias_equivalent", "select p_name || '#x' as k from part where p_partkey % 2 = 0 group by 1")
def e18(t):
    missing = t.part.select(F.concat("p_name", F.lit("#x")).alias("k"), "p_partkey").where("p_partkey % 2 = 0").select("k").distinct()
    ours = t.part.where("p_partkey % 2 = 0").select(F.concat("p_name", F.lit("@0123456789ab#x")).alias("k"))
    return audit.alias_equivalent(missing, ours, "k")


@query("e19_alternate_target", "select s_suppkey as slot, 'a' || s_suppkey as target from supplier where s_suppkey % 3 > 0")
def e19(t):
    missing = t.supplier.select(F.col("s_suppkey").alias("slot"), _text("a", F.col("s_suppkey")).alias("target"))
    other = t.supplier.select(F.col("s_suppkey").alias("slot"), _text("b", F.col("s_suppkey")).alias("target"))
    return audit.alternate_target(missing, other.unionByName(other.where("slot % 3 = 0").withColumn("target", F.lit("c"))), ["slot"])


@query("e21_parity_text", "select 'parity: 1 of 1 checks have gaps\n- schema_components: ' || count(*) || ' of ' || (select count(*) from region) || ' missing, as [\"' || min(r_name) || '\"]' as said from region where r_regionkey > 2")
def e21(t):
    theirs = t.region.select(F.col("r_name").alias("component_id"))
    return t.spark.createDataFrame([(audit.parity_text(audit.parity_of("schema_components", theirs.join(t.region.where("r_regionkey <= 2").select(F.col("r_name").alias("component_id")), "component_id"), theirs)),)], "said string")


@query("e27_coverage_status", "select s_suppkey as id, case when s_suppkey % 4 = 0 then 'error' when s_suppkey % 4 = 1 then 'degraded' when s_suppkey % 4 = 2 then 'degraded' else 'ok' end as status from supplier")
def e27(t):
    k = F.col("s_suppkey") % 4
    return t.supplier.select(F.col("s_suppkey").alias("id"), audit.coverage_status(F.lit(100), F.when(k == 0, 0).when(k == 1, 90).otherwise(100), F.when(k == 2, 1).otherwise(0)).alias("status"))


# ---- documents
_TREE = {"components": {"schemas": {"A": {"type": "object", "required": ["b", "c"], "x-note": 1, "properties": {"b": _REF("B"), "c": {"type": "array", "items": _REF("B")}, "d": {"$ref": "#/none/X", "x-side": True}}}, "B": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "again": _REF("B")}}}}}


@query("f07_richest_reference", "select n_nationkey as id, 'object' as type, 2 as n_properties from nation")
def f07(t):
    def f(spec):
        body = normalise.richest("#/components/schemas/B", {"schemas": {"B": {"type": "object"}}}, spec["components"])
        return [(body["type"], len(body["properties"]))]

    return _each(t, f, "type string, n_properties int", _TREE).select(F.col("spec_id").alias("id"), "type", "n_properties")


@query("f18_reference_sites", "select n_nationkey as id, r.ref, r.via from nation, (values ('B', 'b'), ('B', 'items'), ('X', 'd')) as r(ref, via)")
def f18(t):
    return _each(t, lambda s: [(ref.rpartition("/")[2], via) for ref, via in decompose.references(s["components"]["schemas"]["A"])], "ref string, via string", _TREE).select(F.col("spec_id").alias("id"), "ref", "via")


@query("f20_vendor_extensions", "select n_nationkey as id, 'x-note' as own, 'x-path' as pooled from nation")
def f20(t):
    def f(spec):
        a = spec["components"]["schemas"]["A"]
        full = decompose.vendor({"x-path": "own", **{"x-path": "resolved"}})
        return [(",".join(decompose.vendor(a)), ",".join(full))]

    return _each(t, f, "own string, pooled string", _TREE).select(F.col("spec_id").alias("id"), "own", "pooled")


@query("f31_expanded", "select n_nationkey as id, 'string' as id_type, 1 as circular, '#/none/X' as unknown from nation")
def f31(t):
    def f(spec):
        out = decompose.expand(spec["components"]["schemas"]["A"], spec)
        return [(out["properties"]["b"]["properties"]["id"]["type"], int("$circular_ref" in json.dumps(out)), out["properties"]["d"]["$ref"])]

    return _each(t, f, "id_type string, circular int, unknown string", _TREE).select(F.col("spec_id").alias("id"), "id_type", "circular", "unknown")


@query("f32_required_leaves", "select n_nationkey as id, 'b.id,c[].id' as leaves from nation")
def f32(t):
    f = lambda s: [(",".join(normalise.required_leaves(decompose.expand(s["components"]["schemas"]["A"], s))),)]
    tree = json.loads(json.dumps(_TREE))
    del tree["components"]["schemas"]["B"]["properties"]["again"]
    return _each(t, f, "leaves string", tree).select(F.col("spec_id").alias("id"), "leaves")


@query("g01_cleaned", "select p_partkey as id, '{\"a\":[{\"c\":1}],\"default\":' || case when p_partkey % 2 = 0 then 'true' else 'false' end || ',\"n\":{\"default\":' || p_size || ',\"type\":\"integer\"},\"type\":\"boolean\"}' as text from part")
def g01(t):
    body = _text('{"_id":1,"type":"boolean","default":"', F.when(F.col("p_partkey") % 2 == 0, "True").otherwise("0"), '","n":{"type":"integer","default":"', F.col("p_size"), '"},"a":[{"_b":1,"c":1}]}')
    return jsonops.each_document(t.part.select(F.col("p_partkey").alias("id"), body.alias("b")), "id", "b", lambda x: [(decompose.canonical(decompose.cleaned(x)),)], "text string").select("id", "text")


@query("g08_round_trip", "select n_nationkey as id, true as same from nation")
def g08(t):
    f = lambda s: [(jsonops.rebuild([r for r in jsonops.shred(json.dumps(s))]) == s,)]
    return _each(t, f, "same boolean").select(F.col("spec_id").alias("id"), "same")


@query("g06_unknown_keys", "select p_partkey as id, case when p_partkey % 2 = 0 then '' else '/paths/~1x/colour' end as wrong from part")
def g06(t):
    body = F.when(F.col("p_partkey") % 2 == 0, '{"get": {}, "x-note": 1}').otherwise('{"get": {}, "colour": 1}')
    f = lambda b: [(",".join(semantic.unknown_keys(b, ["get", "put", "parameters"], "/paths/~1x")),)]
    return jsonops.each_document(t.part.select(F.col("p_partkey").alias("id"), body.alias("b")), "id", "b", f, "wrong string").select("id", "wrong")


@query("g14_edge_dedup", _counts("kind", {"HAS_PROPERTY": 11, "COMPOSED_OF": 3}))
def g14(t):
    rows = semantic.overlays(_specs(t))
    nodes = semantic.nodes(rows)
    edges = semantic.edges(rows.unionByName(rows.withColumn("ord", F.col("ord") + 1000)), nodes)  # every edge emitted twice
    return edges.where("kind in ('HAS_PROPERTY', 'COMPOSED_OF')").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("g20_typed_ids", "select n_nationkey as spec_id, p.* from nation, (values ('/components/schemas/Nation', 's:schemas:Nation'), ('/components/schemas/Nation/properties/place', 's:schemas:Nation#prop:place'), ('/components/schemas/Mix/allOf/1', 's:schemas:Mix#allOf:1'), ('/components/schemas/Tag/allOf/0', 's:schemas:Tag#allOf:0'), ('/components/schemas/Mix', 's:schemas:Mix'), ('/components/schemas/Tag', 's:schemas:Tag')) as p(pointer, typed_id)")
def g20(t):
    nodes = _layer(t)[0].where("kind = 'SchemaComponent'").where(F.col("pointer").rlike("/schemas/(Nation|Mix|Tag)(/(properties/place|allOf/[0-9]))?$"))
    return nodes.select("spec_id", "pointer", semantic.typed_id(F.lit("s"), F.col("pointer")).alias("typed_id"))


@query("g22_typed_rows", "select 'ApiEndpoint' as name, 2 * count(*) as n from nation union all select 'Property', 11 * count(*) from nation union all select 'SchemaComponent', 12 * count(*) from nation union all select 'HAS_PROPERTY', 11 * count(*) from nation union all select 'COMPOSED_OF', 3 * count(*) from nation")
def g22(t):
    nodes, edges = _layer(t)
    tables = semantic.typed_tables(nodes, edges, ["ApiEndpoint", "Property", "SchemaComponent"], ["HAS_PROPERTY", "COMPOSED_OF"])
    keys = {k: ["src", "dst", "evidence"] if "src" in df.columns else ["semantic_id"] for k, df in tables.items()}
    return writers.write_tables(tables, shared_folder(t.spark), keys).withColumnRenamed("table", "name")


@query("g29_shared_components", "select n_nationkey as id, 1 as gone, 'Bag,Mix,Nation,Region,Tag' as names from nation")
def g29(t):
    def f(spec):
        gone = export.share_equal(spec)
        return [(gone, ",".join(sorted(spec["components"]["schemas"])))]

    return _each(t, f, "gone int, names string").select(F.col("spec_id").alias("id"), "gone", "names")


@_cases("g31_reconciled", [(2, 1, 0, "ok"), (3, 1, 0, "A: files are unaccounted for"), (2, 2, 0, "A: files are unaccounted for"), (2, 1, 1, "A: not all of it was fetched anew")], ["fetched", "missing", "cached", "said"], "fetched int, missing int, cached int")
def g31(t, df):
    def say(r):
        report = {"name": "A", "fetched_specs": r["fetched"], "missing_specs": r["missing"], "cached_specs": r["cached"], "discovered": r["fetched"] + 1, "failure_reasons": {"no_oas_block": 1}}
        try:
            export.reconciled([report], {"A": 2}, 2)
            return "ok"
        except export.ExportError as e:
            return str(e)

    return df.sparkSession.createDataFrame([(r["id"], say(r)) for r in df.collect()], "id int, said string")


_SCHEMAS = [({"type": ["string", "null"]}, "string|null", "none", "/p"), ({"$ref": "#/a"}, "$ref", "none", "/a"), ({"type": "array", "items": {"$ref": "#/b"}}, "array", "none", "/b"), ({"type": "array", "items": {"type": "string"}}, "array", "none", "/p/items"), ({"oneOf": [{}]}, "", "union", "/p"), ({"additionalProperties": {}}, "", "map", "/p"), ({"properties": {"a": {}}, "type": "object"}, "object", "object", "/p")]


@_cases("g35_type_pointer", [(json.dumps(b), p) for b, _, _, p in _SCHEMAS], ["b", "pointer"], "b string")
def g35(t, df):
    return jsonops.each_document(df, "id", "b", lambda b: [(shapes.type_pointer(b, "/p"),)], "pointer string")


@_cases("g36_types", [(json.dumps(b), k) for b, k, _, _ in _SCHEMAS], ["b", "type"], "b string")
def g36(t, df):
    return jsonops.each_document(df, "id", "b", lambda b: [(shapes.type_text(b),)], "type string")


@_cases("g37_inline_roles", [(json.dumps(b), r) for b, _, r, _ in _SCHEMAS], ["b", "role"], "b string")
def g37(t, df):
    return jsonops.each_document(df, "id", "b", lambda b: [(shapes.inline_role(b),)], "role string")


@_cases("g39_example_data", [('{"p": ["schemas", "A", "example", "x"]}', True), ('{"p": ["properties", "example", "type"]}', False), ('{"p": ["examples", "one", "value", "x"]}', True), ('{"p": ["schemas", "default", "type"]}', False), ('{"p": ["items", "default", "a"]}', True)], ["b", "data"], "b string")
def g39(t, df):
    return jsonops.each_document(df, "id", "b", lambda b: [(shapes.in_example(b["p"]),)], "data boolean")


@_cases("g40_kept_raw", [("Operation", False, '{"a":1}'), ("Info", False, ""), ("Info", True, '{"a":1}'), ("Scalar", False, "")], ["kind", "schema", "raw"], "kind string, is_schema boolean")
def g40(t, df):
    return df.sparkSession.createDataFrame([(r["id"], semantic.kept_raw({"a": 1}, r["kind"], r["is_schema"])) for r in df.collect()], "id int, raw string")


@query("g34_schema_nodes", "select n_nationkey as spec_id, 12 as nodes, 21 as properties_and_parts from nation")
def g34(t):
    f = lambda s: [(sum(n for *_, n in semantic.schema_places(s)), len([1 for *_, n in semantic.schema_places(s) if not n]) + 6)]
    return _each(t, f, "nodes int, properties_and_parts int").select("spec_id", "nodes", "properties_and_parts")


@query("g33_cached_outcome", "select o_orderkey as id, case when o_orderkey % 3 = 0 then 'ok' when o_orderkey % 3 = 1 then 'resolution' end as status from orders")
def g33(t):
    from weftgraph.operators.loaders import with_cached_outcomes

    docs = t.orders.select(F.col("o_orderkey").alias("id"), _text('{ "id": ', F.col("o_orderkey"), "}").alias("body"))
    k = F.col("o_orderkey") % 3
    cache = t.orders.where(k < 2).select(jsonops.content_hash(_text('{"id":', F.col("o_orderkey"), "}")).alias("digest"), F.when(k == 0, "ok").otherwise("resolution").alias("status"))
    return with_cached_outcomes(docs, "body", cache)[0].select("id", "status")


@query("f38_parameter_override", "select n_nationkey as id, 'limit:string,ids:string' as parameters from nation")
def f38(t):
    def f(spec):
        item = next(iter(spec["paths"].values()))
        return [(",".join(f"{p['name']}:{p['schema']['type']}" for p in export.merged_parameters(spec, item, item["get"])),)]

    return _each(t, f, "parameters string").select(F.col("spec_id").alias("id"), "parameters")


# ---- responses and search
@query("h08_path_templates", "select o_orderkey as id, '/c/' || o_custkey || '/o/' || o_orderkey || '/{rest}' as path from orders")
def h08(t):
    given = F.create_map(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("order"), F.col("o_orderkey").cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("id"), scalar.fill_path(F.lit("/c/{cust}/o/{order}/{rest}"), given).alias("path"))


@_cases("h13_value_kinds", [("null", "null"), ("true", "boolean"), ("-1.5", "number"), ('"x"', "string"), ("[1]", "array"), (' {"a": 1}', "object")], ["x", "kind"], "x string")
def h13(t, df):
    return df.withColumn("kind", jsonops.value_kind(F.col("x")))


@_cases("h15_identity", [('{"ID": 1, "name": ""}', "ID=1"), ('{"serial": null, "Serial": "x"}', "Serial=x"), ('{"uuid": "u", "mac": false}', "uuid=u,mac=False"), ("[1]", None), ("{}", "")], ["x", "found"], "x string")
def h15(t, df):
    return df.withColumn("found", F.array_join(F.transform(hydrate.identity(F.col("x")), lambda m: F.concat_ws("=", m["key"], m["text"])), ","))


@_cases("h17_entity_types", [("s:schemas:Device#x", "GET:/v1/a", "Device"), (None, "GET:/v1/devices/", "devices"), ("", "", "RuntimeObject"), ("s:schemas:", "GET:/a/b", "b")], ["s", "e", "type"], "s string, e string")
def h17(t, df):
    return df.withColumn("type", hydrate.entity_type(F.col("s"), F.col("e")))


@_cases("h20_confidence", [("id", 1, "high"), ("macAddress", 1, "high"), ("siteId", 1, "medium"), ("uid", 1, "low"), ("uid", 2, "medium"), ("Serial", 1, "low")], ["f", "n", "sure"], "f string, n int")
def h20(t, df):
    return df.withColumn("sure", hydrate.confidence(F.col("f"), F.col("n")))


@_cases("h03_paging_styles", [("limit,offset", "offset"), ("limit,next", "cursor"), ("cursor", "cursor"), ("limit", "bounded_list"), ("next", "none_detected"), ("", "none_detected")], ["x", "style"], "x string")
def h03(t, df):
    return df.withColumn("style", hydrate.paging_style(F.split("x", ","))["style"])


@_cases("h04_identity_hints", [("name,serial,zone", "serial,name,zone:high"), ("other", "other:medium"), ("scopeId,name", "scopeId,name:medium"), ("", ":low")], ["x", "hints"], "x string")
def h04(t, df):
    got = hydrate.identity_hints(F.filter(F.split("x", ","), lambda n: n != ""))
    return df.withColumn("hints", F.concat_ws(":", F.array_join(got["fields"], ","), got["confidence"]))


@query("h05_preferred_root", "select l_partkey as id, arg_min(l_suppkey, (l_returnflag = 'A', l_returnflag, 'c' || l_suppkey)) as root from lineitem where l_linestatus = 'F' group by 1")
def h05(t):
    status = F.when(F.col("l_returnflag") == "A", "404").otherwise(F.when(F.col("l_returnflag") == "N", "200").otherwise("201"))
    rows = t.lineitem.select(F.col("l_partkey").alias("endpoint_id"), status.alias("status"), F.lit("j").alias("content_type"), F.when(F.col("l_linestatus") == "F", _text("c", F.col("l_suppkey"))).alias("component_id"), F.lit("").alias("body_shape"), F.lit("").alias("schema_type"))
    return hydrate.preferred_root(rows).select(F.col("endpoint_id").alias("id"), F.substring("root.component_id", 2, 20).cast("long").alias("root"))


@query("i01_index_terms", "select term, count(*) as df, sum(n)::bigint as tf from (select page_id, term, count(*) as n from (select page_id, unnest(regexp_extract_all(lower(url), '[a-z0-9]+')) as term from pages) group by 1, 2) group by 1")
def i01(t):
    index = search.build(t.pages, "page_id", "url")
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _html(t):
    key = F.col("p_partkey")
    page = _text('<html><head><title>t</title><style>p{}</style><script>var a = "<p>";</script></head><body><nav>menu</nav><div id="main-content"><h1>Part ', key, "</h1><p>It &amp; <b>more</b>   of it.</p><script>x()</script><h2 id=\"use\">Use</h2><ul><li>one</li></ul></div><footer>end</footer></body></html>")
    return t.part.select(key.alias("page_id"), _text("http://x/p", key).alias("url"), page.alias("html"))


@query("i09_main_content", "select p_partkey as id, false as menu, false as script, true as body from part")
def i09(t):
    text = F.col("text")
    return pages.page_text(_html(t)).select(F.col("page_id").alias("id"), text.contains("menu").alias("menu"), (text.contains("var a") | text.contains("x()")).alias("script"), text.contains("It & more of it.").alias("body"))


@query("i11_headings", "select p_partkey as id, s.section_id, case when s.section_id = 'use' then 'Use' else 'Part ' || p_partkey end as title from part, (values ('part'), ('use')) as s(section_id)")
def i11(t):
    got = pages.page_sections(_html(t))
    return got.select(F.col("page_id").alias("id"), F.regexp_extract("section_id", "#([a-z]+)", 1).alias("section_id"), "title")


@query("i26_job_order", "select * from (values (0, 'b'), (1, 'd'), (2, 'c'), (3, 'a')) as x(place, job)")
def i26(t):
    jobs = t.spark.createDataFrame([(x,) for x in "abcd"], "job string")
    order = topology.levels(jobs, t.spark.createDataFrame([("a", "c"), ("c", "b")], "job string, needs string"))
    return t.spark.createDataFrame(list(enumerate(order)), "place int, job string")


