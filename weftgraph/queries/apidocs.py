"""API documents (C20-C28, E06-E21, F, G): one made for each nation, so that what is in all of them is known."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftgraph.functions import jsonops
from weftgraph.operators import audit, context, decompose, export, normalise, semantic, shapes
from weftgraph.queries import query

_REF = lambda name: {"$ref": f"#/components/schemas/{name}"}
_JSON = lambda schema: {"application/json": {"schema": schema}}
_MISSING = {"description": "no such nation", "content": {"text/plain": {}}}
_ID = {"type": "object", "properties": {"id": {"type": "string", "x-path": "/m:r/id"}}}
_PLACE = {"type": "object", "title": "Place", "properties": {"lat": {"type": "number"}, "lon": {"type": "number"}, "alt": {"type": "number"}}}
#: One document; @K@ is a nation's key.
SPEC = {
    "openapi": "3.0.1", "info": {"title": "nation @K@"},
    "components": {"schemas": {
        "Nation": {
            "type": "object", "required": ["name", "region"], "x-supportedDeviceType": ["switch"], "description": "Either `name` or `code` is set.",
            "properties": {
                "name": {"type": "string", "minLength": 1, "x-path": "/m:n/name", "format": "const", "maxLength": 9999}, "code": {"type": "integer", "default": "7", "nullable": True},
                "region": _REF("Region"), "tags": {"type": "array", "items": _REF("Tag")}, "place": _PLACE,
            },
        },
        "Region": _ID, "Tag": {"type": "string", "enum": ["a", "b"], "allOf": [{"type": "string"}]},
        "Mix": {"allOf": [_REF("Nation"), {"type": "object", "properties": {"extra": {"type": "string"}}}]}, "Bag": {"additionalProperties": _REF("Tag")}, "Twin": _ID,
    }},
    "paths": {"/n/@K@": {
        "parameters": [{"name": "limit", "in": "query", "schema": {"type": "integer"}}],
        "get": {
            "operationId": "get@K@", "description": "Reads it.", "parameters": [{"name": "limit", "in": "query", "description": "how many", "schema": {"type": "string"}}, {"name": "ids", "in": "query", "schema": {"type": "string"}}],
            "responses": {"404": _MISSING, "200": {"description": "ok", "content": _JSON(_REF("Nation"))}},
        },
        "put": {"operationId": "put@K@", "requestBody": {"content": _JSON(_REF("Mix"))}, "responses": {"204": {"description": "done"}, "404": _MISSING}, "x-cliParam": {"commandName": "set", "paramKeys": ["a", {"key": "b"}]}},
    }},
}


def _specs(t, spec: dict = SPEC):
    key = F.col("n_nationkey").cast("string")
    return t.nation.select(F.col("n_nationkey").cast("long").alias("spec_id"), F.col("n_regionkey").cast("long").alias("region"), F.replace(F.lit(json.dumps(spec)), F.lit("@K@"), key).alias("spec"))


def _each(t, f, schema: str, spec: dict = SPEC):
    return jsonops.each_document(_specs(t, spec), "spec_id", "spec", f, schema)


def _counts(name: str, of: dict[str, int]) -> str:
    return " union all ".join(f"select '{k}' as {name}, {n} * count(*) as n from nation" for k, n in of.items())


def _by(df, name: str):
    return df.groupBy(F.col("kind").alias(name)).agg(F.count(F.lit(1)).alias("n"))


# ---- the semantic layer
@query("g10_semantic_nodes", _counts("kind", {"SchemaComponent": 12, "Property": 11, "ApiEndpoint": 2, "RequestBody": 1, "Response": 4, "YangPath": 2, "CliCommand": 1}))
def g10(t):
    return _by(semantic.nodes(semantic.overlays(_specs(t))), "kind")


def _layer(t):
    rows = semantic.overlays(_specs(t))
    nodes = semantic.nodes(rows)
    return nodes, semantic.edges(rows, nodes)


@query("g11_semantic_edges", _counts("kind", {"HAS_PROPERTY": 11, "PROPERTY_OF_TYPE": 3, "HAS_ITEM_SCHEMA": 1, "PROPERTY_AT_YANG": 3, "COMPOSED_OF": 3, "HAS_VALUE_SCHEMA": 1, "HAS_REQUEST_BODY": 1, "BODY_REFERENCES": 1, "ACCEPTS_SCHEMA": 1, "HAS_RESPONSE": 4, "RESPONSE_REFERENCES": 1, "RETURNS_SCHEMA": 1, "CONFIGURES_YANG": 2, "HAS_CLI_COMMAND": 1}))
def g11(t):
    return _by(_layer(t)[1], "kind")


def _models(nodes, edges):
    at = edges.where("kind = 'PROPERTY_AT_YANG'").select(F.col("src").alias("semantic_id"), F.col("dst").alias("yang_id"))
    own = nodes.where("kind in ('SchemaComponent', 'Property')").join(at, "semantic_id", "left")
    return own.select("semantic_id", F.coalesce(F.col("yang_id"), F.concat_ws("|", "spec_id", "stable_key")).alias("model_id"), "yang_id")


@query("g17_model_shortcuts", _counts("kind", {"ACCEPTS_MODEL": 1, "RETURNS_MODEL": 1, "BODY_MODEL": 1, "RESPONSE_MODEL": 1, "MODEL_OF_TYPE": 3, "MODEL_HAS_ITEM_SCHEMA": 1, "MODEL_COMPOSED_OF": 3, "MODEL_HAS_VALUE_SCHEMA": 1, "CONFIGURES_MODEL": 2}))
def g17(t):
    nodes, edges = _layer(t)
    return _by(semantic.shortcuts(edges, _models(nodes, edges)), "kind")


@query("g13_media_bodies", "select n_nationkey as spec_id, b.kind, b.status, b.media, b.typed from nation, (values ('RequestBody', '', 'application/json', 1), ('Response', '200', 'application/json', 1), ('Response', '404', 'text/plain', 0), ('Response', '204', '', 0), ('Response', '404', 'text/plain', 0)) as b(kind, status, media, typed)")
def g13(t):
    nodes, edges = _layer(t)
    told = edges.where("kind in ('BODY_REFERENCES', 'RESPONSE_REFERENCES')").groupBy(F.col("src").alias("semantic_id")).agg(F.count(F.lit(1)).cast("int").alias("typed"))
    bodies = nodes.where("kind in ('RequestBody', 'Response')").join(told, "semantic_id", "left")
    say = lambda k: F.get_json_object("summary", f"$.{k}")
    return bodies.select("spec_id", "kind", say("status").alias("status"), say("contentType").alias("media"), F.coalesce("typed", F.lit(0)).alias("typed"))


@query("g18_value_paths", "select n_nationkey as id, '/m:n/name,/m:r/id' as paths from nation")
def g18(t):
    rows = _each(t, lambda s: [(",".join(sorted(semantic.value_paths(s, s["components"]["schemas"]["Mix"]))),)], "paths string")
    return rows.select(F.col("spec_id").alias("id"), "paths")


@query("g38_derived_from", _counts("kind", {"SchemaComponent": 12, "Property": 11, "ApiEndpoint": 2, "RequestBody": 1, "Response": 4, "YangPath": 2, "CliCommand": 1}))
def g38(t):
    specs = _specs(t)
    ast = jsonops.shred_table(specs, "spec_id", "spec").select(F.col("id").alias("spec_id"), "pointer", F.concat_ws("#", "id", "pointer").alias("ast_id"))
    nodes = semantic.nodes(semantic.overlays(specs))
    return _by(semantic.derived_from(nodes, ast).join(nodes, "semantic_id"), "kind")


@query("g07_linked_references", "select n_nationkey as spec_id, 6 as n, 4 as targets from nation")
def g07(t):
    ast = jsonops.shred_table(_specs(t), "spec_id", "spec").withColumnRenamed("id", "spec_id")
    return semantic.linked_references(ast).groupBy("spec_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_distinct("target").cast("int").alias("targets"))


@query("c22_nearest_schema", "select n_nationkey as spec_id, p.pointer, p.schema from nation, (values ('/components/schemas/Nation/properties/place/properties/lat', '/components/schemas/Nation/properties/place'), ('/components/schemas/Mix/allOf/1/properties/extra', '/components/schemas/Mix/allOf/1'), ('/components/schemas/Nation/properties/code', '/components/schemas/Nation')) as p(pointer, schema)")
def c22(t):
    nodes = semantic.nodes(semantic.overlays(_specs(t)))
    some = nodes.where("kind = 'Property' and name in ('lat', 'extra', 'code')")
    return semantic.nearest_schema(some, nodes.where("kind = 'SchemaComponent'")).select("spec_id", "pointer", "schema")


@query("c21_parents", "select event_id as spec_id, '/k' as child, '' as parent from events")
def c21(t):
    return semantic.parents(jsonops.shred_table(t.events, "event_id", "props").withColumnRenamed("id", "spec_id")).select("spec_id", "child", "parent")


@query("c20_typed_edges", "select 'c' || o_custkey as src, 's' || l_suppkey as dst, 'BOUGHT' as kind from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where o_custkey % 3 > 0 and s_nationkey < 20")
def c20(t):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(name("x", "o_custkey").alias("src"), name("y", "l_suppkey").alias("dst"), F.lit("BOUGHT").alias("kind"))
    customers = t.customer.where("c_custkey % 3 > 0").select(name("x", "c_custkey").alias("semantic_id"), name("c", "c_custkey").alias("typed_id"))
    suppliers = t.supplier.where("s_nationkey < 20").select(name("y", "s_suppkey").alias("semantic_id"), name("s", "s_suppkey").alias("typed_id"))
    return semantic.typed_edges(edges, customers.unionByName(suppliers))


# ---- classifiers
_BODIES = [
    ({"enum": ["a"], "allOf": [{}]}, "primitive", "primitive"), ({"oneOf": [{}]}, "union-oneOf", "union"), ({"anyOf": [{}], "properties": {"a": {}}}, "union-anyOf", "union"),
    ({"allOf": [{}], "enum": []}, "allOf-composite", "union"), ({"properties": {"a": {}}}, "object", "object"), ({"additionalProperties": True}, "map", "primitive"),
    ({"additionalProperties": {}, "type": "object"}, "map", "object"), ({"type": "object"}, "object", "object"), ({"type": "array", "items": {}}, "array", "array"), ({"type": "string"}, "primitive", "primitive"), ({"additionalProperties": False}, "primitive", "primitive"), ({"properties": {}}, "primitive", "object"),
]


def _pick(values: list[str], key: str) -> str:
    return "case " + key + " ".join([""] + [f"when {i} then '{v}'" for i, v in enumerate(values)]) + " end"


@query("f23_body_shape", f"select p_partkey as id, {_pick([b[1] for b in _BODIES], f'p_partkey % {len(_BODIES)}')} as shape, {_pick([b[2] for b in _BODIES], f'p_partkey % {len(_BODIES)}')} as kind from part")
def f23(t):
    texts = F.array(*[F.lit(json.dumps(b[0])) for b in _BODIES])
    rows = t.part.select(F.col("p_partkey").alias("id"), texts[(F.col("p_partkey") % len(_BODIES)).cast("int")].alias("body"))
    return jsonops.each_document(rows, "id", "body", lambda b: [(shapes.body_shape(b), shapes.component_kind(b))], "shape string, kind string").select("id", "shape", "kind")


_PARAMETERS = [("since", "date-time", "string", "rfc3339-date-time"), ("$filter", "", "string", "odata-filter"), ("order_by", "", "string", "odata-orderby"), ("siteIds", "", "string", "comma-list"), ("siteIds", "", "array", ""), ("page_size", "", "integer", "pagination"), ("name", "", "string", ""), ("myOdataX", "", "string", "odata-filter")]


@query("f16_parameter_hint", f"select p_partkey as id, {_pick([p[3] for p in _PARAMETERS], f'p_partkey % {len(_PARAMETERS)}')} as hint from part")
def f16(t):
    texts = F.array(*[F.lit(json.dumps({"name": n, "schema": {"format": f, "type": k}})) for n, f, k, _ in _PARAMETERS])
    rows = t.part.select(F.col("p_partkey").alias("id"), texts[(F.col("p_partkey") % len(_PARAMETERS)).cast("int")].alias("body"))
    return jsonops.each_document(rows, "id", "body", lambda p: [(shapes.parameter_hint(p),)], "hint string").select("id", "hint")


@query("g21_constraints", "select p_partkey as id, '{\"maximum\":' || p_size || ',\"nullable\":true,\"required\":[\"a\"],\"x-key\":[\"k\"]}' as kept from part")
def g21(t):
    body = F.concat(F.lit('{"type":"object","required":["a"],"x-key":["k"],"x-other":1,"nullable":true,"maximum":'), F.col("p_size").cast("string"), F.lit("}"))
    rows = t.part.select(F.col("p_partkey").alias("id"), body.alias("body"))
    return jsonops.each_document(rows, "id", "body", lambda b: [(decompose.canonical(shapes.constraints(b)),)], "kept string").select("id", "kept")


@query("f25_device_types", "select p_partkey as id, case p_partkey % 4 when 0 then 'a|b' when 1 then 'one' when 2 then '' end as types from part")
def f25(t):
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, '{"x-supportedDeviceType": ["a", "b"]}').when(k == 1, '{"x-supportedDeviceType": "one"}').when(k == 2, '{"x-supportedDeviceType": []}').otherwise("{}")
    lift = lambda b: [(None if (own := shapes.device_types(b)) is None else "|".join(own),)]
    return jsonops.each_document(t.part.select(F.col("p_partkey").alias("id"), body.alias("body")), "id", "body", lift, "types string").select("id", "types")


@query("f27_cli_commands", "select n_nationkey as id, 'set' as command, 'a,b' as keys from nation")
def f27(t):
    nodes = semantic.nodes(semantic.overlays(_specs(t))).where("kind = 'CliCommand'")
    keys = F.array_join(F.from_json(F.get_json_object("summary", "$.paramKeys"), "array<string>"), ",")
    return nodes.select(F.col("spec_id").alias("id"), F.col("name").alias("command"), keys.alias("keys"))


# ---- normalisation and projections
_NORM = {**SPEC, "paths": {"/n/@K@": {**SPEC["paths"]["/n/@K@"], "post": {"requestBody": {"content": _JSON({"type": "object", "required": ["at"], "properties": {"at": _PLACE, "to": _PLACE, "n": {"type": "object", "required": ["z"], "properties": {"z": {}}}}})}, "responses": {"201": {"description": "made"}}}}}}


def _normal(spec: dict) -> list[tuple]:
    out = normalise.normalised(spec)
    shelf = out["components"]
    name = shelf["schemas"]["Nation"]["properties"]["name"]
    return [(",".join(sorted(k.split("_")[0] for k in shelf["responses"])), len(shelf["schemas"]), ",".join(sorted(k.split("_")[0] for k in shelf["schemas"] if "_" in k)), ",".join(sorted(name)), ",".join(shelf["schemas"]["Nation"]["x-mutually-exclusive"]), int(normalise.normalised(out) == out))]


@query("f01_normalised", "select n_nationkey as id, 'Error404' as errors, 7 as n_schemas, 'Place' as shared, 'minLength,type,x-path' as name_keys, 'name,code' as exclusive, 1 as again from nation")
def f01(t):
    return _each(t, _normal, "errors string, n_schemas int, shared string, name_keys string, exclusive string, again int", _NORM).select(F.col("spec_id").alias("id"), "errors", "n_schemas", "shared", "name_keys", "exclusive", "again")


def _skeleton(spec: dict) -> list[tuple]:
    path = next(iter(spec["paths"]))
    get, post = normalise.skeleton(spec, "GET", path), normalise.skeleton(spec, "post", path)
    assert normalise.skeleton(spec, "delete", path) is None
    return [(get["success"]["status"], ",".join(sorted(get["components_index"]["schemas"])), ",".join(get["components_index"]["schemas"]["Nation"]["child_refs"]).replace("#/components/schemas/", ""), ",".join(post["required_paths"]), int("description" in json.dumps(get["parameters"])))]


@query("f28_skeleton", "select n_nationkey as id, '200' as answer, 'Nation,Region,Tag' as needed, 'Region,Tag' as children, 'at,n.z' as required_paths, 0 as prose from nation")
def f28(t):
    return _each(t, _skeleton, "answer string, needed string, children string, required_paths string, prose int", _NORM).select(F.col("spec_id").alias("id"), "answer", "needed", "children", "required_paths", "prose")


def _glossary(spec: dict) -> list[tuple]:
    g = normalise.glossary(spec, "get", next(iter(spec["paths"])))
    return [(g["description"], ",".join(f"{k}:{v['in']}:{v['description']}" for k, v in g["parameters"].items()), ",".join(sorted(g["components"])), g["components"]["Nation"]["properties"]["place"]["title"])]


@query("f29_glossary", "select n_nationkey as id, 'Reads it.' as said, 'limit:query:how many' as parameters, 'Nation' as components, 'Place' as title from nation")
def f29(t):
    return _each(t, _glossary, "said string, parameters string, components string, title string").select(F.col("spec_id").alias("id"), "said", "parameters", "components", "title")


def _side(spec: dict) -> list[tuple]:
    out = normalise.components(spec, "put", next(iter(spec["paths"])))
    return [(",".join(sorted(out["components"]["schemas"])), ",".join(f"{k}={'+'.join(sorted(v))}" for k, v in sorted(out["index"]["schemas"].items())))]


@query("f30_components", "select n_nationkey as id, 'Mix,Nation,Region,Tag' as names, 'Mix=allOf+child_refs,Nation=child_refs+required+type,Region=type,Tag=allOf+enum+type' as brief from nation")
def f30(t):
    return _each(t, _side, "names string, brief string").select(F.col("spec_id").alias("id"), "names", "brief")


@query("f33_responses", "select o_orderkey as id, case o_orderkey % 4 when 0 then '200' when 1 then '204' when 2 then '206' else '' end as success, case o_orderkey % 4 when 1 then '404:#/r/a' when 3 then '5XX:#/r/b' else '' end as error from orders")
def f33(t):
    k = F.col("o_orderkey") % 4
    body = F.when(k == 0, '{"204": {}, "200": {}, "404": {}}').when(k == 1, '{"404": {"$ref": "#/r/a"}, "204": {}, "500": {"$ref": "#/r/c"}}').when(k == 2, '{"404": {}, "206": {}}').otherwise('{"5XX": {"$ref": "#/r/b"}}')
    say = lambda r: [(normalise.success_response(r)[0], ":".join(e.values()) if (e := normalise.first_error(r)) else "")]
    return jsonops.each_document(t.orders.select(F.col("o_orderkey").alias("id"), body.alias("b")), "id", "b", say, "success string, error string").select("id", "success", "error")


@query("f34_blob_decode", "select c_custkey as id, c_name as text from customer")
def f34(t):
    stored = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("b64:"), F.base64(F.encode("c_name", "UTF-8")))).otherwise(F.col("c_name"))
    return t.customer.select(F.col("c_custkey").alias("id"), jsonops.decode_blob(stored).alias("text"))


def _parsed(spec: dict) -> list[tuple]:
    op = normalise.parse_operation(spec, next(iter(spec["paths"])), "get")
    nation = op["responses"]["200"]
    return [(op["operationId"], len(op["parameters"]), nation["properties"]["region"]["properties"]["id"]["type"], ",".join(sorted(op["responses"])))]


@query("f35_operations", "select n_nationkey as id, 'get' || n_nationkey as op, 2 as n_parameters, 'string' as region_id, '200,404' as statuses from nation")
def f35(t):
    return _each(t, _parsed, "op string, n_parameters int, region_id string, statuses string").select(F.col("spec_id").alias("id"), "op", "n_parameters", "region_id", "statuses")


@query("f36_property_schema", "select n_nationkey as id, 'object' as own, 'string' as pooled, 'x' as said, 0 as unknown from nation")
def f36(t):
    def f(spec):
        shelf, pool = spec["components"], {"schemas": {"Region": {}, "Pooled": {"type": "string"}}}
        return [(normalise.property_schema(_REF("Region"), shelf, pool)["type"], normalise.property_schema(_REF("Pooled"), shelf, pool)["type"], normalise.property_schema({**_REF("Region"), "description": "x"}, shelf)["description"], int("type" in normalise.property_schema(_REF("None"), shelf)))]

    return _each(t, f, "own string, pooled string, said string, unknown int").select(F.col("spec_id").alias("id"), "own", "pooled", "said", "unknown")


@query("g32_outcomes", "select c_custkey as id, case c_custkey % 4 when 0 then 'ok' when 1 then 'validation' when 2 then 'resolution' else 'validation' end as status from customer")
def g32(t):
    k = F.col("c_custkey") % 4
    good, bad = json.dumps({**SPEC, "openapi": "3.1.0"}), json.dumps({"openapi": "3.1.0", "paths": {"/x": {"get": {"responses": {"200": {"$ref": "#/components/responses/None"}}}}}})
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.when(k == 0, good).when(k == 1, '{"a": 1, "a": 2}').when(k == 2, bad).otherwise("[1]").alias("spec"))
    return jsonops.each_document(rows, "id", "spec", lambda s: [(export.check_references(s),)], "n int").select("id", "status")


# ---- export
@query("g25_typed_walk", _counts("kind", {"root": 1, "components": 1, "pathItem": 1, "operation": 2, "parameter": 3, "requestBody": 1, "response": 4, "media": 4, "schema": 27}))
def g25(t):
    return _by(_each(t, lambda s: [(kind,) for _, kind, _ in export.walk(s)], "kind string"), "kind")


@query("g26_references", "select n_nationkey as id, 6 as n from nation")
def g26(t):
    return _each(t, lambda s: [(export.check_references(s),)], "n int").select(F.col("spec_id").alias("id"), "n")


@query("g27_corrections", _counts("rule", {"default_type": 1, "oas30_nullable": 1, "openapi_version": 1}))
def g27(t):
    rows = _each(t, lambda s: [(c["rule"], c["pointer"]) for c in export.corrected(s, "x")[1]], "kind string, pointer string")
    return _by(rows, "rule")


def _exports(t):
    """One merged document for each region of its nations' documents."""

    def work(frame):
        import pandas as pd

        own = [(f"area/{i}.json", f"{i}", export.corrected(json.loads(s), str(i))[0]) for i, s in sorted(zip(frame["spec_id"], frame["spec"], strict=True))]
        out = export.merge(own, "all")
        return pd.DataFrame([(int(frame["region"].iloc[0]), len(export.operation_keys(out)), sum(map(len, out["components"].values())), export.check_references(out), len(out["info"]["version"]))], columns=["region", "operations", "components", "refs", "version"])

    return _specs(t).groupBy("region").applyInPandas(work, "region long, operations int, components int, refs int, version int")


@query("g28_merged_export", "select n_regionkey as region, (2 * count(*))::int as operations, 5 as components, (4 + 2 * count(*))::int as refs, 16 as version from nation group by 1")
def g28(t):
    return _exports(t)


@query("g30_stable_operations", "select c_custkey as id, case when c_custkey % 3 = 0 then '/api/v1/x' else '/api/v1/x,/api/v1alpha1/x' end as paths from customer")
def g30(t):
    alpha = {"operationId": "a", "deprecated": True, "description": "Use `/api/v1/x` instead.", "servers": [], "x-source-document": {"file": "m/a.json"}}
    stable = {"operationId": "b", "servers": [], "x-source-document": {"file": "m/b.json"}}
    doc = lambda op: json.dumps({"paths": {"/api/v1alpha1/x": {"get": op}, "/api/v1/x": {"get": stable}}})
    k = F.col("c_custkey") % 3
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.when(k == 0, doc(alpha)).when(k == 1, doc({**alpha, "deprecated": False})).otherwise(doc({**alpha, "description": "gone"})).alias("spec"))

    def f(spec):
        export.prefer_stable(spec)
        return [(",".join(sorted(spec["paths"])),)]

    return jsonops.each_document(rows, "id", "spec", f, "paths string").select("id", "paths")


# ---- contexts and invariants over the layer
def _end(edges, kind: str, nodes, src: str, dst: str):
    name = nodes.select(F.col("semantic_id").alias("dst"), F.col("name").alias("dst_name"), F.col("stable_key").alias("dst_key"), F.col("summary").alias("dst_summary"))
    return edges.where(F.col("kind") == kind).join(name, "dst").select(F.col("src").alias(src), F.col("dst").alias(f"{dst}_id"), "dst_name", "dst_key", "dst_summary")


def _contexts(t):
    nodes, edges = _layer(t)
    say = lambda k: F.get_json_object("dst_summary", f"$.{k}")
    endpoints = nodes.where("kind = 'ApiEndpoint'").select(F.col("semantic_id").alias("endpoint_id"), "spec_id", F.get_json_object("summary", "$.method").alias("method"))
    parameters = _each(t, lambda s: [(m.upper(), p["name"], p["in"]) for path, item in s["paths"].items() for m in ("get", "put") for p in export.merged_parameters(s, item, item[m])], "method string, name string, location string")
    parameters = parameters.join(endpoints, ["spec_id", "method"]).withColumn("component_id", F.lit(None).cast("string"))
    target = lambda kind: _end(edges, kind, nodes, "body_id", "c").select("body_id", F.col("dst_key").alias("component_id"))
    bodies = _end(edges, "HAS_REQUEST_BODY", nodes, "endpoint_id", "body").withColumn("content_type", say("contentType")).join(target("BODY_REFERENCES"), "body_id", "left")
    answers = _end(edges, "HAS_RESPONSE", nodes, "endpoint_id", "body").withColumns({"content_type": say("contentType"), "status": say("status")}).join(target("RESPONSE_REFERENCES"), "body_id", "left")
    values = _end(edges, "CONFIGURES_YANG", nodes, "endpoint_id", "y").withColumnRenamed("dst_name", "yang_path")
    commands = _end(edges, "HAS_CLI_COMMAND", nodes, "endpoint_id", "y").withColumnRenamed("dst_name", "command_name")
    return context.endpoint_contexts(endpoints, parameters, bodies, answers, values, commands)


@query("c24_endpoint_context", "select n_nationkey as id, m.* from nation, (values ('GET', 'ids,limit', '', '200:schema:/components/schemas/Nation,404:', '', ''), ('PUT', 'limit', 'schema:/components/schemas/Mix', '204:,404:', '/m:n/name,/m:r/id', 'set')) as m(method, parameters, bodies, responses, value_paths, commands)")
def c24_context(t):
    join = lambda c, f: F.array_join(F.transform(c, f), ",")
    return _contexts(t).select(
        F.col("spec_id").alias("id"), "method", join("parameters", lambda x: x["name"]).alias("parameters"), join("request_bodies", lambda x: x["component_id"]).alias("bodies"),
        join("responses", lambda x: F.concat(x["status"], F.lit(":"), F.coalesce(x["component_id"], F.lit("")))).alias("responses"), join("value_paths", lambda x: x["yang_path"]).alias("value_paths"), join("cli_commands", lambda x: x["command_name"]).alias("commands"),
    )


@query("e35_context_metrics", "select 2 * count(*) as endpoints, 2 * count(*) as with_parameters, count(*) as with_request_bodies, 2 * count(*) as with_responses, count(*) as with_value_paths, count(*) as with_cli_commands, 0 as with_typed_parameters, count(*) as with_typed_request_bodies, count(*) as with_typed_responses from nation")
def e35_context(t):
    return context.endpoint_metrics(_contexts(t))


@query("e30_traversal_report", "select 20::bigint as endpoints, 1.0::double as ok_ratio from nation limit 1")
def e30(t):
    contexts = _contexts(t).withColumn("key", F.format_string("%04d%s", "spec_id", "method"))
    return context.traversal_report(contexts, "key", 20, context.endpoint_metrics).select("endpoints", "ok_ratio")


def _schema_contexts(t):
    nodes, edges = _layer(t)
    components = nodes.where("kind = 'SchemaComponent'").select(F.col("semantic_id").alias("component_id"), "spec_id", F.col("stable_key"))
    own = _end(edges, "HAS_PROPERTY", nodes, "component_id", "p").withColumnsRenamed({"dst_name": "name"})
    kind_of = _end(edges, "PROPERTY_OF_TYPE", nodes, "p_id", "c").select("p_id", F.col("dst_name").alias("type_component_id"))
    item_of = _end(edges, "HAS_ITEM_SCHEMA", nodes, "p_id", "c").select("p_id", F.col("dst_name").alias("item_component_id"))
    properties = own.join(kind_of, "p_id", "left").join(item_of, "p_id", "left")
    to = lambda kind: _end(edges, kind, nodes, "component_id", "c").select("component_id", F.lit("").alias("kind"), F.lit("").alias("via"), F.col("dst_key").alias("target_component_id"))
    return context.schema_contexts(components, properties, to("COMPOSED_OF"), to("HAS_VALUE_SCHEMA"), to("REFERENCES"))


@query("c25_schema_context", "select n_nationkey as id, m.* from nation, (values ('schema:/components/schemas/Nation', 'code::,name::,place:place:,region:Region:,tags:Tag:Tag', '', ''), ('schema:/components/schemas/Mix', '', 'schema:/components/schemas/Mix/allOf/1,schema:/components/schemas/Nation', ''), ('schema:/components/schemas/Bag', '', '', 'schema:/components/schemas/Tag')) as m(component, properties, composition, value_schemas)")
def c25(t):
    rows = _schema_contexts(t).where(F.col("stable_key").rlike("/(Nation|Mix|Bag)$"))
    join = lambda c, f: F.array_join(F.transform(c, f), ",")
    text = lambda x: F.coalesce(x, F.lit(""))
    return rows.select(F.col("spec_id").alias("id"), F.col("stable_key").alias("component"), join("properties", lambda x: F.concat_ws(":", x["name"], text(x["type_component_id"]), text(x["item_component_id"]))).alias("properties"), join("composition", lambda x: x["target_component_id"]).alias("composition"), join("value_schemas", lambda x: x["target_component_id"]).alias("value_schemas"))


_INVARIANTS = {"INV-1": "p_partkey % 5 = 0", "INV-2": "p_partkey % 5 = 1", "INV-6": "p_partkey % 5 = 0 or p_partkey % 5 = 3", "INV-7": "p_partkey % 5 = 1"}


def _components(t):
    """Components of five kinds: without edges; contradictory; whole; without properties' edges but composed; inline."""
    k = F.col("p_partkey") % 5
    key = F.concat(F.lit("s:schemas:P"), F.col("p_partkey").cast("string"), F.when(k == 4, "#prop:x").otherwise(""))
    return t.part.select(key.alias("component_id"), F.when(k == 1, "primitive").otherwise("object").alias("kind"), F.lit("object").alias("body_shape"), F.lit('{"properties":{"a":{}}}').alias("body"), k.alias("k"))


@query("e06_document_invariants", " union all ".join(f"select '{name}' as invariant, least(count(*), {25 if name == 'INV-1' else 10**9})::bigint as n from part where {cond}" for name, cond in _INVARIANTS.items()))
def e06(t):
    c = _components(t)
    edge = lambda *ks: c.where(F.col("k").isin(*ks)).select(F.col("component_id").alias("src"))
    has, composed, none = edge(1, 2), edge(3), edge(9)
    checks = {"INV-1": audit.undecomposed(c, has, composed, none), "INV-2": audit.primitive_with_parts(c), "INV-6": audit.objects_without_fields(c, has), "INV-7": audit.contradictions(c)}
    return audit.report({k: (v, F.col("component_id")) for k, v in checks.items()}).select("invariant", "n")


@query("e15_one_matching_edge", "select o_orderkey as id, count(l_linenumber) filter (l_linenumber % 3 = o_orderkey % 3) as n from orders left join lineitem on l_orderkey = o_orderkey where o_orderkey % 3 > 0 group by 1 having count(l_linenumber) filter (l_linenumber % 3 = o_orderkey % 3) <> 1")
def e15(t):
    module = lambda c: F.when(F.col(c) % 3 > 0, (F.col(c) % 3).cast("string")).otherwise("").alias("module")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), module("o_orderkey"))
    edges = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("dst"))
    targets = t.lineitem.select(F.col("l_linenumber").alias("m"), module("l_linenumber")).distinct()
    return audit.not_one_match(rows, "id", "module", edges, targets, "m").select("id", "n")


def _sets(t):
    """Two stores' key sets, all fifteen, from lines: theirs has some that ours lacks."""
    text = lambda c: F.col(c).cast("string")
    columns = {"method": F.col("l_returnflag"), "path": text("l_orderkey"), "name": text("l_linenumber"), "location": F.col("l_linestatus"), "content_type": F.lit("j"), "component_id": F.concat(F.lit("c"), text("l_partkey")), "status": text("l_linenumber"), "property": text("l_suppkey"), "target_component_id": F.concat(F.lit("t"), text("l_suppkey")), "kind": F.col("l_returnflag"), "yang_path": text("l_partkey"), "command_name": text("l_suppkey")}
    rows = t.lineitem.select("l_quantity", *[c.alias(n) for n, c in columns.items()])
    return {n: (rows.where("l_quantity <= 40").select(*k), rows.where("l_quantity > 10").select(*k)) for n, k in audit.KEY_SETS.items()}


_LINE = {"method": "l_returnflag", "path": "l_orderkey", "name": "l_linenumber", "location": "l_linestatus", "content_type": "'j'", "component_id": "'c' || l_partkey", "status": "l_linenumber", "property": "l_suppkey", "target_component_id": "'t' || l_suppkey", "kind": "l_returnflag", "yang_path": "l_partkey", "command_name": "l_suppkey"}


def _set_sql(name: str) -> str:
    cols = ", ".join(f"{_LINE[c]} as {c}" for c in audit.KEY_SETS[name])
    a, b = (f"(select distinct {cols} from lineitem where {cond})" for cond in ("l_quantity <= 40", "l_quantity > 10"))
    return f"select '{name}' as set_name, (select count(*) from {a}) as n_ours, (select count(*) from {b}) as n_theirs, (select count(*) from (select * from {b} except select * from {a})) as missing, (select count(*) from (select * from {a} except select * from {b})) as extra"


@query("e17_key_sets", " union all ".join(_set_sql(n) for n in audit.KEY_SETS))
def e17(t):
    from functools import reduce

    parts = [audit.parity_of(n, a, b).select(F.col("check").alias("set_name"), "n_ours", "n_theirs", "missing", "extra") for n, (a, b) in _sets(t).items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("e20_structural_parity", "select count(*) filter (p_partkey % 4 < 3) as missing, count(*) filter (p_partkey % 4 = 0) as alias, count(*) filter (p_partkey % 4 = 1) as structural, round((count(*) - count(*) filter (p_partkey % 4 = 2)) / count(*), 4) as coverage from part")
def e20(t):
    k, i = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    body = lambda title: F.concat(F.lit('{"properties": {"p'), i, F.lit(f'": {{"description": "{title}"}}}}, "title": "{title}"}}'))
    theirs = t.part.select(F.when(k == 0, F.concat(F.lit("s:N"), i)).when(k == 1, F.concat(F.lit("s:Shape_"), F.lower(F.hex("p_partkey")))).when(k == 2, F.concat(F.lit("s:Lost"), i)).otherwise(F.concat(F.lit("s:Same"), i)).alias("component_id"), body("theirs").alias("body"))
    ours = t.part.where(k != 2).select(F.when(k == 0, F.concat(F.lit("s:N"), i, F.lit("@0123456789ab"))).when(k == 1, F.concat(F.lit("s:Other"), i)).otherwise(F.concat(F.lit("s:Same"), i)).alias("component_id"), body("ours").alias("body"))
    return audit.parity_of("schema_components", ours, theirs).select("missing", "alias", "structural", "coverage")


@query("e26_build_health", "select (select count(*) from orders) as components, (select count(*) from lineitem) as properties, round((select count(*) from lineitem) / (select count(*) from orders), 2) as per_component, round(100 * count(*) filter (o_orderstatus = 'P') / count(*), 2) as percent_empty from orders")
def e26(t):
    components = t.orders.select(F.when(F.col("o_orderstatus") != "P", "{}").otherwise("").alias("body"))
    return audit.build_health(components, t.lineitem)


@query("i03_search_to_endpoints", "with recursive hit as (select n_nationkey as n from nation where n_regionkey = 1), up as (select n, n as node, 0 as d from hit union select n, (node * 7 + 3) % 25, d + 1 from up where d < 2) select distinct s_suppkey as endpoint, n as component from up join supplier on s_nationkey = node")
def i03(t):
    hits = t.nation.where("n_regionkey = 1").select(F.col("n_name").alias("id"), F.lit(1.0).alias("score"))
    owner = t.nation.select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("long").alias("component_id"))
    refers = t.supplier.select(F.col("s_suppkey").alias("endpoint_id"), F.col("s_nationkey").cast("long").alias("component_id"))
    composed = t.nation.select(((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"))
    out = context.fts_to_endpoints(hits, owner, refers, composed, 2)
    return out.select(F.col("endpoint_id").alias("endpoint"), F.col("component_id").cast("int").alias("component"))


_ROWS = {"component": 9, "property": 11, "endpoint": 2, "parameter": 3, "request": 1, "response": 3, "HAS_PROPERTY": 11, "PROPERTY_OF_TYPE": 1, "HAS_ITEM_SCHEMA": 1, "COMPOSED_OF": 3, "HAS_VALUE_SCHEMA": 1, "REFERENCES": 3, "REQUEST_REFERENCES": 1, "RESPONSE_REFERENCES": 1}


def _decomposed(t):
    return decompose.decompose(_specs(t).select(F.col("spec_id").cast("string").alias("provider"), "spec"))


@query("f14_decompose_specs", _counts("kind", _ROWS))
def f14(t):
    rows = _decomposed(t)
    return rows.groupBy(F.when(F.col("table") == "edge", F.col("kind")).otherwise(F.col("table")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("f19_properties", "select n_nationkey::varchar as provider, p.* from nation, (values ('name', true, '/m:n/name', ''), ('region', true, '', ''), ('code', false, '', ''), ('tags', false, '', ''), ('place', false, '', '')) as p(name, required, value_path, enums)")
def f19(t):
    own = _decomposed(t).where(F.col("table") == "property").where(F.col("parent").endswith(":schemas:Nation"))
    say = lambda k: F.coalesce(F.get_json_object("body", k), F.lit(""))
    return own.select("provider", "name", (say("$.required") == "true").alias("required"), say("$.extensions.x-path").alias("value_path"), F.replace(say("$.enumValues"), F.lit("[]"), F.lit("")).alias("enums"))


@query("f15_parameters", "select n_nationkey::varchar as provider, p.* from nation, (values ('GET', 'limit', 'string', 'pagination'), ('GET', 'ids', 'string', 'comma-list'), ('PUT', 'limit', 'integer', 'pagination')) as p(method, name, type, hint)")
def f15(t):
    own = _decomposed(t).where(F.col("table") == "parameter")
    say = lambda k: F.get_json_object("body", k)
    return own.select("provider", F.substring_index("parent", ":", 1).alias("method"), "name", say("$.type").alias("type"), say("$.hint").alias("hint"))


@query("f22_unresolved", "select n_nationkey || ':schemas:Lost' as id, 'unresolved' as kind from nation")
def f22(t):
    lost = {"components": {"schemas": {"A": {"allOf": [_REF("Lost"), _REF("B")]}, "B": {}}}}
    rows = decompose.decompose(_specs(t, lost).select(F.col("spec_id").cast("string").alias("provider"), "spec"))
    return decompose.unresolved(rows)


@query("g23_lineage", _counts("kind", {k: v for k, v in _ROWS.items() if not k.isupper()}))
def g23(t):
    lineage = decompose.lineage(_decomposed(t).where(F.col("table") != "edge"))
    return lineage.groupBy(F.col("table").alias("kind")).agg(F.count_distinct("projection_id").alias("n"))


@query("g24_degraded", "select case when c_custkey % 3 = 0 then 'failed' else 'component' end as kind, count(*) as n from customer group by 1")
def g24(t):
    spec = F.when(F.col("c_custkey") % 3 == 0, "{bad").otherwise('{"components": {"schemas": {"A": {}}}}')
    rows = decompose.decompose(t.customer.select(F.col("c_custkey").cast("string").alias("provider"), spec.alias("spec")))
    return rows.groupBy(F.col("table").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
