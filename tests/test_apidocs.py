"""API documents, pagers, guards and the query language's newer parts, on small inputs made here."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import jsonops
from weftgraph.operators import audit, context, export, govern, loaders, normalise, paths, search, semantic, shapes, topology, upsert
from weftgraph.plans.cypher import CypherError, cypher
from weftgraph.plans.graph import PropertyGraph
from weftgraph.queries.apidocs import SPEC
from weftgraph.sources import pager
from weftgraph.streaming import observations


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def spec():
    return json.loads(json.dumps(SPEC).replace("@K@", "1"))


def test_required_leaves():
    inner = {"type": "object", "required": ["x"], "properties": {"x": {}}}
    body = {"required": ["a", "l"], "properties": {"a": inner, "l": {"type": "array", "items": inner}, "o": inner, "p": {"type": "string"}}}
    assert normalise.required_leaves(body) == ["a.x", "l[].x", "o.x"]
    assert normalise.required_leaves({"required": ["a"], "properties": {}}) == ["a"] and normalise.required_leaves([]) == []


def test_prose_keeps_places():
    body = {"allOf": [{"type": "a"}, {"description": "d"}], "properties": {"description": {"title": "t", "type": "x"}}, "title": " ", "not": {"description": "lost"}}
    assert normalise.prose(body) == {"allOf": [None, {"description": "d"}], "properties": {"description": {"title": "t"}}}
    assert normalise.without_prose(body) == {"allOf": [{"type": "a"}, {}], "properties": {"description": {"type": "x"}}, "not": {}}
    assert normalise.prose({"type": "x"}) is None


def test_normalise_is_idempotent_and_pure():
    before = spec()
    once = normalise.normalised(before)
    assert before == spec() and normalise.normalised(once) == once
    assert [k[:9] for k in once["components"]["responses"]] == ["Error404_"]


def test_shared_objects_within_shared_ones():
    inner = {"type": "object", "properties": {k: {"type": "string"} for k in "abc"}}
    outer = {"type": "object", "properties": {"p": inner, "q": inner, "r": {}}}
    doc = {"paths": {"/x": {"post": {"requestBody": {"a": outer, "b": outer}}}}}
    out = normalise.normalised(doc)
    shelf = out["components"]["schemas"]
    body = out["paths"]["/x"]["post"]["requestBody"]
    assert body["a"] == body["b"] and list(body["a"]) == ["$ref"]
    assert normalise.expand(body["a"], {"components": out["components"]}) == outer and inner in shelf.values()
    assert normalise.normalised(out) == out


def test_richest_and_cycles():
    assert normalise.richest("#/components/schemas/A", {"schemas": {"A": {}}}, {"schemas": {"A": {"type": "object"}}}) == {"type": "object"}
    assert normalise.richest("#/other/A", {}) is None
    loop = {"schemas": {"A": {"$ref": "#/components/schemas/B"}, "B": {"$ref": "#/components/schemas/A"}}}
    assert sorted(normalise.reached({"$ref": "#/components/schemas/A"}, loop)["schemas"]) == ["A", "B"]


def test_walk_skips_data():
    doc = {"paths": {"/x": {"get": {"parameters": [{"schema": {"example": {"$ref": "#/no"}, "default": {"$ref": "#/no"}, "properties": {"x-real": {"type": "string"}}}, "x-note": {"$ref": "#/no"}}]}}}}
    kinds = [(kind, at) for _, kind, at in export.walk(doc)]
    assert ("schema", "/paths/~1x/get/parameters/0/schema/properties/x-real") in kinds
    assert export.check_references(doc) == 0
    with pytest.raises(export.ExportError):
        export.check_references({"paths": {"/x": {"get": {"requestBody": {"$ref": "#/components/none"}}}}})
    with pytest.raises(export.ExportError):
        export.check_references({"security": [{"key": []}]})


def test_corrections():
    schema = {"type": "integer", "default": " 7 ", "nullable": True, "minimum": 1, "exclusiveMinimum": True, "_id": "x"}
    doc = {"openapi": "3.0.3", "components": {"schemas": {"A": schema, "B": {"oneOf": [{"$ref": "#/components/schemas/A"}], "discriminator": {"propertyName": "k"}}}}}
    out, log = export.corrected(doc, "s")
    a = out["components"]["schemas"]["A"]
    assert a == {"type": ["integer", "null"], "default": 7, "exclusiveMinimum": 1} and doc["components"]["schemas"]["A"] is schema and "_id" in schema
    assert [c["rule"] for c in log] == ["remove_export_metadata", "default_type", "oas30_nullable", "oas30_exclusive_bound", "openapi_version"]
    assert out["components"]["schemas"]["B"]["discriminator"]["mapping"] == {"A": "#/components/schemas/A"}
    with pytest.raises(export.ExportError):
        export.corrected({"openapi": "2.0"}, "s")


def test_merge_conflicts_and_sharing():
    one, _ = export.corrected(spec(), "a")
    two = copy.deepcopy(one)
    two["paths"] = {"/other": two["paths"].pop("/n/1")}
    with pytest.raises(export.ExportError, match="twice"):
        export.merge([("m/a.json", "1", one), ("m/b.json", "2", one)], "t")
    for op in ("get", "put"):
        two["paths"]["/other"][op].pop("operationId")
    with pytest.raises(export.ExportError, match="operationId"):  # both take their file's name
        export.merge([("m/a.json", "1", one), ("m/b.json", "2", two)], "t")
    two["paths"]["/other"]["put"]["operationId"] = "other"
    out = export.merge([("m/a.json", "1", one), ("m/b.json", "2", two)], "t")
    assert len(out["components"]["schemas"]) == 5 and export.check_references(out) == 8 and out["paths"]["/other"]["get"]["operationId"] == "m_b"
    assert [p["name"] for p in out["paths"]["/n/1"]["get"]["parameters"]] == ["limit", "ids"]
    with pytest.raises(export.ExportError):
        export.merge([], "t")


def test_reconciled():
    report = {"name": "A", "fetched_specs": 2, "cached_specs": 0, "missing_specs": 1, "discovered": 3, "failure_reasons": {"no_oas_block": 1}}
    export.reconciled([report], {"A": 2}, 2)
    for change in ({"cached_specs": 1}, {"discovered": 4}, {"failure_reasons": {"timeout": 1}}, {"name": "B"}):
        with pytest.raises(export.ExportError):
            export.reconciled([{**report, **change}], {"A": 2}, 2)
    with pytest.raises(export.ExportError):
        export.reconciled([report], {"A": 2}, 3)


def test_example_data_is_no_schema():
    assert shapes.in_example(["paths", "/x", "get", "example", "a"]) and shapes.in_example(["examples", "one", "value", "x"])
    assert not shapes.in_example(["properties", "example", "type"]) and not shapes.in_example(["schemas", "default"])
    assert semantic.unknown_keys({"a": 1, "x-b": 2, "c/d": 3}, ["a"], "/p") == ["/p/c~1d"]
    assert semantic.kept_raw({"b": 1}, "Info", False) == "" and semantic.kept_raw({"b": 1}, "Operation", False) == '{"b":1}'
    assert shapes.type_text({"type": ["a", "null"]}) == "a|null" and shapes.inline_role({"oneOf": [{}]}) == "union"


def test_layer_of_odd_documents(spark):
    docs = [(1, "[1]"), (2, "{"), (3, "{}"), (4, json.dumps({"paths": {"/x": {"get": {"responses": {"200": {"content": None}}}}}})), (5, None)]
    got = semantic.overlays(spark.createDataFrame(docs, "spec_id long, spec string"))
    assert rows(got.where(F.col("table") == "failed").select("spec_id")) == [(1,), (2,), (5,)]
    assert semantic.nodes(got).count() == 2


# ---- pagers
def pages(*bodies):
    left = iter(bodies)
    asked = []

    def fetch(params):
        asked.append(params)
        return next(left)

    return fetch, asked


def test_pager():
    fetch, asked = pages({"items": [1, 2], "next": "a"}, {"items": [3], "next": None})
    assert pager.collect(fetch, size=2) == [1, 2, 3] and asked[1]["next"] == "a"
    fetch, asked = pages({"data": [1, 2], "offset": 0}, {"data": [3]})
    assert pager.collect(fetch, size=2) == [1, 2, 3] and asked[1]["offset"] == "2"
    fetch, _ = pages({"items": [1], "total": 2}, {"items": [2], "total": 2})
    assert pager.collect(fetch, size=9) == [1, 2]
    for code, bodies in {"PAGINATION_LOOP": [{"items": [1], "next": "a"}] * 3, "ITEM_ARRAY_NOT_FOUND": [{"errors": [1]}], "INVALID_PAGINATION_RESPONSE": [[1]], "INVALID_ITEM_ARRAY": [{"items": [1], "next": "a"}, {"items": 3}]}.items():
        with pytest.raises(pager.PageError) as e:
            pager.collect(pages(*bodies)[0], size=1)
        assert e.value.code == code
    with pytest.raises(pager.PageError) as e:
        pager.collect(lambda p: {"items": [1, 2]}, most=3, size=2)
    assert e.value.code == "PAGINATION_TRUNCATED"


# ---- guards, text and reports
def test_guards():
    assert govern.write_problem("MATCH (a) SET a.x = 'DROP it'") is None
    assert "CALL" in govern.write_problem("CALL f() MERGE (a)") and govern.write_problem("MATCH (a) RETURN a")
    assert govern.literal("it's \\") == "'it\\'s \\\\'"
    assert govern.alias_labels("MATCH (a:Site)-[r:HAS]->(b : Device), (:X)") == {"a": "Site", "b": "Device"}
    govern.VIEWS["places"] = {"Site", "HAS"}
    assert govern.view_problem("places", "MATCH (a:Site)-[:HAS]->(b) RETURN a") is None
    assert "Device" in govern.view_problem("places", "MATCH (a:Device) RETURN a") and govern.view_problem("none", "")
    assert govern.validation_text(["no a"], [], ["a"]).splitlines() == ["1 errors, 0 warnings", "- error: no a", "fields: a"]


def test_parity_text(spark):
    a = spark.createDataFrame([("p",)], "component_id string")
    b = spark.createDataFrame([("p",), ("q",)], "component_id string")
    assert audit.parity_text(audit.parity_of("schema_components", b, a)) == "parity: all 1 checks hold"
    assert audit.parity_text(audit.parity_of("schema_components", a, b)).splitlines()[1].startswith("- schema_components: 1 of 2 missing")


def test_rendered_tree(spark):
    ends = [("get", "/v1/a/b", "C", False), ("POST", "/v1/a/b", "C", True), ("GET", "/v1/a", "C", False), ("GET", "/v1/c/d/e", "C", None), ("GET", "/z", None, False)]
    got = {r["category"]: r["text"] for r in topology.rendered_trees(spark.createDataFrame(ends, "method string, path string, category string, deprecated boolean")).collect()}
    assert got["C"].splitlines() == ["## C (3)", "v1/", "  a  [GET]", "    b  [GET,POST] !", "  c/d/e  [GET]"]
    assert got["(uncategorised)"].splitlines() == ["## (uncategorised) (1)", "z  [GET]"]


def test_resolved_endpoint(spark):
    ends = spark.createDataFrame([("1", "GET", "/a"), ("2", "GET", "/b"), ("3", "GET", "/b"), ("4", "POST", "/c")], "endpoint_id string, method string, path string")
    assert context.resolved_endpoint(ends, path="a").first()["endpoint_id"] == "1" and context.resolved_endpoint(ends, endpoint_id="4", path="a").first()["path"] == "/c"
    for wrong in ("/b", "/c"):  # two, and none by GET
        with pytest.raises(Exception, match="endpoint"):
            context.resolved_endpoint(ends, path=wrong).collect()


def test_area_counts(spark):
    with pytest.raises(Exception, match="not a source"):
        loaders.area_counts(spark.createDataFrame([("a/b/c.json",)], "path string"), ["a"]).collect()


def test_search(spark):
    docs = spark.createDataFrame([(1, "big red dog"), (2, "red big dog"), (3, "bigger dogs"), (4, None)], "id long, t string")
    find = lambda q, **k: {r["id"] for r in search.bm25(docs, "id", ["t"], q, **k).collect()}
    assert find('"big red"') == {1} and find("big*") == {1, 2, 3} and find("red dog*", every=True) == {1, 2} and find("") == set()


# ---- the query language
@pytest.fixture
def graph(spark):
    site = spark.createDataFrame([(1, "North"), (2, "South")], "id long, name string")
    device = spark.createDataFrame([(1, "up"), (2, "down"), (3, "up")], "id long, status string")
    has = spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")
    link = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1)], "src long, dst long")
    return PropertyGraph().add_node("Site", site, "id").add_node("Device", device, "id").add_rel("HAS", has, "Site", "Device").add_rel("LINK", link, "Device", "Device")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (s:Site)-[:HAS]->(d), (d {status: 'up'}) RETURN s.id AS s, d.id AS d", [(1, 1)]),
        ("MATCH (s:Site) WHERE NOT EXISTS { MATCH (s)-[:HAS]->() } RETURN s.id AS s", [(2,)]),
        ("MATCH (s:Site) WHERE EXISTS { MATCH (s)-[:HAS]->(d) WHERE d.status = 'down' } OR s.name = 'South' RETURN s.id AS s", [(1,), (2,)]),
        ("MATCH (d:Device) WHERE d.status = 'up' AND NOT EXISTS { MATCH (:Site)-[:HAS]->(d) } RETURN d.id AS d", [(3,)]),
        ("MATCH (a:Device {id: 1})-[:LINK*1..3]->(b) RETURN b.id AS b, count(*) AS n", [(1, 2), (2, 2), (3, 2)]),  # parallel links are walks of their own
        ("MATCH (a:Device {id: 1})-[:LINK*0..1]->(b) RETURN b.id AS b", [(1,), (2,), (2,)]),
        ("MATCH (a:Device {id: 1})-[:LINK*1..3]->(b) RETURN DISTINCT b.id AS b", [(1,), (2,), (3,)]),
        ("MATCH (s:Site {id: 1})-[:HAS|LINK*2..2]->(d) RETURN d.id AS d", [(2,), (2,), (3,)]),  # site 1 isn't device 1
    ],
)
def test_language(graph, text, want):
    assert rows(cypher(graph, text)) == want


@pytest.mark.parametrize("text", ["MATCH (s:Site), (s {none: 1}) RETURN s.id", "CALL none() YIELD x RETURN x", "MATCH (s:Site) WHERE EXISTS { s } RETURN s.id", "RETURN CAST(1 AS nothing)"])
def test_language_errors(graph, text):
    with pytest.raises(CypherError):
        cypher(graph, text)


def test_walks_count_parallel_edges(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (2, 3)], "src long, dst long")
    got = rows(paths.walks(e, spark.createDataFrame([(1,)], "node long"), 2, 2))
    assert got == [(1, 3, 2)] * 4


# ---- plans at scale
def test_nearest_rank_of_skewed_values(spark):
    values = [("a", 1.0)] * 500 + [("a", float(v)) for v in range(2, 100)] + [("a", 1e9), ("a", None), ("b", 5.0)]
    got = {r["g"]: (r["p50"], r["p90"], r["p100"]) for r in audit.nearest_rank(spark.createDataFrame(values, "g string, v double"), ["g"], "v", [0.5, 0.9, 1.0], ranges=4).collect()}
    own = sorted(v for g, v in values if g == "a" and v is not None)
    pick = lambda p: own[round(p * (len(own) - 1))]
    assert got == {"a": (pick(0.5), pick(0.9), pick(1.0)), "b": (5.0, 5.0, 5.0)}


def test_unique_names_of_a_hot_base(spark):
    many = spark.range(500).select(F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise("x").alias("b"), F.col("id").alias("o"))
    got = {r["o"]: r["name"] for r in upsert.unique_names(many, "b", [F.col("o")], buckets=7).collect()}
    own = [o for o in range(500) if o % 5]
    assert {o: got[o] for o in own} == {o: "x" if k == 0 else f"x_{k + 1}" for k, o in enumerate(own)}
    assert upsert.unique_names(many.limit(0), "b", [F.col("o")]).count() == 0


def test_latest_state_needs_the_version_before(spark, tmp_path):
    step = observations.latest_state(str(tmp_path / "s"), ["k"], "at")
    batch = lambda *r: spark.createDataFrame(list(r), "k long, at long")
    with pytest.raises(FileNotFoundError):
        step(batch((1, 1)), 3)
    step(batch((1, 5), (2, 1)), 0)
    step(batch((1, 3), (2, 2)), 1)
    step(batch((1, 3), (2, 2)), 1)  # the same batch again
    assert rows(spark.read.parquet(str(tmp_path / "s" / "v1"))) == [(1, 5), (2, 2)]


def test_each_document(spark):
    docs = spark.createDataFrame([(1, '{"a": 1}'), (2, "{"), (3, '{"a": 0}'), (4, '{"b": 1}')], "id long, t string")

    def f(x):
        if x["a"] == 0:
            raise ValueError("zero")
        return [(x["a"],), (2,)]

    assert rows(jsonops.each_document(docs, "id", "t", f, "n long").select("id", "status", "n")) == [(1, "ok", 1), (1, "ok", 2), (2, "validation", None), (3, "resolution", None), (4, "unexpected", None)]


def test_json_letters(spark):
    text = 'é"\\\U0001f600\n'
    assert spark.range(1).select(jsonops.quoted(F.lit(text))).first()[0] == json.dumps(text)
