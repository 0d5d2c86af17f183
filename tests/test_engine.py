"""The engine's parts on small tables made here."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import jsonops, scalar
from weftgraph.operators import audit, decompose, govern, hydrate, model, paths, topology, upsert
from weftgraph.plans.cypher import CypherError, cypher
from weftgraph.plans.graph import PropertyGraph
from weftgraph.sources import files, pages
from weftgraph.streaming import observations


@pytest.fixture
def graph(spark):
    site = spark.createDataFrame([("s1", "North"), ("s2", "South"), ("s3", None)], "id string, name string")
    device = spark.createDataFrame([("d1", "up", 5), ("d2", "down", 7), ("d3", None, 9)], "serial string, status string, load int")
    has = spark.createDataFrame([("s1", "d1"), ("s1", "d2"), ("s2", "d3")], "src string, dst string")
    link = spark.createDataFrame([("d1", "d2", "LAG"), ("d2", "d3", "")], "src string, dst string, kind string")
    return PropertyGraph().add_node("Site", site, "id").add_node("Device", device, "serial").add_rel("HAS_DEVICE", has, "Site", "Device").add_rel("LINKED_TO", link, "Device", "Device")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (s:Site)-[:HAS_DEVICE]->(d:Device) RETURN s.name, d.serial", [("North", "d1"), ("North", "d2"), ("South", "d3")]),
        ("MATCH (s:Site) OPTIONAL MATCH (s)-[:HAS_DEVICE]->(d:Device) RETURN s.id AS s, count(d) AS n", [("s1", 2), ("s2", 1), ("s3", 0)]),
        ("MATCH (s:Site) OPTIONAL MATCH (s)-[:HAS_DEVICE]->(d:Device) WHERE d.load > 6 RETURN s.id AS s, collect(d.serial) AS n", [("s1", ["d2"]), ("s2", ["d3"]), ("s3", [])]),
        ("MATCH (d:Device)-[:LINKED_TO*0..2]->(e:Device) WHERE d.serial = 'd1' RETURN e.serial", [("d1",), ("d2",), ("d3",)]),
        ("MATCH (d:Device)-[:LINKED_TO*2..2]->(e:Device) RETURN d.serial, e.serial", [("d1", "d3")]),
        ("MATCH (d:Device)-[l:LINKED_TO {kind: 'LAG'}]->(e) RETURN d.serial AS a, l.kind AS k, e.serial AS b", [("d1", "LAG", "d2")]),
        ("MATCH (d:Device)-[:LINKED_TO]-(e:Device) WHERE d.serial = 'd2' RETURN e.serial AS e", [("d1",), ("d3",)]),
        ("MATCH (n) WHERE (n:Site OR n:Device) AND n.name = 'North' RETURN labels(n)[0] AS l", [("Site",)]),
        ("MATCH (d:Device) WHERE d.status IS NULL OR NOT d.status = 'up' RETURN d.serial AS s, coalesce(d.status, 'none') AS t", [("d2", "down"), ("d3", "none")]),
        ("UNWIND [1, 2, 3] AS x RETURN x * 2 AS y", [(2,), (4,), (6,)]),
        ("MATCH (d:Device) RETURN d.serial AS s ORDER BY d.load DESC SKIP 1 LIMIT 1", [("d2",)]),
        ("MATCH (d:Device) WITH d.status AS st, count(*) AS n WHERE n = 1 RETURN DISTINCT n", [(1,)]),
        ("MATCH (d:Device) WHERE d.serial IN $ids RETURN d.serial AS s", [("d1",), ("d3",)]),
        ("MATCH (a:Site {id: 's1'}) RETURN a.id AS i UNION ALL MATCH (a:Site {id: 's1'}) RETURN a.id AS i", [("s1",), ("s1",)]),
        ("RETURN $v AS v", [(4,)]),
        ("MATCH (d:Device) RETURN CASE WHEN d.load > 6 THEN 'hot' ELSE 'ok' END AS c, size(d.serial) AS z, toUpper(d.serial) AS u ORDER BY u LIMIT 1", [("ok", 2, "D1")]),
    ],
)
def test_cypher(graph, text, want):
    assert rows(cypher(graph, text, {"ids": ["d1", "d3"], "v": 4})) == want


@pytest.mark.parametrize("text", ["CREATE (n:Site)", "MATCH (n:Site) SET n.name = 'x'", "MATCH (n:Nope) RETURN n", "MATCH (n:Site) RETURN n.nope", "MATCH (n:Site)-[:NOPE]->(m) RETURN m", "MATCH (n:Site) RETURN $p", "MATCH (n:Site", "MATCH (n:Site) RETURN f(n)", "MATCH (s:Site) DETACH DELETE s"])
def test_cypher_refuses(graph, text):
    with pytest.raises(CypherError):
        cypher(graph, text).collect()


def test_words_in_literals_may_be_writes(graph):
    assert rows(cypher(graph, "MATCH (s:Site) WHERE s.name <> 'delete' RETURN s.id AS i")) == [("s1",), ("s2",)]


def test_graph_loads(graph, spark):
    with pytest.raises(ValueError, match="twice"):
        graph.load_nodes("Site", spark.createDataFrame([("s1", "x")], "id string, name string"))
    with pytest.raises(ValueError, match="are no"):
        graph.load_rels("HAS_DEVICE", spark.createDataFrame([("s1", "nope")], "src string, dst string"))
    graph.load_nodes("Site", spark.createDataFrame([("s4", "x")], "id string, name string")).load_rels("HAS_DEVICE", spark.createDataFrame([("s4", "d1")], "src string, dst string"))
    graph.add_column("Site", "zip", "string").add_column("Site", "zip", "string")
    assert {(r["name"], r["n"]) for r in graph.counts().collect()} == {("Site", 4), ("Device", 3), ("HAS_DEVICE", 4), ("LINKED_TO", 2)}
    assert "zip string" in graph.describe() and "Site-[HAS_DEVICE]->Device" in graph.hint() and "it has" in graph.property_hint("Site", "x")


def test_closure_and_cuts(spark):
    r = random.Random(1)
    for n in (8, 14):
        edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(n)})
        frame = spark.createDataFrame(edges, "src long, dst long")

        def reach(without_edge=None, without_node=None, edges=edges):
            near = {}
            for a, b in edges:
                if a != b and {a, b} != without_edge and without_node not in (a, b):
                    near.setdefault(a, set()).add(b)
                    near.setdefault(b, set()).add(a)
            left, out = {x for e in edges for x in e if x != without_node}, []
            while left:
                todo, seen = [min(left)], {min(left)}
                while todo:
                    for y in near.get(todo.pop(), ()):
                        if y not in seen:
                            seen.add(y)
                            todo.append(y)
                out.append(seen)
                left -= seen
            return out

        whole = reach()
        got = paths.components(frame).collect()
        assert {(x["node"], x["component"]) for x in got} == {(x, min(c)) for c in whole for x in c}
        real = {(min(e), max(e)) for e in edges if e[0] != e[1]}
        bridges = {e for e in real if len(reach(without_edge=set(e))) > len(whole)}
        points = {x for e in real for x in e if len(reach(without_node=x)) > len(whole)}
        cut = paths.cuts(frame).collect()
        assert {(x["a"], x["b"]) for x in cut if x["kind"] == "bridge"} == bridges
        assert {x["a"] for x in cut if x["kind"] == "articulation"} == points


def test_json(spark):
    doc = {"a/b": [1, 2.5, None, {"~": "x"}], "c": {}, "d": [], "e": True, "f": "é"}
    assert jsonops.rebuild(list(jsonops.shred(json.dumps(doc)))) == doc
    with pytest.raises(ValueError):
        jsonops.strict_object('{"a": 1, "a": 2}')
    got = jsonops.shred_table(spark.createDataFrame([(1, '{"k": [1]}'), (2, "{"), (3, None)], "id long, j string"), "id", "j")
    assert {(r["id"], r["pointer"], r["kind"]) for r in got.collect()} == {(1, "", "object"), (1, "/k", "array"), (1, "/k/0", "number"), (2, "", "invalid"), (3, "", "invalid")}
    row = spark.range(1).select(jsonops.canonical(F.lit('{"b": 1, "a": [2, 1]}')).alias("c"), jsonops.pointer_parts(F.lit("/a~1b/~0")).alias("p"), jsonops.pointer_parent(F.lit("/a/b")).alias("u"), jsonops.pointer_last(F.lit("/a/b~1")).alias("l"), model.identity_token(F.lit("  A b--C ")).alias("t"), scalar.fill_path(F.lit("/x/{id}"), F.create_map(F.lit("id"), F.lit("7"))).alias("f")).first()
    assert tuple(row) == ('{"a":[2,1],"b":1}', ["a/b", "~"], "/a", "b/", "a-b-c", "/x/7")


SPEC = {
    "components": {"schemas": {
        "Auth": {"type": "object", "required": ["on"], "properties": {"on": {"type": "boolean", "x-path": "m:auth/on"}, "key": {"type": "string", "maxLength": 8}}},
        "Profile": {"allOf": [{"$ref": "#/components/schemas/Auth"}, {"type": "object", "properties": {"name": {"type": "string"}, "tags": {"type": "array", "items": {"properties": {"t": {"type": "string"}}}}}}]},
        "Bag": {"type": "object", "additionalProperties": {"$ref": "#/components/schemas/Lost"}},
    }},
    "paths": {"/p/{id}": {"parameters": [{"in": "path", "name": "id", "required": True}], "post": {"operationId": "mk", "tags": ["t"], "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Profile"}}}}, "responses": {"201": {"content": {"*/*": {}}}}}}},
}


def test_decompose(spark):
    frame = spark.createDataFrame([("v", json.dumps(SPEC)), ("w", "nope"), ("v", json.dumps(SPEC))], "provider string, spec string")
    got = decompose.decompose(frame).cache()
    ids = {(r["table"], r["id"]) for r in got.collect()}
    assert {("endpoint", "POST:/p/{id}"), ("parameter", "POST:/p/{id}#param:path:id"), ("component", "v:schemas:Profile#allOf:1"), ("property", "v:schemas:Auth#prop:on"), ("component", "v:schemas:Profile#allOf:1#prop:tags#items"), ("request", "POST:/p/{id}#requestBody:application~1json"), ("response", "POST:/p/{id}#response:201:*~1*")} <= ids
    assert got.where("table = 'failed'").count() == 1
    assert {r["id"] for r in decompose.unresolved(got).collect()} == {"v:schemas:Lost"}
    assert decompose.winners(got).where("n_bodies > 1").count() == 0
    assert decompose.lineage(got).groupBy("projection_id").count().where("count > 1").count() == 0
    loop = {"components": {"schemas": {"A": {"properties": {"a": {"$ref": "#/components/schemas/A"}}}}}}
    assert "$circular_ref" in json.dumps(decompose.expand({"$ref": "#/components/schemas/A"}, loop, 3))


def test_pages(spark):
    html = "<html><head><title>t</title></head><body>nav<div id='main-content'><p>Intro<br>two</p><h1 id='x'>One <b>b</b></h1><p>a  b</p><script>bad()</script><h2>Two Words</h2>end</div>foot</body></html>"
    assert pages.text_of(html) == "Intro\ntwo\n\nOne b\n\na b\n\nTwo Words\nend"
    assert pages.sections_of(html, "s") == [("s#intro", "", "Intro\ntwo"), ("s#x", "One b", "a b"), ("s#two-words", "Two Words", "end")]
    frame = spark.createDataFrame([(1, "http://h/s", html), (2, None, None)], "page_id long, url string, html string")
    assert pages.page_text(frame).count() == 2 and pages.page_sections(frame).count() == 3


def test_govern(graph, spark):
    big = spark.range(300).select("id", F.lit("x" * 5000).alias("t"))
    out = govern.run(big)
    assert out["truncated"] and out["returned"] < 200 and json.loads(out["rows"][0]["t"])["size_bytes"] == 5000
    assert "error" in govern.run(spark.range(3000)) and govern.run(spark.range(3))["rows"] == [{"id": 0}, {"id": 1}, {"id": 2}]
    batch = govern.run_batch(["MATCH (s:Site) RETURN s.id", "bad"], lambda q: govern.run(cypher(graph, q)))
    assert (batch["ok"], batch["failed"]) == (1, 1) and "error" in govern.run_batch([], lambda q: {})


def test_hydrate(spark):
    raw = [(1, '{"errors": [1, 2, 3], "a": [{"serial": "x"}], "b": [{"id": 1}, {"id": 2}]}'), (2, "[5]"), (3, '{"id": 7}'), (4, "no"), (5, '{"items": [], "b": [1]}')]
    got = rows(hydrate.objects(spark.createDataFrame(raw, "observation_id long, rawJson string")).select("observation_id", "item_index", "pointer"))
    assert got == [(1, 0, "/b/0"), (1, 1, "/b/1"), (2, 0, "/0"), (3, -1, "")]
    ids = spark.createDataFrame([('{"serial": "S1", "id": "7"}',), ('{"SerialNumber": "a", "name": "n"}',), ('{"q": "1"}',), ('{"uid": 3}',), ('{"id": "", "mac": null}',), ("[1]",), ('{"id": false}',)], "j string")
    keys = [tuple(r[0]) for r in ids.select(hydrate.identity_key(hydrate.identity(F.col("j")))).collect()]
    assert keys == [("id=7", "id"), ("SerialNumber=a", "SerialNumber"), ("", ""), ("uid=3", "uid"), ("", ""), ("", ""), ("id=False", "id")]
    two = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(f'"{v}"').alias("json"), F.lit(v).alias("text")) for k, v in (("q", "é\U0001f600"), ("b", "2"))])
    want = hashlib.sha256(json.dumps({"q": "é\U0001f600", "b": "2"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    assert spark.range(1).select(hydrate.identity_key(two)["key"]).first()[0] == f"identityHash={want}"
    sure = [r[0] for r in spark.createDataFrame([("id", 1), ("siteId", 1), ("Serial", 1), ("uid", 2)], "f string, n int").select(hydrate.confidence(F.col("f"), F.col("n"))).collect()]
    assert sure == ["high", "medium", "low", "medium"]


def test_parity_and_changes(spark):
    ours, theirs = (spark.createDataFrame([(x,) for x in s], "k string") for s in (["a", "b@0123456789ab"], ["a", "b", "c"]))
    assert tuple(audit.parity(ours, theirs, "k").first()) == (2, 3, 2, 1, 0.3333)
    missing = theirs.join(ours, "k", "left_anti")
    assert rows(audit.alias_equivalent(missing, ours, "k")) == [("b",)]
    with pytest.raises(AssertionError):
        audit.assert_holds({"none": (missing, F.col("k"))})
    old = spark.createDataFrame([("s#a", 1), ("s", 2), ("sx", 3)], "k string, v int")
    assert rows(upsert.owned_by(old, "k", "s")) == [("s#a",), ("s",)]


def test_topology(spark):
    jobs = spark.createDataFrame([("c",), ("a",), ("b",)], "job string")
    assert topology.levels(jobs, spark.createDataFrame([("a", "c")], "job string, needs string")) == ["b", "c", "a"]
    assert topology.levels(jobs, spark.createDataFrame([("a", "c"), ("c", "a")], "job string, needs string")) == ["a", "b", "c"]
    paging = spark.createDataFrame([(["limit", "offset"],), (["next"],), (["limit", "next"],), (["cursor"],), (["limit"],), ([],)], "n array<string>").select(hydrate.paging_style(F.col("n"))["style"])
    assert [r[0] for r in paging.collect()] == ["offset", "none_detected", "cursor", "cursor", "bounded_list", "none_detected"]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text('{"x": 1, "x": 2}')
    (tmp_path / "c.json").write_text("[1]")
    good, bad = files.json_documents(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (1, 2)
    a = spark.createDataFrame([("p",), ("q",)], "b string")
    assert files.corpus_identity(a, "b").first() == files.corpus_identity(a.orderBy(F.desc("b")), "b").first()
    files.swap_table(a, str(tmp_path / "t"))
    files.swap_table(a.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    page = spark.createDataFrame([(1, '{"items": [{"a": 1}, {"a": 2}]}')], "page long, body string")
    assert files.paged(page).count() == 2


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "state")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(src)
    stream = observations.event_stream(spark, src, per_trigger=1)
    q = stream.writeStream.foreachBatch(observations.latest_state(out, ["user_id"], "event_id")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.read.parquet(f"{out}/v{q.lastProgress['batchId']}")
    want = {(r[0], r[1]) for r in events.groupBy("user_id").agg(F.max("event_id")).collect()}
    assert {(r["user_id"], r["event_id"]) for r in last.collect()} == want
    q = observations.windowed(stream, late="4000 days").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
