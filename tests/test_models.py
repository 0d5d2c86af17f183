"""Nulls, ties, empty tables and cycles in the operators of models."""

from pyspark.sql import functions as F

from weftgraph.operators import model


def test_tokens(spark):
    rows = spark.createDataFrame([("  Host-Name ",), ("---",), (None,), ("",), ("é1é",)], "s string")
    assert [r[0] for r in rows.select(model.identity_token(F.col("s"))).collect()] == ["host-name", "unnamed", "unnamed", "unnamed", "1"]
    ids = spark.createDataFrame([("/a/b", "N", "/p"), ("", "N x", "/p"), (None, None, "/p")], "y string, n string, p string")
    assert [r[0] for r in ids.select(model.schema_identity(F.col("y"), F.col("n"), F.col("p"))).collect()] == ["yang:/a/b", "schema:n-x", "schema-pointer:/p"]


def test_merged_models(spark):
    rows = [("k", 2, "b", ["x", "y"], None), ("k", 1, "", ["y", None, "y"], False), ("k", 1, None, None, True), ("k", 3, "c", [], None), ("l", 1, None, None, None), (None, 1, "z", ["z"], True)]
    nodes = spark.createDataFrame(rows, "key string, o int, name string, tags array<string>, required boolean")
    got = {r["key"]: r for r in model.merge_models(nodes, "key", "o", ["name"], ["tags"], ["required"]).collect()}
    assert set(got) == {"k", "l"}
    assert (got["k"]["name"], got["k"]["tags"], got["k"]["required"], got["k"]["n_nodes"]) == ("b", ["y", "x"], True, 4)
    assert (got["l"]["name"], got["l"]["tags"], got["l"]["required"]) == (None, [], False)
    assert model.merge_models(nodes.limit(0), "key", "o", ["name"], ["tags"], ["required"]).count() == 0


def test_overrides(spark):
    rows = [("e", "q", "query", 0, 1), ("e", "q", "query", 1, 0), ("e", "q", "path", 0, 2), ("e", None, None, 0, 3), ("e", None, None, 0, 4)]
    got = model.override_parameters(spark.createDataFrame(rows, "e string, name string, location string, level int, o int"), "e", "level", "o").collect()
    assert sorted((r["name"] or "", r["location"] or "", r["level"], r["o"]) for r in got) == [("", "", 0, 4), ("q", "path", 0, 2), ("q", "query", 1, 0)]


def test_property_map(spark):
    roots = spark.createDataFrame([("a",), ("z",)], "root string")
    composed = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "b")], "src string, dst string")
    properties = spark.createDataFrame([("a", "x", "a.x"), ("b", "x", "b.x"), ("c", "y", "c.y2"), ("c", "y", "c.y1"), ("b", "", "b."), ("b", None, "b.n")], "parent string, name string, property_id string")
    got = sorted(tuple(r) for r in model.property_map(roots, composed, properties).collect())
    assert got == [("a", "x", "a.x", 0), ("a", "y", "c.y1", 2)]


def test_missing_inputs(spark):
    endpoints = spark.createDataFrame([(1, "/s/{id}/{id}/{k}", ["limit"], ["k"]), (2, "/t", None, None), (3, None, None, None)], "endpoint_id int, path string, query_names array<string>, path_names array<string>")
    parameters = spark.createDataFrame([(1, "limit", "Query", True), (1, "id", "path", True), (2, "q", "query", True), (2, "h", "header", True), (2, "n", None, True), (2, "o", "query", False), (2, "", "query", True), (9, "q", "query", True)], "endpoint_id int, name string, location string, required boolean")
    got = sorted(tuple(r) for r in model.missing_inputs(endpoints, parameters).collect())
    assert got == [(1, "missing path parameter", "id"), (2, "missing query parameter", "q"), (2, "unsupported place: header", "h"), (2, "unsupported place: unknown", "n")]
