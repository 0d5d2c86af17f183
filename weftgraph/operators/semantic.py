"""The semantic layer of an API document: schemas, properties, endpoints, bodies and what they refer to, as nodes and edges.

One document's tree gives its nodes and edges in one call; ids, deduplication, joins of ends, ancestors and the lift onto
models are DataFrame operations over all documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.jsonops import strict_object
from weftgraph.operators import shapes
from weftgraph.operators.decompose import METHODS, canonical, lookup, vendor

#: Keys that hold schemas, alone, in lists and in maps; keys of a semantic edge's lift onto models.
ALONE, LISTED, MAPPED = ["items", "additionalProperties", "not", "contains", "if", "then", "else", "propertyNames"], ["allOf", "anyOf", "oneOf", "prefixItems"], ["properties", "patternProperties", "$defs", "definitions", "dependentSchemas"]
LIFTS = {"ACCEPTS_SCHEMA": "ACCEPTS_MODEL", "RETURNS_SCHEMA": "RETURNS_MODEL", "BODY_REFERENCES": "BODY_MODEL", "RESPONSE_REFERENCES": "RESPONSE_MODEL", "PROPERTY_OF_TYPE": "MODEL_OF_TYPE", "HAS_ITEM_SCHEMA": "MODEL_HAS_ITEM_SCHEMA", "COMPOSED_OF": "MODEL_COMPOSED_OF", "REFERENCES": "MODEL_REFERENCES", "HAS_VALUE_SCHEMA": "MODEL_HAS_VALUE_SCHEMA"}
_PLAIN_ENDS = ["ApiEndpoint", "RequestBody", "Response"]


def _esc(x: str) -> str:
    return str(x).replace("~", "~0").replace("/", "~1")


def _structural(body: dict) -> bool:
    more = body.get("additionalProperties")
    return isinstance(body.get("properties"), dict) or more is True or isinstance(more, dict) or any(isinstance(body.get(k), list) and body[k] for k in ("allOf", "anyOf", "oneOf"))


def _transparent(body: dict) -> bool:
    return isinstance(body.get("$ref"), str) and set(body) <= {"$ref", "description", "summary", "title"}


def _local(ref: Any) -> str:
    return ref[1:] if isinstance(ref, str) and ref.startswith("#/") and len(ref) > 2 else ""


def schema_places(spec: dict) -> Iterator[tuple[str, str, dict, str, bool]]:
    """(pointer, name, body, pointer of the schema that it is a property of or '', whether it is a schema node) in document
    order: every schema position and property. Example and default data isn't entered."""

    def schema(body: Any, at: str, name: str, owner: str, is_property: bool) -> Iterator[tuple[str, str, dict, str, bool]]:
        if not isinstance(body, dict):
            return
        named = at.count("/") == 3 and at.startswith("/components/schemas/")
        node = named or not (_transparent(body) or is_property and not _structural(body))
        yield at, name, body, owner if is_property else "", node
        for key in ALONE:
            if isinstance(body.get(key), dict):
                yield from schema(body[key], f"{at}/{key}", f"{name}.items" if key == "items" else key, "", False)
        for key in LISTED:
            for i, part in enumerate(body[key] if isinstance(body.get(key), list) else ()):
                yield from schema(part, f"{at}/{key}/{i}", str(i), "", False)
        for key in MAPPED:
            for k, part in (body[key] if isinstance(body.get(key), dict) else {}).items():
                own = key in ("properties", "patternProperties")
                yield from schema(part, f"{at}/{key}/{_esc(k)}", k, at, own)

    def content(x: Any, at: str) -> Iterator[tuple[str, str, dict, str, bool]]:
        for media, entry in ((x or {}).get("content") or {}).items() if isinstance(x, dict) else ():
            if isinstance(entry, dict):
                yield from schema(entry.get("schema"), f"{at}/content/{_esc(media)}/schema", "schema", "", False)

    shelf = spec.get("components") or {}
    for name, body in (shelf.get("schemas") or {}).items():
        yield from schema(body, f"/components/schemas/{_esc(name)}", name, "", False)
    for section in ("requestBodies", "responses"):
        for name, body in (shelf.get(section) or {}).items():
            yield from content(body, f"/components/{section}/{_esc(name)}")
    for path, item in (spec.get("paths") or {}).items():
        for i, p in enumerate(item.get("parameters") or [] if isinstance(item, dict) else ()):
            if isinstance(p, dict):
                yield from schema(p.get("schema"), f"/paths/{_esc(path)}/parameters/{i}/schema", "schema", "", False)
        for method, op in (item.items() if isinstance(item, dict) else ()):
            if method in METHODS and isinstance(op, dict):
                at = f"/paths/{_esc(path)}/{method}"
                yield from content(op.get("requestBody"), f"{at}/requestBody")
                for status, body in (op.get("responses") or {}).items():
                    yield from content(body, f"{at}/responses/{_esc(status)}")
                for i, p in enumerate(op.get("parameters") or []):
                    if isinstance(p, dict):
                        yield from schema(p.get("schema"), f"{at}/parameters/{i}/schema", "schema", "", False)


def value_paths(spec: dict, body: Any, seen: set[str] | None = None) -> set[str]:
    """Every x-path under a schema, through references, each reference once."""
    seen = set() if seen is None else seen
    if isinstance(body, list):
        return set().union(*[value_paths(spec, v, seen) for v in body])
    if not isinstance(body, dict):
        return set()
    out = {body["x-path"]} if isinstance(body.get("x-path"), str) and body["x-path"] else set()
    ref = body.get("$ref")
    if _local(ref) and ref not in seen:
        seen.add(ref)
        out |= value_paths(spec, lookup(ref, spec), seen)
    return out.union(*[value_paths(spec, v, seen) for k, v in body.items() if k != "$ref"])


def overlay(spec: dict) -> Iterator[tuple]:
    """("node", kind, key, name, pointer, summary) and ("edge", kind, source, target, rule, evidence) of one document.

    Sources and targets are (kind, key) as JSON; an edge whose end is no node is left for the join to drop."""
    places = list(schema_places(spec))
    nodes = {at for at, *_, node in places if node}
    key = lambda kind, k: canonical([kind, k])
    schema_key = lambda at: key("SchemaComponent", f"schema:{at}")

    def summary(body: dict, **more: Any) -> str:
        shape = shapes.body_shape(body)
        kind = "map" if shapes.component_kind(body) in ("object", "primitive", "array") and not body.get("enum") and (body.get("additionalProperties") is True or isinstance(body.get("additionalProperties"), dict)) else shapes.component_kind(body)
        return canonical({"bodyShape": shape, "kind": kind, "type": shapes.type_text(body), "constraints": shapes.constraints(body), "enumValues": shapes.enum_texts(body), "required": [r for r in body.get("required") or [] if isinstance(r, str)] if isinstance(body.get("required"), list) else [], "xExtensions": vendor(body), **more})

    for at, name, body, _, node in places:
        if node:
            yield "node", "SchemaComponent", f"schema:{at}", name, at, summary(body, isNamed=at.count("/") == 3 and at.startswith("/components/schemas/"))
    for at, name, body, owner, _ in places:
        if not owner:
            continue
        parent = lookup(f"#{owner}", spec)
        must = parent.get("required") if isinstance(parent, dict) else None
        yield "node", "Property", f"property:{at}", name, at, summary(body, required=isinstance(must, list) and name in must)
        me = key("Property", f"property:{at}")
        up = owner
        while up and up not in nodes:
            up = up.rpartition("/")[0]
        yield "edge", "HAS_PROPERTY", schema_key(up), me, "schema.properties", canonical({"propertyPointer": at})
        kind_at = shapes.type_pointer(body, at)
        yield "edge", "PROPERTY_OF_TYPE", me, schema_key(kind_at), "property.type", canonical({"schemaPointer": kind_at})
        if isinstance(body.get("items"), dict):
            item_at = shapes.type_pointer(body["items"], f"{at}/items")
            yield "edge", "HAS_ITEM_SCHEMA", me, schema_key(item_at), "property.items", canonical({"itemPointer": item_at, "propertyPointer": at})
        if isinstance(body.get("x-path"), str) and body["x-path"]:
            yield "node", "YangPath", f"yang:{body['x-path']}", body["x-path"], at, "{}"
            yield "edge", "PROPERTY_AT_YANG", me, key("YangPath", f"yang:{body['x-path']}"), "property.x-path", canonical({"propertyPointer": at})
    for at, _, body, _, node in places:
        if not node:
            continue
        if _local(body.get("$ref")):
            yield "edge", "REFERENCES", schema_key(at), schema_key(_local(body["$ref"])), "schema.ref", canonical({"schemaPointer": at})
        for word in ("allOf", "anyOf", "oneOf"):
            for i, part in enumerate(body[word] if isinstance(body.get(word), list) else ()):
                if isinstance(part, dict):
                    to = shapes.type_pointer(part, f"{at}/{word}/{i}")
                    yield "edge", "COMPOSED_OF", schema_key(at), schema_key(to), "schema.composition", canonical({"composition": word, "index": i, "targetPointer": to})
        for word in ("items", "additionalProperties"):
            if isinstance(body.get(word), dict):
                to = shapes.type_pointer(body[word], f"{at}/{word}")
                yield "edge", "HAS_VALUE_SCHEMA", schema_key(at), schema_key(to), "schema.value", canonical({"role": word, "targetPointer": to})
    yield from _endpoint_rows(spec, key, schema_key)


def _resolved(spec: dict, x: Any, at: str) -> tuple[Any, str]:
    ref = _local(x.get("$ref")) if isinstance(x, dict) else ""
    return (lookup(f"#{ref}", spec), ref) if ref else (x, at)


def _endpoint_rows(spec: dict, key, schema_key) -> Iterator[tuple]:
    for path, item in (spec.get("paths") or {}).items():
        for method, op in (item.items() if isinstance(item, dict) else ()):
            if method not in METHODS or not isinstance(op, dict):
                continue
            at, eid = f"/paths/{_esc(path)}/{method}", f"endpoint:{method.upper()}:{path}"
            name, me = f"{method.upper()} {path}", key("ApiEndpoint", f"endpoint:{method.upper()}:{path}")
            yield "node", "ApiEndpoint", eid, name, at, canonical({"method": method.upper(), "path": path, "operationId": op.get("operationId") or "", "tags": op.get("tags") or []})
            cli = op.get("x-cliParam")
            word = str(cli.get("commandName") or "").strip() if isinstance(cli, dict) else ""
            if word:
                given = [k if isinstance(k, str) else k["key"] for k in cli.get("paramKeys") or [] if isinstance(k, str) or isinstance(k, dict) and isinstance(k.get("key"), str)] if isinstance(cli.get("paramKeys"), list) else []
                yield "node", "CliCommand", f"cli:{eid}:{word}", word, f"{at}/x-cliParam", canonical({"paramKeys": given, "parentCommand": cli.get("parentCommand") or ""})
                yield "edge", "HAS_CLI_COMMAND", me, key("CliCommand", f"cli:{eid}:{word}"), "operation.x-cliParam", "{}"
            sites = [("RequestBody", "HAS_REQUEST_BODY", "BODY_REFERENCES", "ACCEPTS_SCHEMA", "", op["requestBody"], f"{at}/requestBody")] if isinstance(op.get("requestBody"), dict) else []
            sites += [("Response", "HAS_RESPONSE", "RESPONSE_REFERENCES", "RETURNS_SCHEMA", str(s), r, f"{at}/responses/{_esc(s)}") for s, r in (op.get("responses") or {}).items()]
            for kind, has, refers, takes, status, body, where in sites:
                body, where = _resolved(spec, body, where)
                if not isinstance(body, dict):
                    continue
                content = body.get("content") if isinstance(body.get("content"), dict) and body["content"] else {"": None}
                if kind == "RequestBody":  # media without a schema are no bodies, unless there is no other
                    content = {m: c for m, c in content.items() if isinstance(c, dict) and isinstance(c.get("schema"), dict)} or {"": None}
                for media, entry in content.items():
                    bid = f"requestBody:{eid}:{media}" if kind == "RequestBody" else f"response:{eid}:{status}:{media}"
                    yield "node", kind, bid, f"{name} {status or 'requestBody'}", where, canonical({"contentType": media, "status": status, "required": bool(body.get("required"))})
                    yield "edge", has, me, key(kind, bid), f"operation.{kind}", canonical({"pointer": where})
                    schema = entry.get("schema") if isinstance(entry, dict) else None
                    if not isinstance(schema, dict):
                        continue
                    to = shapes.type_pointer(schema, f"{where}/content/{_esc(media)}/schema")
                    evidence = canonical({"contentType": media, "status": status, "targetPointer": to})
                    yield "edge", refers, key(kind, bid), schema_key(to), f"{kind}.schema", evidence
                    yield "edge", takes, me, schema_key(to), f"operation.{kind}.schema", evidence
                    for value in sorted(value_paths(spec, schema)) if kind == "RequestBody" else ():
                        yield "node", "YangPath", f"yang:{value}", value, where, "{}"
                        yield "edge", "CONFIGURES_YANG", me, key("YangPath", f"yang:{value}"), "operation.x-path", canonical({"x-path": value})


def overlays(specs: DataFrame) -> DataFrame:
    """Rows of ``overlay`` of all documents (spec_id, spec as JSON text); one that can't be read gives a row of table ``failed``."""

    def work(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for i, text in zip(frame["spec_id"], frame["spec"], strict=True):
                try:
                    out += [(i, n, *row) for n, row in enumerate(overlay(strict_object(text)))]
                except (TypeError, ValueError, AttributeError, RecursionError) as e:
                    out.append((i, 0, "failed", type(e).__name__, "", "", "", str(e)[:300]))
            yield pd.DataFrame(out, columns=["spec_id", "ord", "table", "kind", "a", "b", "c", "d"])

    kind = specs.schema["spec_id"].dataType.simpleString()
    return specs.select("spec_id", "spec").mapInPandas(work, f"spec_id {kind}, ord long, `table` string, kind string, a string, b string, c string, d string")


def _id(spec: Column, pair: Column) -> Column:
    return F.concat(F.lit("sem:"), F.sha1(F.concat_ws("|", spec.cast("string"), pair)))


def nodes(rows: DataFrame) -> DataFrame:
    """semantic_id, spec_id, kind, stable_key, name, pointer and summary: the first node of each kind and key of a document."""
    n = rows.where(F.col("table") == "node")
    first = n.groupBy("spec_id", "kind", "a").agg(F.min_by(F.struct("b", "c", "d"), "ord").alias("x"))
    pair = F.concat(F.lit('["'), F.col("kind"), F.lit('",'), F.substring(F.to_json(F.array("a")), 2, 1 << 30))
    return first.select(_id(F.col("spec_id"), pair).alias("semantic_id"), "spec_id", "kind", F.col("a").alias("stable_key"), F.col("x.b").alias("name"), F.col("x.c").alias("pointer"), F.col("x.d").alias("summary"))


def edges(rows: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """src, dst, src_kind, dst_kind, kind, rule and evidence: each edge once, and only where both ends are nodes."""
    e = rows.where(F.col("table") == "edge").select(_id(F.col("spec_id"), F.col("a")).alias("src"), _id(F.col("spec_id"), F.col("b")).alias("dst"), "kind", F.col("c").alias("rule"), F.col("d").alias("evidence")).distinct()
    ends = all_nodes.select("semantic_id", F.col("kind").alias("k"))
    for end in ("src", "dst"):
        e = e.join(ends.withColumnsRenamed({"semantic_id": end, "k": f"{end}_kind"}), end)
    return e.select("src", "dst", "src_kind", "dst_kind", "kind", "rule", "evidence")


def derived_from(all_nodes: DataFrame, ast: DataFrame) -> DataFrame:
    """semantic_id and ast_id of the nodes whose pointer is a node of the document's tree (ast: spec_id, pointer, ast_id)."""
    return all_nodes.join(ast.select("spec_id", "pointer", "ast_id"), ["spec_id", "pointer"]).select("semantic_id", "ast_id", F.lit("primary").alias("role"))


def shortcuts(all_edges: DataFrame, model_of: DataFrame) -> DataFrame:
    """src, dst and kind of ten kinds of edges onto models: nine that stand for an edge between nodes, and CONFIGURES_MODEL
    from an endpoint to every model at a value path that it configures.

    model_of: semantic_id, model_id, and yang_id (a value path's node, or null)."""
    lifted = F.create_map(*[F.lit(x) for pair in LIFTS.items() for x in pair])
    m = model_of.select("semantic_id", "model_id").distinct()
    e = all_edges.where(F.col("kind").isin(list(LIFTS)))
    e = e.join(m.withColumnsRenamed({"semantic_id": "dst", "model_id": "dm"}), "dst").join(m.withColumnsRenamed({"semantic_id": "src", "model_id": "sm"}), "src", "left")
    source = F.when(F.col("src_kind").isin(_PLAIN_ENDS), F.col("src")).otherwise(F.col("sm"))
    e = e.select(source.alias("src"), F.col("dm").alias("dst"), F.col("kind").alias("old"), lifted[F.col("kind")].alias("kind")).where("src is not null and not (old = 'PROPERTY_OF_TYPE' and src = dst)").drop("old")
    at = model_of.where("yang_id is not null").select(F.col("yang_id").alias("dst"), "model_id").distinct()
    yang = all_edges.where(F.col("kind") == "CONFIGURES_YANG").join(at, "dst").select("src", F.col("model_id").alias("dst"), F.lit("CONFIGURES_MODEL").alias("kind"))
    return e.unionByName(yang).distinct()


# ---- the document's tree
def parents(ast: DataFrame) -> DataFrame:
    """(child, parent) of every node of a tree (spec_id, pointer, parent), by pointers."""
    return ast.where(F.col("pointer") != "").select("spec_id", F.col("pointer").alias("child"), F.col("parent"))


def nearest_schema(properties: DataFrame, schemas: DataFrame) -> DataFrame:
    """spec_id, pointer and ``schema``: the nearest node above each property whose pointer is a schema's; none are left out.

    A pointer's prefixes are few, so that climbing is a join with them and the longest that is met."""
    parts = F.split("pointer", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("schema")
    tried = properties.select("spec_id", "pointer", above)
    met = tried.join(schemas.select("spec_id", F.col("pointer").alias("schema")).distinct(), ["spec_id", "schema"])
    return met.groupBy("spec_id", "pointer").agg(F.max_by("schema", F.length("schema")).alias("schema"))


def linked_references(ast: DataFrame) -> DataFrame:
    """(spec_id, source, target) for each $ref text of a tree (spec_id, pointer, key, kind, scalar) that leads to a node of it."""
    refs = ast.where((F.col("key") == "$ref") & (F.col("kind") == "string")).select("spec_id", F.col("pointer").alias("source"), F.expr("try_parse_json(scalar)::string").alias("ref"))
    refs = refs.where(F.col("ref").startswith("#")).withColumn("target", F.substring("ref", 2, 1 << 30)).drop("ref")
    return refs.join(ast.select("spec_id", F.col("pointer").alias("target")), ["spec_id", "target"]).select("spec_id", "source", "target")


def typed_edges(all_edges: DataFrame, typed_ids: DataFrame) -> DataFrame:
    """Edges between the typed ids of their ends (typed_ids: semantic_id, typed_id); those with an end that has none are dropped."""
    out = all_edges
    for end in ("src", "dst"):
        out = out.join(typed_ids.select(F.col("semantic_id").alias(end), F.col("typed_id").alias(f"{end}_typed")), end)
    return out.select(F.col("src_typed").alias("src"), F.col("dst_typed").alias("dst"), "kind")


def catalogue_rank(rows: DataFrame, keys: list[str], body: str) -> Column:
    """A rank of variants of one name: the longest body first, of equal ones the greater hash."""
    return F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.length(body).desc(), F.sha1(body).desc()))


def unknown_keys(body: dict, known: list[str], at: str = "") -> list[str]:
    """Pointers of an object's keys that its vocabulary lacks; extensions (x-) are allowed."""
    return [f"{at}/{_esc(k)}" for k in body if k not in known and not k.startswith("x-")]


def kept_raw(x: Any, kind: str, is_schema: bool) -> str:
    """The raw JSON that is kept of a node: of schemas, operations, parameters, bodies and responses, and of no other."""
    return json.dumps(x, sort_keys=True, separators=(",", ":")) if is_schema or kind in ("Operation", "Parameter", "RequestBody", "Response", "MediaType", "Property") else ""


def typed_id(provider: Column, pointer: Column) -> Column:
    """A schema's id from its pointer: ``provider:section:Name``, and of what is within it, each step after a ``#``."""
    inner = F.regexp_replace(pointer, "^/components/([^/]+)/([^/]+)", "$1:$2")
    for step, mark in (("/(properties|patternProperties)/([^/]+)", "#prop:$2"), ("/(allOf|anyOf|oneOf|prefixItems)/([0-9]+)", "#$1:$2"), ("/(items|additionalProperties|not)(?=/|#|$)", "#$1")):
        inner = F.regexp_replace(inner, step, mark)
    return F.concat_ws(":", provider, inner)


def typed_tables(all_nodes: DataFrame, all_edges: DataFrame, kinds: list[str], rels: list[str]) -> dict[str, DataFrame]:
    """A table for each kind of node and relationship, in the columns that it has of its own."""
    out = {k: all_nodes.where(F.col("kind") == k).select("semantic_id", "spec_id", "stable_key", "name", "pointer", "summary") for k in kinds}
    return out | {r: all_edges.where(F.col("kind") == r).select("src", "dst", "rule", "evidence") for r in rels}
