"""JSON and OpenAPI-like documents into components, properties, references, endpoints and lineage.

A document's tree is small and recursive, so that one document is handled in one call, batch by batch in Arrow;
everything between documents (pools, winners, closures, integrity) is joins and aggregates.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.jsonops import strict_object
from weftgraph.operators.shapes import body_shape, component_kind, constraints, device_types, enum_texts, parameter_hint

METHODS = ["get", "put", "post", "delete", "patch", "head", "options", "trace"]
COMPOSITION = ["allOf", "oneOf", "anyOf"]


def canonical(x: Any) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(x: Any) -> str:
    """The SHA-1 of x as JSON of ASCII with sorted keys."""
    return hashlib.sha1(json.dumps(x, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def references(x: Any, via: str = "") -> Iterator[tuple[str, str]]:
    """(ref, via): each $ref and the structural key that holds it; what is beside a $ref isn't walked."""
    if isinstance(x, dict):
        if isinstance(x.get("$ref"), str):
            yield x["$ref"], via
            return
        for k, v in x.items():
            yield from references(v, k if not k.startswith("x-") else via)
    elif isinstance(x, list):
        for v in x:
            yield from references(v, via)


def expand(x: Any, components: dict, depth: int = 15) -> Any:
    """x with each $ref replaced by its target, to a depth; beyond it ``{"$circular_ref": true}``."""
    if isinstance(x, list):
        return [expand(v, components, depth) for v in x]
    if not isinstance(x, dict):
        return x
    ref = x.get("$ref")
    if isinstance(ref, str):
        if depth <= 0:
            return {"$circular_ref": True}
        target = lookup(ref, components)
        return expand(target, components, depth - 1) if target is not None else dict(x)
    return {k: expand(v, components, depth) for k, v in x.items()}


def lookup(ref: str, root: dict) -> Any:
    at: Any = root
    for part in ref.removeprefix("#").split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        at = at.get(key) if isinstance(at, dict) else at[int(key)] if isinstance(at, list) and key.isdigit() and int(key) < len(at) else None
        if at is None:
            return None
    return at


def vendor(body: dict) -> dict:
    return {k: v for k, v in body.items() if k.startswith("x-")}


def coerce_default(body: dict) -> dict:
    """A default that is text becomes what the type says, where it can."""
    d, kind = body.get("default"), body.get("type")
    if not isinstance(d, str):
        return body
    try:
        if kind == "boolean" and d.lower() in ("true", "false", "1", "0", ""):
            return {**body, "default": d.lower() in ("true", "1")}
        if kind == "integer":
            return {**body, "default": int(d)}
        if kind == "number":
            return {**body, "default": float(d)}
    except ValueError:
        pass
    return body


def cleaned(x: Any) -> Any:
    """Without keys that start with an underscore, and with defaults coerced."""
    if isinstance(x, list):
        return [cleaned(v) for v in x]
    if isinstance(x, dict):
        return coerce_default({k: cleaned(v) for k, v in x.items() if not k.startswith("_")})
    return x


def rows_of(provider: str, spec: dict) -> Iterator[tuple]:
    """(table, id, parent, name, kind, body) rows: components, properties, refs, endpoints, parameters."""
    schemas = (spec.get("components") or {}).get("schemas") or {}

    def component(cid: str, name: str, body: dict) -> Iterator[tuple]:
        yield "component", cid, "", name, f"{component_kind(body)}/{body_shape(body)}", canonical(body)
        must = set(body.get("required") or [])
        for prop, own in (body.get("properties") or {}).items():
            own = own if isinstance(own, dict) else {}
            pid = f"{cid}#prop:{prop}"
            full = resolved_once(own)
            said = {"required": prop in must, "readOnly": bool(full.get("readOnly")), "enumValues": enum_texts(full), "supportedDeviceTypes": device_types(full), "constraints": constraints(own), "extensions": {**vendor(full), **vendor(own)}}
            yield "property", pid, cid, prop, str(own.get("type") or ("ref" if "$ref" in own else "")), canonical(said)
            yield "edge", cid, pid, "properties", "HAS_PROPERTY", ""
            if isinstance(own.get("$ref"), str):
                yield "edge", pid, target(own["$ref"]), prop, "PROPERTY_OF_TYPE", ""
            items = own.get("items")
            if isinstance(items, dict) and (items.get("properties") or isinstance(items.get("$ref"), str)):
                yield "edge", pid, target(items["$ref"]) if "$ref" in items else f"{pid}#items", prop, "HAS_ITEM_SCHEMA", ""
            if own.get("properties"):
                yield from component(f"{pid}#object", prop, own)
            if isinstance(own.get("items"), dict) and own["items"].get("properties"):
                yield from component(f"{pid}#items", prop, own["items"])
        for k in COMPOSITION:
            for i, part in enumerate(body.get(k) or []):
                if "$ref" in part:
                    yield "edge", cid, target(part["$ref"]), k, "COMPOSED_OF", ""
                else:
                    yield from component(f"{cid}#{k}:{i}", name, part)
                    yield "edge", cid, f"{cid}#{k}:{i}", k, "COMPOSED_OF", ""
        more = body.get("additionalProperties")
        if isinstance(more, dict) and isinstance(more.get("$ref"), str):
            yield "edge", cid, target(more["$ref"]), "", "HAS_VALUE_SCHEMA", ""
        elif isinstance(more, dict):
            yield from component(f"{cid}#additionalProperties", name, more)
            yield "edge", cid, f"{cid}#additionalProperties", "", "HAS_VALUE_SCHEMA", ""
        for ref, via in references({k: v for k, v in body.items() if k not in COMPOSITION}):
            yield "edge", cid, target(ref), via, "REFERENCES", ""

    def resolved_once(x: Any) -> dict:
        x = x if isinstance(x, dict) else {}
        found = lookup(x["$ref"], spec) if isinstance(x.get("$ref"), str) else None
        return {**found, **{k: v for k, v in x.items() if k != "$ref"}} if isinstance(found, dict) else x

    def target(ref: str) -> str:
        parts = ref.split("/")
        return f"{provider}:{parts[-2] if len(parts) > 2 else 'schemas'}:{parts[-1]}"

    for name, body in schemas.items():
        yield from component(f"{provider}:schemas:{name}", name, body if isinstance(body, dict) else {})
    for path, item in (spec.get("paths") or {}).items():
        for method in METHODS:
            op = (item or {}).get(method)
            if not isinstance(op, dict):
                continue
            eid = f"{method.upper()}:{path}"
            yield "endpoint", eid, "", str(op.get("operationId") or ""), (op.get("tags") or ["uncategorised"])[0], canonical({"summary": op.get("summary") or "", "deprecated": bool(op.get("deprecated"))})
            merged = {(p.get("in"), p.get("name")): p for p in map(resolved_once, [*(item.get("parameters") or []), *(op.get("parameters") or [])])}
            for (where, name), p in merged.items():
                schema = p.get("schema") if isinstance(p.get("schema"), dict) else {}
                yield "parameter", f"{eid}#param:{where}:{name}", eid, str(name), str(where), canonical({"required": bool(p.get("required")), "type": schema.get("type") or "", "hint": parameter_hint(p), "enumValues": enum_texts(schema)})
            for site, rid, part in [("REQUEST", f"{eid}#requestBody", op.get("requestBody")), *[("RESPONSE", f"{eid}#response:{s}", r) for s, r in (op.get("responses") or {}).items()]]:
                for media, content in (resolved_once(part).get("content") or {}).items():
                    mid = f"{rid}:{media.replace('/', '~1').replace(':', '~3') or '_'}"
                    yield site.lower(), mid, eid, media, rid.rpartition(":")[2] if site == "RESPONSE" else "", ""
                    for ref, _ in references((content or {}).get("schema") or {}):
                        yield "edge", mid, target(ref), media, f"{site}_REFERENCES", ""


def decompose(specs: DataFrame) -> DataFrame:
    """Rows of all documents (provider, spec as JSON text); a document that can't be read gives a row of table ``failed``."""

    def work(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for provider, text in zip(frame["provider"], frame["spec"], strict=True):
                try:
                    out += [(provider, *r) for r in rows_of(provider, cleaned(strict_object(text)))]
                except (TypeError, ValueError, AttributeError) as e:
                    out.append((provider, "failed", hashlib.sha1(str(text).encode()).hexdigest(), "", "", type(e).__name__, str(e)[:300]))
            yield pd.DataFrame(out, columns=["provider", "table", "id", "parent", "name", "kind", "body"])

    return specs.select("provider", "spec").mapInPandas(work, "provider string, `table` string, id string, parent string, name string, kind string, body string")


def winners(rows: DataFrame) -> DataFrame:
    """Components with one body for each id: the longest, then the first by bytes; what a loser owns goes with it."""
    comps = rows.where("table = 'component'")
    return comps.groupBy("provider", "id").agg(F.max_by(F.struct("name", "kind", "body"), F.struct(F.length("body"), F.col("body"))).alias("w"), F.count_distinct("body").alias("n_bodies")).select("provider", "id", "w.*", "n_bodies")


def unresolved(rows: DataFrame) -> DataFrame:
    """Targets of edges that no component is, as placeholders."""
    ends = rows.where("table = 'edge' and kind <> 'HAS_PROPERTY'").select(F.col("parent").alias("id")).distinct()
    return ends.join(rows.where("table = 'component'").select("id"), "id", "left_anti").select("id", F.lit("unresolved").alias("kind"))


def lineage(rows: DataFrame) -> DataFrame:
    """One lineage row for each row and source, with a digest id."""
    key = F.concat_ws("|", "table", "id", "provider", "parent", "name", "kind")
    return rows.select("table", "id", "provider", F.concat_ws(":", "table", "id", F.substring(F.sha1(key), 1, 16)).alias("projection_id")).distinct()
