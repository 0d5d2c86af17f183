"""Normalised and projected API documents: noise out, repeats into components, and what one operation is about.

A document's tree is small and recursive, so that one document is one call; documents are rows, handled batch by batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from copy import deepcopy
from typing import Any

from weftgraph.operators.decompose import canonical, digest, expand, lookup

#: Methods, statuses, thresholds and the keys that hold prose or lead to it.
METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]
ERRORS = ["400", "401", "403", "404", "405", "409", "422", "429", "500", "502", "503", "504"]
SUCCESS = ["200", "201", "204", "202"]
MEDIA = ["application/json", "application/merge-patch+json"]
PROSE = ["description", "title", "summary", "example", "examples", "x-typeName", "x-typeDescription", "x-patternSources"]
LEADS = ["schema", "items", "allOf", "oneOf", "anyOf", "additionalProperties"]
LONG_SOURCES, LONG_REPEAT, NO_LIMIT, REPEATS, LEAST_PROPERTIES, PASSES = 4, 200, 9999, 2, 3, 8
_EITHER = re.compile(r"either\s+`?(?P<a>[\w-]+)`?\s+or\s+`?(?P<b>[\w-]+)", re.IGNORECASE | re.ASCII)


def nodes(x: Any) -> Iterator[dict]:
    """Every object in x, outer ones first."""
    todo = [x]
    while todo:
        at = todo.pop()
        if isinstance(at, dict):
            yield at
            todo += reversed(list(at.values()))
        elif isinstance(at, list):
            todo += reversed(at)


def strip_noise(spec: dict) -> None:
    """Drops type descriptions that repeat the description, long pattern sources, the format const, and a length of no limit."""
    for n in nodes(spec):
        told, said = n.get("x-typeDescription"), n.get("description")
        noise = {
            "x-typeDescription": isinstance(told, str) and isinstance(said, str) and told.strip() == said.strip() and len(told) <= LONG_REPEAT,
            "x-patternSources": isinstance(n.get("x-patternSources"), list) and len(n["x-patternSources"]) > LONG_SOURCES,
            "format": n.get("format") == "const",
            "maxLength": n.get("maxLength") == NO_LIMIT,
        }
        for key, out in noise.items():
            if out:
                n.pop(key, None)


def mark_exclusive(spec: dict) -> None:
    """``x-mutually-exclusive`` for "either a or b" in a description whose schema has both properties."""
    parts = [*(spec.get("paths") or {}).values(), *[b for section in ("schemas", "responses") for b in ((spec.get("components") or {}).get(section) or {}).values()]]
    for n in nodes(parts):
        m = _EITHER.search(n["description"]) if isinstance(n.get("description"), str) else None
        own = n.get("properties")
        if m and isinstance(own, dict) and m["a"] in own and m["b"] in own:
            n.setdefault("x-mutually-exclusive", [m["a"], m["b"]])


def operations(spec: dict) -> Iterator[tuple[str, str, dict]]:
    for path, item in (spec.get("paths") or {}).items():
        for method, op in (item.items() if isinstance(item, dict) else ()):
            if method.lower() in METHODS and isinstance(op, dict):
                yield path, method.lower(), op


def _is_error(status: str) -> bool:
    return status in ERRORS or (status[:1] in ("4", "5") and status.upper().endswith("XX"))


def _unused(name: str, taken: dict) -> str:
    return name if name not in taken else next(c for k in range(2, 10**9) if (c := f"{name}_{k}") not in taken)


def share_errors(spec: dict) -> None:
    """Equal inline error responses that occur twice become one component, named by their most common status."""
    shelf = spec["components"]["responses"]
    found: dict[str, list[tuple[dict, str]]] = {}
    for _, _, op in operations(spec):
        own = op.get("responses") or {}
        for status, body in own.items():
            if isinstance(body, dict) and "$ref" not in body and _is_error(str(status)):
                found.setdefault(digest(body), []).append((own, status))
    for key, places in found.items():
        if len(places) >= REPEATS:
            status = Counter(str(s) for _, s in places).most_common(1)[0][0]
            name = _unused(f"Error{status}_{key[:8]}", shelf)
            own, first = places[0]
            shelf[name] = own[first]
            for own, s in places:
                own[s] = {"$ref": f"#/components/responses/{name}"}


def share_objects(spec: dict) -> int:
    """Equal inline objects of three properties or more that occur twice become one component; again until none is left."""
    shelf = spec["components"]["schemas"]
    for turn in range(PASSES):
        found: dict[str, list[tuple[Any, Any]]] = {}
        todo = [(op[k], op, k) for _, _, op in operations(spec) for k in ("requestBody", "responses", "parameters") if k in op] + [(v, None, None) for v in shelf.values()]
        todo.reverse()
        while todo:
            at, up, key = todo.pop()
            if isinstance(at, dict):
                if "$ref" in at:
                    continue
                if up is not None and at.get("type") == "object" and isinstance(at.get("properties"), dict) and len(at["properties"]) >= LEAST_PROPERTIES:
                    found.setdefault(digest(at), []).append((up, key))
            below = at.items() if isinstance(at, dict) else enumerate(at) if isinstance(at, list) else ()
            todo += reversed([(v, at, k) for k, v in below])
        repeated = {h: p for h, p in found.items() if len(p) >= REPEATS}
        if not repeated:
            return turn
        for h, places in repeated.items():
            up, key = places[0]
            body = up[key]
            said = re.sub(r"\W", "", str(body.get("title") or body.get("x-typeName") or "Shape"), flags=re.ASCII) or "Shape"
            name = _unused(f"{said}_{h[:8]}", shelf)
            shelf[name] = deepcopy(body)
            for up, key in places:
                up[key] = {"$ref": f"#/components/schemas/{name}"}
    return PASSES


def normalised(spec: dict) -> dict:
    out = deepcopy(spec)
    shelf = out.setdefault("components", {})
    shelf.setdefault("schemas", {})
    shelf.setdefault("responses", {})
    for step in (strip_noise, mark_exclusive, share_errors, share_objects):
        step(out)
    return out


# ---- resolution
def richest(ref: str, *scopes: dict) -> Any:
    """What a component reference names in the scope that says most about it, by the length of its JSON; None if none does."""
    found = [t for s in scopes if s and (t := lookup(ref, {"components": s})) is not None] if ref.startswith("#/components/") else []
    return max(found, key=lambda t: len(canonical(t)), default=None)


def property_schema(body: Any, *scopes: dict) -> dict:
    """A property's schema with one level of reference resolved, in its own scope and then the provider's."""
    body = body if isinstance(body, dict) else {}
    target = richest(body["$ref"], *scopes) if isinstance(body.get("$ref"), str) else None
    return {**target, **{k: v for k, v in body.items() if k != "$ref"}} if isinstance(target, dict) else body


def reached(payload: Any, *scopes: dict) -> dict:
    """The components that payload needs, by section and name, those that they need included."""
    out: dict[str, dict] = {}
    todo, seen = [r for r, _ in _all_references(payload)], set()
    while todo:
        ref = todo.pop()
        parts = ref.removeprefix("#/components/").split("/")
        if ref in seen or not ref.startswith("#/components/") or len(parts) < 2:
            continue
        seen.add(ref)
        if (target := richest(ref, *scopes)) is not None:
            out.setdefault(parts[0], {})[parts[1]] = target
            todo += [r for r, _ in _all_references(target)]
    return out


def _all_references(x: Any) -> Iterator[tuple[str, str]]:
    yield from ((n["$ref"], "") for n in nodes(x) if isinstance(n.get("$ref"), str))


def media_schema(content: Any) -> tuple[str, Any]:
    """(media, schema) of a body: JSON first, merge patches next, else the first."""
    if not isinstance(content, dict) or not content:
        return "", None
    media = next((m for m in MEDIA if m in content), next(iter(content)))
    return media, (content[media] or {}).get("schema")


def success_response(responses: dict) -> tuple[str, Any]:
    """(status, response) of success: 200, 201, 204 or 202, else the first 2xx; ('', None) for none."""
    status = next((s for s in SUCCESS if s in responses), next((s for s in responses if str(s).startswith("2")), None))
    return ("", None) if status is None else (str(status), responses[status])


def first_error(responses: dict) -> dict | None:
    """The first error response that is a reference."""
    for status, body in responses.items():
        s = str(status)
        if s[:1] in ("4", "5") and isinstance(body, dict) and "$ref" in body:
            return {"status": s, "$ref": body["$ref"]}
    return None


def required_leaves(schema: Any, prefix: str = "", must: bool = True) -> list[str]:
    """Dotted paths of what has to be given, required properties first and then those within optional ones; [] for items."""
    if not isinstance(schema, dict):
        return []
    own = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    need = [n for n in (schema.get("required") or []) if isinstance(n, str)] if isinstance(schema.get("required") or [], list) else []

    def below(name: str) -> list[str]:
        child, path = own.get(name), f"{prefix}.{name}" if prefix else name
        if isinstance(child, dict) and child.get("type") == "object":
            return required_leaves(child, path)
        if isinstance(child, dict) and child.get("type") == "array" and isinstance(child.get("items"), dict):
            return required_leaves(child["items"], f"{path}[]")
        return []

    told = [p for n in need for p in (below(n) or [f"{prefix}.{n}" if prefix else n])]
    return told + [p for n in own if n not in need for p in below(n)]


# ---- projections of one operation
def without_prose(x: Any) -> Any:
    """x without keys that hold prose; names of properties are names, whatever they are."""
    if isinstance(x, list):
        return [without_prose(v) for v in x]
    if not isinstance(x, dict):
        return x
    return {k: ({n: without_prose(v) for n, v in own.items()} if k in ("properties", "patternProperties") and isinstance(own, dict) else without_prose(own)) for k, own in x.items() if k not in PROSE}


def prose(x: Any) -> Any:
    """The prose of x alone, lists keeping their places; None for none."""
    if isinstance(x, list):
        found = [prose(v) for v in x]
        return found if any(v is not None for v in found) else None
    if not isinstance(x, dict):
        return None
    out: dict[str, Any] = {}
    for k, v in x.items():
        if k in PROSE:
            if (v.strip() if isinstance(v, str) else v) not in ("", [], {}, ()):
                out[k] = v
        elif k in ("properties", "patternProperties") and isinstance(v, dict):
            if inner := {n: p for n, own in v.items() if (p := prose(own))}:
                out[k] = inner
        elif k in LEADS and (p := prose(v)):
            out[k] = p
    return out or None


def index_entry(body: Any) -> dict:
    """A component in brief: type, format, enum, required names, which unions it has, its items' and all its references."""
    if not isinstance(body, dict):
        return {}
    out = {k: body[k] for k in ("type", "format") if k in body}
    out |= {k: body[k] for k in ("enum",) if isinstance(body.get(k), list) and body[k]}
    if isinstance(body.get("required"), list) and body["required"]:
        out["required"] = [r for r in body["required"] if isinstance(r, str)]
    out |= {k: True for k in ("oneOf", "anyOf", "allOf") if isinstance(body.get(k), list) and body[k]}
    if body.get("type") == "array" and isinstance(body.get("items"), dict) and "$ref" in body["items"]:
        out["items_ref"] = body["items"]["$ref"]
    if refs := sorted({r for r, _ in _all_references(body)}):
        out["child_refs"] = refs
    return out


def _operation(spec: dict, method: str, path: str) -> dict | None:
    item = (spec.get("paths") or {}).get(path)
    op = item.get(method.lower()) if isinstance(item, dict) else None
    return op if isinstance(op, dict) else None


def _needed(spec: dict, op: dict) -> dict:
    return reached([op.get("parameters") or [], op.get("requestBody"), op.get("responses") or {}], spec.get("components") or {})


def skeleton(spec: dict, method: str, path: str) -> dict | None:
    """An operation's structure without prose: parameters, body, success, first error, required leaves, components in brief."""
    op = _operation(spec, method, path)
    if op is None:
        return None
    shelf = spec.get("components") or {}
    parameters = [property_schema(p, shelf) for p in op.get("parameters") or []]
    body_media, body = media_schema((op.get("requestBody") or {}).get("content"))
    status, answer = success_response(op.get("responses") or {})
    answer = property_schema(answer, shelf) if answer else {}
    answer_media, answer_schema = media_schema(answer.get("content"))
    brief = {section: {n: index_entry(b) for n, b in own.items()} for section, own in _needed(spec, op).items()}
    out = {
        "method": method.upper(), "path": path, "summary": op.get("summary") or "", "operation_id": op.get("operationId") or "", "deprecated": bool(op.get("deprecated")),
        "parameters": [without_prose(p) for p in parameters], "request_body": {"content_type": body_media, "schema": without_prose(body)} if body is not None else None,
        "required_paths": required_leaves(expand(body, {"components": shelf})) if body is not None else [],
        "success": {"status": status, "content_type": answer_media, "schema": without_prose(answer_schema)}, "first_error": first_error(op.get("responses") or {}), "components_index": brief,
    }
    return {k: v for k, v in out.items() if v is not None}


def components(spec: dict, method: str, path: str) -> dict | None:
    """The components that an operation needs, whole, and in brief."""
    op = _operation(spec, method, path)
    if op is None:
        return None
    side = _needed(spec, op)
    return {"method": method.upper(), "path": path, "components": side, "index": {s: {n: index_entry(b) for n, b in own.items()} for s, own in side.items()}}


def glossary(spec: dict, method: str, path: str) -> dict | None:
    """An operation's prose: its own, its parameters' with their place, and that of the schemas that it reaches."""
    op = _operation(spec, method, path)
    if op is None:
        return None
    shelf = spec.get("components") or {}
    out: dict[str, Any] = {"method": method.upper(), "path": path}
    if isinstance(op.get("description"), str) and op["description"].strip():
        out["description"] = op["description"]
    resolved = [richest(p["$ref"], shelf) or p if isinstance(p, dict) and "$ref" in p else p for p in op.get("parameters") or []]
    told = {p["name"]: {**said, "in": p.get("in") or ""} for p in resolved if isinstance(p, dict) and isinstance(p.get("name"), str) and p["name"] and (said := prose(p))}
    if told:
        out["parameters"] = told
    parts = {n: p for n, b in _needed(spec, op).get("schemas", {}).items() if (p := prose(b))}
    _, body = media_schema((op.get("requestBody") or {}).get("content"))
    if isinstance(body, dict) and "$ref" not in body and (p := prose(body)):
        parts["requestBody"] = p
    return {**out, "components": parts}


def parse_operation(spec: dict, path: str, method: str) -> dict | None:
    """An operation with its references inline: parameters, JSON body (JSON, merge patch, else the first), JSON responses."""
    op = _operation(spec, method, path)
    if op is None:
        return None
    root = {"components": spec.get("components") or {}}
    full: Callable[[Any], Any] = lambda x: expand(x, root)
    media, body = media_schema(full(op.get("requestBody") or {}).get("content"))
    answers = {str(s): (full(r).get("content") or {}).get("application/json", {}).get("schema") for s, r in (op.get("responses") or {}).items() if isinstance(r, dict)}
    return {"method": method.upper(), "path": path, "operationId": op.get("operationId") or "", "parameters": full(op.get("parameters") or []), "body_media": media, "body": body, "responses": answers}


