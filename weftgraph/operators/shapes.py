"""What a schema body is: its shape, kind, constraints, device types and hints, from the body alone."""

from __future__ import annotations

from typing import Any

UNIONS = {"oneOf": "union-oneOf", "anyOf": "union-anyOf", "allOf": "allOf-composite"}
#: The constraint keys that are kept as they are.
CONSTRAINTS = ["const", "default", "deprecated", "enum", "exclusiveMaximum", "exclusiveMinimum", "maxContains", "maximum", "maxItems", "maxLength", "maxProperties", "minContains", "minimum", "minItems", "minLength", "minProperties", "multipleOf", "nullable", "pattern", "readOnly", "required", "uniqueItems", "writeOnly", "x-enumDescriptions", "x-key"]
#: Names of filter, order and paging parameters.
FILTERS, ORDERS, PAGING = ["filter", "$filter"], ["orderby", "$orderby", "order_by"], ["limit", "offset", "page", "page_size"]


def _full(body: dict, key: str, kind: type) -> bool:
    return isinstance(body.get(key), kind) and bool(body[key])


def body_shape(body: Any) -> str:
    """primitive, union-oneOf, union-anyOf, allOf-composite, object, map or array: an enum is a leaf whatever wraps it."""
    if not isinstance(body, dict) or _full(body, "enum", list):
        return "primitive"
    union = next((label for key, label in UNIONS.items() if _full(body, key, list)), "")
    if union or _full(body, "properties", dict):
        return union or "object"
    more = body.get("additionalProperties")
    if more is True or isinstance(more, dict):
        return "map"
    return body["type"] if body.get("type") in ("object", "array") else "primitive"


def component_kind(body: Any) -> str:
    """primitive, union, object or array, in step with ``body_shape``; a map without a type is primitive."""
    if not isinstance(body, dict) or _full(body, "enum", list):
        return "primitive"
    if any(_full(body, key, list) for key in UNIONS):
        return "union"
    if body.get("type") == "object" or "properties" in body:
        return "object"
    return "array" if body.get("type") == "array" else "primitive"


def constraints(body: dict) -> dict:
    return {k: body[k] for k in CONSTRAINTS if k in body}


def device_types(body: Any) -> list[str] | None:
    """The device types that a body is for; None, not [], where it doesn't say."""
    if not isinstance(body, dict) or "x-supportedDeviceType" not in body:
        return None
    own = body["x-supportedDeviceType"]
    return [str(x) for x in own if x is not None] if isinstance(own, list) else [own] if isinstance(own, str) and own else []


def parameter_hint(parameter: dict) -> str:
    """rfc3339-*, odata-filter, odata-orderby, comma-list, pagination or nothing."""
    schema, name = parameter.get("schema") or {}, str(parameter.get("name") or "").lower()
    if schema.get("format") in ("date", "date-time"):
        return f"rfc3339-{schema['format']}"
    if name in FILTERS or "odata" in name:
        return "odata-filter"
    if name in ORDERS:
        return "odata-orderby"
    if schema.get("type") == "string" and ("csv" in name or name.endswith(("_list", "ids"))):
        return "comma-list"
    return "pagination" if name in PAGING else ""


def type_text(body: dict) -> str:
    """A schema's type: a list of types joined by ``|``, ``$ref`` for a reference, else what it says or nothing."""
    if "$ref" in body:
        return "$ref"
    own = body.get("type")
    return "|".join(map(str, own)) if isinstance(own, list) else str(own or "")


def enum_texts(body: Any) -> list[str]:
    own = body.get("enum") if isinstance(body, dict) else None
    return [x for x in own if isinstance(x, str)] if isinstance(own, list) else []


def inline_role(body: Any) -> str:
    """object, union, map or none: whether an inline schema becomes a component of its own."""
    shape = body_shape(body)
    return {"object": "object", "map": "map"}.get(shape, "union" if shape in UNIONS.values() else "none")


def type_pointer(schema: dict, pointer: str) -> str:
    """Where a property's type is said: the target of its reference, of its items' reference, its items, or itself."""
    ref, items = schema.get("$ref"), schema.get("items")
    if isinstance(ref, str):
        return ref.removeprefix("#")
    if isinstance(items, dict):
        return items["$ref"].removeprefix("#") if isinstance(items.get("$ref"), str) else f"{pointer}/items"
    return pointer


def is_reference_only(body: dict) -> bool:
    """A reference and nothing but notes beside it."""
    return "$ref" in body and all(k == "$ref" or k in ("description", "summary", "title") or k.startswith("x-") for k in body)


def in_example(parts: list[str]) -> bool:
    """Whether a pointer's parts lead into example or default data, which is no schema; names of users' own don't count."""
    for k, part in enumerate(parts):
        named = k and parts[k - 1] in ("properties", "patternProperties", "schemas", "parameters", "headers", "responses", "examples", "definitions", "$defs")
        if named:
            if part and parts[k - 1] == "examples" and parts[k + 1 : k + 2] == ["value"] and k + 2 < len(parts):
                return True
            continue
        if part in ("example", "default") and k + 1 < len(parts):
            return True
    return False
