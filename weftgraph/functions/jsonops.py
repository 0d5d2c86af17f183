"""JSON in strings: canonical form, hashes, kinds, pointers and shredding."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(c: Column) -> Column:
    """Sorted keys, no white space; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(c))


def content_hash(c: Column, bits: int = 256) -> Column:
    return F.sha2(canonical(c), bits)


def value_kind(c: Column) -> Column:
    """null, boolean, number, string, array or object, of JSON text."""
    s = F.trim(c)
    return (
        F.when(s == "null", "null")
        .when(s.isin("true", "false"), "boolean")
        .when(s.startswith('"'), "string")
        .when(s.startswith("["), "array")
        .when(s.startswith("{"), "object")
        .otherwise("number")
    )


def pointer_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer_parts(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.substring(c, 2, 1 << 30), "/"), pointer_unescape))


def pointer_parent(c: Column) -> Column:
    return F.regexp_replace(c, "/[^/]*$", "")


def pointer_last(c: Column) -> Column:
    return pointer_unescape(F.regexp_extract(c, "/([^/]*)$", 1))


def _no_twice(pairs: list[tuple[str, Any]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise ValueError(f"member {k!r} is there twice")
        out[k] = v
    return out


def strict_object(text: str) -> dict:
    """A JSON object without a member twice; ValueError otherwise."""
    got = json.loads(text, object_pairs_hook=_no_twice)
    if not isinstance(got, dict):
        raise ValueError("the root is not an object")
    return got


def kind_of(x: Any) -> str:
    return "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, int | float) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def shred(text: str) -> Iterator[tuple[str, str, str, int, str, str]]:
    """(pointer, parent, key, index, kind, scalar) of every node of a JSON text, in document order; index -1 in objects."""
    todo: list[tuple[str, str, str, int, Any]] = [("", "", "", -1, json.loads(text))]
    while todo:
        pointer, parent, key, index, x = todo.pop()
        kind = kind_of(x)
        yield pointer, parent, key, index, kind, "" if kind in ("array", "object") else json.dumps(x, ensure_ascii=False)
        kids = x.items() if kind == "object" else enumerate(x) if kind == "array" else ()
        own = [(f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}", pointer, k if kind == "object" else "", k if kind == "array" else -1, v) for k, v in kids]
        todo += reversed(own)


def rebuild(rows: list[tuple[str, str, str, int, str, str]]) -> Any:
    """The value whose nodes ``shred`` gave, in any order of siblings' parents before children."""
    made: dict[str, Any] = {}
    for pointer, parent, key, index, kind, scalar in rows:
        x: Any = [] if kind == "array" else {} if kind == "object" else json.loads(scalar)
        made[pointer] = x
        if pointer:
            up = made[parent]
            if index >= 0:
                assert index == len(up)
                up.append(x)
            else:
                up[key] = x
    return made[""]


def shred_table(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """One row for each JSON node of each document; documents that aren't JSON give one row of kind ``invalid``."""

    def work(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for i, text in zip(frame["id"], frame["json"], strict=True):
                try:
                    rows += [(i, n, *node) for n, node in enumerate(shred(text))]
                except (TypeError, ValueError) as e:
                    rows.append((i, 0, "", "", "", -1, "invalid", str(e)[:200]))
            yield pd.DataFrame(rows, columns=["id", "ord", "pointer", "parent", "key", "idx", "kind", "scalar"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(json_col).alias("json")).mapInPandas(work, f"id {kind}, ord long, pointer string, parent string, key string, idx long, kind string, scalar string")


def fields(c: Column) -> Column:
    """The members of a JSON object as an array of (key, value as JSON text), sorted by key."""
    entries = F.map_entries(F.from_json(c, "map<string,string>"))
    return F.array_sort(entries)


def ascii(c: Column) -> Column:
    """JSON text with every letter beyond ASCII as an escape, in two halves beyond the basic plane."""

    def escape(x: Column) -> Column:
        code = _code(x)
        four = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
        high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(code < 128, x).when(code < 0x10000, four(code)).otherwise(F.concat(four(high), four(low)))

    return F.when(c.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(c, ""), escape), "")).otherwise(c)


def _code(x: Column) -> Column:
    """The code point of a letter."""
    return F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("int")


def quoted(c: Column) -> Column:
    """A text as a JSON string of ASCII."""
    body = F.to_json(F.struct(c.alias("x")))
    return ascii(F.substring(body, F.lit(6), F.length(body) - 6))


def each_document(docs: DataFrame, id_col: str, json_col: str, f: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """id_col, ``status``, ``message`` and the columns of schema: the rows that f gives for each document, batch by batch.

    A document that isn't a JSON object fails as ``validation``, one that f raises ValueError for as ``resolution``, any
    other error is ``unexpected``; such a document has one row, with nulls. Failures never end the job."""
    names = [x.strip().split()[0].strip("`") for x in schema.split(",")]
    kind = docs.schema[id_col].dataType.simpleString()

    def work(frames):
        import pandas as pd

        for frame in frames:
            out, none = [], (None,) * len(names)
            for i, text in zip(frame[id_col], frame[json_col], strict=True):
                try:
                    spec = strict_object(text)
                except (TypeError, ValueError) as e:
                    out.append((i, "validation", str(e)[:300], *none))
                    continue
                try:
                    out += [(i, "ok", "", *row) for row in f(spec)]
                except ValueError as e:
                    out.append((i, "resolution", str(e)[:300], *none))
                except Exception as e:  # noqa: BLE001  whatever a document does, the others go on
                    out.append((i, "unexpected", f"{type(e).__name__}: {e}"[:300], *none))
            yield pd.DataFrame(out, columns=[id_col, "status", "message", *names]).astype(object)

    return docs.select(id_col, json_col).mapInPandas(work, f"{id_col} {kind}, status string, message string, {schema}")


def decode_blob(c: Column) -> Column:
    """Text that may be stored as ``b64:`` and base64; what can't be decoded stays as it is, null is empty."""
    plain = F.call_function("try_validate_utf8", F.try_to_binary(F.substring(c, 5, 1 << 30), F.lit("base64")).cast("string"))
    return F.coalesce(F.when(c.startswith("b64:"), plain), c, F.lit(""))
