"""Governed delivery: caps on rows, cells and bytes, paging, freshness warnings, batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from decimal import Decimal
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalar import all_given

SOFT, HARD, CELL, BYTES, BATCH, PREVIEW = 200, 2000, 4096, 50_000, 25, 200


def cap_cell(c: Column, most: int = CELL) -> Column:
    """Text over ``most`` bytes becomes a JSON object with a preview and its size."""
    short = F.struct(F.lit(True).alias("_truncated"), F.substring(c, 1, PREVIEW).alias("preview"), F.octet_length(c).alias("size_bytes"))
    return F.when(F.octet_length(c) > most, F.to_json(short)).otherwise(c)


def cap_bytes(rows: DataFrame, order: Sequence[Column], text: Column, most: int) -> DataFrame:
    """The longest prefix in order whose text holds at most ``most`` bytes. For results already cut to HARD rows."""
    size = F.sum(F.octet_length(text)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running_bytes", size).where(F.col("running_bytes") <= most)


def cap_bytes_by_id(rows: DataFrame, id_col: str, text: Column, most: int, ranges: int = 1000, few: int = HARD) -> DataFrame:
    """cap_bytes over a table of any size in the order of a whole-number id, nulls last.

    Sizes are summed by ranges of ids; the one range that crosses the cap is split until it holds few rows, so that
    no task sorts more than a range.
    """
    own = rows.withColumn("__size", F.octet_length(text).cast("long"))
    lo, hi = own.agg(F.min(id_col), F.max(id_col)).first()
    lo, hi = (0, 0) if lo is None else (lo, hi + 1)  # null ids stand at hi
    own = own.withColumn("__k", F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(Decimal(hi))))
    parts, before = [], None  # before: bytes ahead of the range; none as long as every text is null
    while True:
        width = max(1, -(-(hi - lo + 1) // ranges))
        at = F.expr(f"(__k - cast('{lo}' as decimal(20,0))) div cast('{width}' as decimal(20,0))")
        sums = own.where(F.col("__k").between(F.lit(lo).cast("decimal(20,0)"), F.lit(Decimal(hi)))).groupBy(at.alias("at")).agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        crossing = None
        for r in sorted(sums):
            a, z = lo + r["at"] * width, min(hi, lo + (r["at"] + 1) * width - 1)
            if (before or 0) + (r["size"] or 0) > most:
                crossing = (a, z, r["n"])
                break
            parts.append((a, z, before))
            before = before if r["size"] is None else (before or 0) + r["size"]
        if crossing is None:
            break
        lo, hi, n = crossing
        if n <= few or width == 1:
            parts.append((lo, hi, before))
            break
    kept = rows.sparkSession.createDataFrame([(Decimal(a), Decimal(z), b) for a, z, b in parts], "__a decimal(20,0), __z decimal(20,0), __before long")
    w = Window.partitionBy("__a").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    got = own.join(F.broadcast(kept), F.col("__k").between(F.col("__a"), F.col("__z")))
    size = F.sum("__size").over(w)
    total = F.when(F.col("__before").isNull(), size).otherwise(F.col("__before") + F.coalesce(size, F.lit(0)))
    return got.withColumn("running_bytes", total).where(F.col("running_bytes") <= most).drop("__size", "__k", "__a", "__z", "__before")


def page(rows: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """A page with ``has_more``, from one row more than asked for."""
    got = rows.orderBy(*order).offset(offset).limit(size + 1)
    w = Window.orderBy(*order)
    n = got.withColumn("__n", F.row_number().over(w)).withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy()))
    return n.where(F.col("__n") <= size).withColumn("has_more", F.col("__all") > size).drop("__n", "__all")


def run(df: DataFrame, soft: int = SOFT, hard: int = HARD, cell: int = CELL, most: int = BYTES) -> dict[str, Any]:
    """A client's envelope: rows, how many, whether cut and why; at most hard + 1 rows reach the driver."""
    text = {c: cap_cell(F.col(f"`{c}`"), cell) for c, kind in df.dtypes if kind == "string"}
    got = df.withColumns(text).limit(hard + 1).collect() if text else df.limit(hard + 1).collect()
    if len(got) > hard:
        return {"error": f"over {hard} rows; add a LIMIT or a filter"}
    rows = [r.asDict(recursive=True) for r in got]
    out: dict[str, Any] = {"row_count": len(rows), "truncated": len(rows) > soft}
    rows, size, kept = rows[:soft], 2, 0
    for r in rows:
        size += len(json.dumps(r, indent=2, default=str).encode()) + 2
        if size > most:
            out |= {"truncated": True, "reason": f"over {most} bytes"}
            break
        kept += 1
    return out | {"rows": rows[:kept], "returned": kept}


def run_batch(items: Sequence[Any], one: Callable[[Any], dict[str, Any]], most: int = BATCH) -> dict[str, Any]:
    """Each item's envelope; an item that fails doesn't stop the others."""
    if not 0 < len(items) <= most:
        return {"error": f"a batch has 1 to {most} items"}
    out = []
    for item in items:
        try:
            out.append({"ok": True, **one(item)})
        except (ValueError, PySparkException) as e:
            out.append({"ok": False, "error": str(e)[:500]})
    return {"results": out, "ok": sum(r["ok"] for r in out), "failed": sum(not r["ok"] for r in out)}


def freshness_warnings(rows: DataFrame, label: Column, at: Column, as_of: Column, threshold_s: int = 900) -> DataFrame:
    """(label, rows_affected, never, max_age_s) of rows that are older than the threshold or have no time."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(at)
    old = rows.select(label.alias("label"), age.alias("age"), at.isNull().alias("none")).where((F.col("age") > threshold_s) | F.col("none"))
    return old.groupBy("label").agg(F.count(F.lit(1)).alias("rows_affected"), F.count_if("none").alias("never"), F.max("age").alias("max_age_s"))


def listed(rows: DataFrame, wanted: dict[str, object], order: Sequence[Column], limit: int, hidden: Sequence[str] = ()) -> DataFrame:
    """A reader's list: what is given of ``wanted`` filters, ``hidden`` columns stay back, and the first rows in order go."""
    return rows.where(all_given(wanted)).orderBy(*order).limit(limit).drop(*hidden)


# ---- guards and hints
WRITING = {"create", "merge", "set", "delete", "remove"}
FORBIDDEN = {"drop", "alter", "load", "copy", "install", "call", "attach", "import", "export"}
#: Sets of labels and relationships that one purpose needs.
VIEWS: dict[str, set[str]] = {}


def write_problem(text: str) -> str | None:
    """Why a statement isn't one that writes: it defines or loads, or changes nothing; None if it may run."""
    words = {w.lower() for w in re.findall(r"[A-Za-z_]+", re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "", text))}
    if bad := sorted(words & FORBIDDEN):
        return f"{bad[0].upper()} is not allowed"
    return None if words & WRITING else "it changes nothing: CREATE, MERGE, SET, DELETE or REMOVE is needed"


def literal(text: str) -> str:
    """A text as a literal of the query language."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def alias_labels(text: str) -> dict[str, str]:
    """The first label of each named node of a query."""
    out: dict[str, str] = {}
    for alias, label in re.findall(r"\(\s*([A-Za-z_]\w*)\s*:\s*([A-Za-z_]\w*)", text):
        out.setdefault(alias, label)
    return out


def view_problem(view: str, text: str) -> str | None:
    """Why a query isn't one of a view: a label or relationship that the view lacks."""
    if view not in VIEWS:
        return f"there is no view {view}; they are {', '.join(sorted(VIEWS))}"
    used = set(re.findall(r"[(\[]\s*\w*\s*:\s*([A-Za-z_]\w*)", text)) | set(re.findall(r"\|\s*:?\s*([A-Za-z_]\w*)", text))
    return f"{min(used - VIEWS[view])} is not in {view}" if used - VIEWS[view] else None


def fetch_batch(rows: DataFrame, pk: str, ids: Sequence[object], most: int = BATCH) -> DataFrame:
    """A row for each id asked for, in order, with ``found``; one join however many ids there are. Over ``most`` ids is an error."""
    if not 0 < len(ids) <= most:
        raise ValueError(f"1 to {most} ids are needed, not {len(ids)}")
    asked = rows.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{pk} {rows.schema[pk].dataType.simpleString()}, __n int")
    out = F.broadcast(asked).join(rows.withColumn("found", F.lit(True)), pk, "left")  # at most ``most`` rows
    return out.withColumn("found", F.coalesce("found", F.lit(False))).orderBy("__n").drop("__n")


def error_hint(status: Column, message: Column, scopes: Column, similar: Column) -> Column:
    """What a failed call should try: a scope, a path that is like the wrong one, or its parameters; '' where nothing is known."""
    low = F.lower(F.coalesce(message, F.lit("")))
    like = F.array_join(F.slice(similar, 1, 3), ", ")
    return (
        F.when((status == 403) | low.contains("scope"), F.concat(F.lit("check the scope: "), F.array_join(scopes, ", ")))
        .when((status == 404) & (F.size(similar) > 0), F.concat(F.lit("no such path; like it are "), like))
        .when(status == 404, "no such path")
        .when(status == 400, "check the parameters")
        .otherwise("")
    )


def validation_text(errors: Sequence[str], warnings: Sequence[str], known: Sequence[str]) -> str:
    """What is wrong with a call, and which fields there are."""
    out = [*[f"- error: {e}" for e in errors], *[f"- warning: {w}" for w in warnings]]
    return "\n".join([f"{len(errors)} errors, {len(warnings)} warnings", *out, f"fields: {', '.join(known)}" if known else "fields: none are known"])
