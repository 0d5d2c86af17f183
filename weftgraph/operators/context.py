"""Everything about one endpoint or schema as one row of nested lists, over tables of two stores; reports on how much is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(rows: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """key and ``name``: the rows of each key as an ordered list of structs, grouped with partial aggregation."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def assembled(base: DataFrame, key: str, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """base with one list column for each part (rows with ``key``, and the columns to keep); an absent list is empty."""
    out = base
    for name, (rows, columns) in parts.items():
        own = gathered(rows, key, name, *columns)
        out = out.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def endpoint_contexts(endpoints: DataFrame, parameters: DataFrame, bodies: DataFrame, responses: DataFrame, values: DataFrame, commands: DataFrame) -> DataFrame:
    """endpoints (endpoint_id, ...) with parameters, request_bodies, responses, value_paths and cli_commands as lists."""
    return assembled(endpoints, "endpoint_id", {
        "parameters": (parameters, ["name", "location", "component_id"]), "request_bodies": (bodies, ["content_type", "component_id"]),
        "responses": (responses, ["status", "content_type", "component_id"]), "value_paths": (values, ["yang_path"]), "cli_commands": (commands, ["command_name"]),
    })


def schema_contexts(components: DataFrame, properties: DataFrame, composition: DataFrame, values: DataFrame, references: DataFrame) -> DataFrame:
    """components (component_id, ...) with properties (their type and item schemas), composition, value_schemas and references."""
    return assembled(components, "component_id", {
        "properties": (properties, ["name", "type_component_id", "item_component_id"]), "composition": (composition, ["kind", "target_component_id"]),
        "value_schemas": (values, ["target_component_id"]), "references": (references, ["via", "target_component_id"]),
    })


def with_detail(rows: DataFrame, key: str, details: DataFrame, column: str) -> DataFrame:
    """rows with the other store's ``column`` as ``detail``; null where the target isn't there, not an error."""
    one = details.groupBy(key).agg(F.min(column).alias("detail"))
    return rows.join(one, key, "left")


def one(rows: DataFrame, what: str) -> DataFrame:
    """rows if there is exactly one; none, and more than one, is an error that says so, raised when the row is read."""
    told = F.when(F.col("n") == 0, F.lit(f"no such {what}")).otherwise(F.concat(F.col("n").cast("string"), F.lit(f" are such {what}: which is meant isn't clear")))
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*rows.columns)).alias("row"))
    return counted.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(told).cast(counted.schema["row"].dataType)).alias("row")).select("row.*")


def resolved_endpoint(endpoints: DataFrame, endpoint_id: str = "", path: str = "") -> DataFrame:
    """The endpoint with an id, else the GET endpoint of a path; an error for a miss."""
    if endpoint_id.strip():
        return one(endpoints.where(F.col("endpoint_id") == endpoint_id.strip()), f"endpoint as {endpoint_id.strip()}")
    if not path.strip():
        raise ValueError("an endpoint's id or path is needed")
    at = path.strip() if path.strip().startswith("/") else f"/{path.strip()}"
    return one(endpoints.where((F.col("path") == at) & (F.col("method") == "GET")), f"endpoint as GET {at}")


def _some(name: str) -> Column:
    return F.count_if(F.size(name) > 0).alias(f"with_{name}")


def endpoint_metrics(contexts: DataFrame) -> DataFrame:
    """One row: how many endpoints there are and how many have each list, a component of a body, and of a response."""
    lists = ["parameters", "request_bodies", "responses", "value_paths", "cli_commands"]
    typed = lambda name: F.count_if(F.exists(name, lambda x: F.coalesce(x["component_id"], F.lit("")) != "")).alias(f"with_typed_{name}")
    return contexts.agg(F.count(F.lit(1)).alias("endpoints"), *[_some(x) for x in lists], *[typed(x) for x in ("parameters", "request_bodies", "responses")])


def schema_metrics(contexts: DataFrame) -> DataFrame:
    lists = ["properties", "composition", "value_schemas", "references"]
    typed = F.count_if(F.exists("properties", lambda x: x["type_component_id"].isNotNull())).alias("with_typed_properties")
    items = F.count_if(F.exists("properties", lambda x: x["item_component_id"].isNotNull())).alias("with_item_schemas")
    return contexts.agg(F.count(F.lit(1)).alias("schemas"), *[_some(x) for x in lists], typed, items)


def traversal_report(contexts: DataFrame, key: str, limit: int, metric) -> DataFrame:
    """The metrics of the first ``limit`` contexts by key, and the share of those asked for that were there. The limit is the feature."""
    picked = contexts.orderBy(key).limit(limit)
    out = metric(picked)
    return out.withColumn("ok_ratio", F.round(F.try_divide(F.col(out.columns[0]).cast("double"), F.least(F.lit(limit), F.col(out.columns[0]))), 4))


def fts_to_endpoints(hits: DataFrame, owner: DataFrame, refers: DataFrame, composed: DataFrame, depth: int = 5) -> DataFrame:
    """(endpoint_id, component_id, score): endpoints that lead to the components that search hits belong to.

    hits: id, score; owner: id, component_id; refers: endpoint_id, component_id; composed: src, dst. A hit's components are
    few, so the walk goes from them, against composition, up to what endpoints name."""
    from weftgraph.operators.paths import hops

    found = hits.join(owner, "id").groupBy("component_id").agg(F.max("score").alias("score"))
    up = hops(composed.select(F.col("dst").alias("src"), F.col("src").alias("dst")), found.select(F.col("component_id").alias("node")), 0, depth)
    reach = up.select(F.col("seed").alias("component_id"), F.col("node").alias("named"))
    named = refers.select("endpoint_id", F.col("component_id").alias("named"))
    return found.join(reach, "component_id").join(named, "named").groupBy("endpoint_id", "component_id").agg(F.max("score").alias("score"))
