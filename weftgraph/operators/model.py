"""Model identities of described schemas, parameter overrides, inherited properties and the check of inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACEHOLDER = r"\{([^{}]+)\}"


def identity_token(name: Column) -> Column:
    """Lower case, with each run of characters that aren't ASCII letters or digits as one dash; 'unnamed' if nothing is left or null."""
    token = F.lower(F.regexp_replace(F.regexp_replace(name, "[^0-9a-zA-Z]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("unnamed"))


def schema_identity(yang_path: Column, name: Column, pointer: Column) -> Column:
    """A schema's identity: its path in the device model, else its name, else its place in the document."""
    by_name = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("schema:"), identity_token(name)))
    return F.coalesce(F.when(yang_path != "", F.concat(F.lit("yang:"), yang_path)), by_name, F.concat(F.lit("schema-pointer:"), pointer))


def merge_models(nodes: DataFrame, key: str, ordinal: str, scalars: list[str], lists: list[str], flags: list[str]) -> DataFrame:
    """One row for each identity: scalars take the first value that is neither null nor empty, lists the distinct
    values in order of first appearance, flags whether any is true.

    Ties in ordinal are broken by the values. List elements are reduced to their first ordinal before they are
    gathered, so that an identity with very many nodes holds its distinct values only. Null keys are left out.
    """
    have = nodes.where(F.col(key).isNotNull())

    def first_of(c: str) -> Column:
        filled = F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.min(F.when(filled, F.struct(ordinal, c)))[c].alias(c)

    out = have.groupBy(key).agg(*[first_of(c) for c in scalars], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags], F.count(F.lit(1)).alias("n_nodes"))
    for c in lists:
        each = have.select(key, ordinal, F.posexplode(c).alias("__at", "__v")).where(F.col("__v").isNotNull())
        once = each.groupBy(key, "__v").agg(F.min(F.struct(ordinal, "__at")).alias("__o"))
        told = once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__v"))), lambda x: x["__v"]).alias(c))
        out = out.join(told, key, "left").withColumn(c, F.coalesce(c, F.array().cast(nodes.schema[c].dataType)))
    return out


def override_parameters(parameters: DataFrame, owner: str, level: str, ordinal: str) -> DataFrame:
    """parameters with one row for each (owner, name, location): the highest level wins, and the last of a level."""
    own = Window.partitionBy(owner, "name", "location").orderBy(F.col(level).desc(), F.col(ordinal).desc())
    return parameters.withColumn("__rank", F.row_number().over(own)).where("__rank = 1").drop("__rank")


def property_map(roots: DataFrame, composed: DataFrame, properties: DataFrame, depth: int = 5) -> DataFrame:
    """(root, name, property_id, depth): a root's property of each name, direct ones before inherited.

    roots(root), composed(src, dst), properties(parent, name, property_id). A component that is reached again is
    followed from its least depth; of equally deep properties the least property_id is taken.
    """
    level = roots.select("root", F.col("root").alias("at"), F.lit(0).alias("depth"))
    levels = [level]
    for d in range(1, depth + 1):
        level = level.join(composed, level["at"] == composed["src"]).select("root", F.col("dst").alias("at"), F.lit(d).alias("depth")).distinct()
        levels.append(level)
    reached = reduce(DataFrame.unionByName, levels).groupBy("root", "at").agg(F.min("depth").alias("depth"))
    named = properties.where(F.coalesce("name", F.lit("")) != "")
    found = reached.join(named, reached["at"] == named["parent"])
    return found.groupBy("root", "name").agg(F.min(F.struct("depth", "property_id")).alias("p")).select("root", "name", "p.property_id", "p.depth")


def missing_inputs(endpoints: DataFrame, parameters: DataFrame) -> DataFrame:
    """(endpoint_id, problem, name), distinct, of what a call lacks.

    endpoints(endpoint_id, path, query_names, path_names: names supplied) and parameters(endpoint_id, name, location,
    required). Placeholders of the path and required parameters have to be supplied; a required parameter
    elsewhere than in query and path can't be.
    """
    wanted = F.array_except(F.regexp_extract_all("path", F.lit(PLACEHOLDER), F.lit(1)), F.coalesce("path_names", F.array().cast("array<string>")))
    places = endpoints.select("endpoint_id", F.lit("missing path parameter").alias("problem"), F.explode(wanted).alias("name"))
    needed = parameters.where(F.col("required") & (F.coalesce("name", F.lit("")) != "")).select("endpoint_id", "name", F.lower(F.coalesce("location", F.lit(""))).alias("where"))
    told = needed.join(endpoints, "endpoint_id")

    def lacks(names: str) -> Column:
        return ~F.coalesce(F.array_contains(names, F.col("name")), F.lit(False))

    problem = (
        F.when((F.col("where") == "query") & lacks("query_names"), "missing query parameter")
        .when((F.col("where") == "path") & lacks("path_names"), "missing path parameter")
        .when(~F.col("where").isin("query", "path"), F.concat(F.lit("unsupported place: "), F.coalesce(F.nullif("where", F.lit("")), F.lit("unknown"))))
    )
    return places.unionByName(told.select("endpoint_id", problem.alias("problem"), "name").where("problem is not null")).distinct()
