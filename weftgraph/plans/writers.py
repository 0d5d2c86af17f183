"""Writers: rows in a table's types, and whole sets of node and edge tables written once each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructType

from weftgraph.plans.graph import PropertyGraph


def default_of(kind: DataType) -> Column:
    """What a missing value of a type is: empty text, an empty list, false; other types have null."""
    made = F.lit("") if isinstance(kind, StringType) else F.array() if isinstance(kind, ArrayType) else F.lit(False) if isinstance(kind, BooleanType) else F.lit(None)
    return made.cast(kind)


def typed_rows(rows: DataFrame, schema: StructType, keep_null: tuple[str, ...] = ()) -> DataFrame:
    """rows with exactly the schema's columns and types: missing columns and nulls have their type's default, but for those
    of keep_null, where null means something else than empty."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        out.append((c if f.name in keep_null else F.coalesce(c, default_of(f.dataType))).alias(f.name))
    return rows.select(*out)


def together(graphs: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Each table's rows of many graphs as one frame, so that a table is written once however many graphs there are."""
    names = sorted({n for g in graphs for n in g})
    return {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [g[n] for g in graphs if n in g]) for n in names}


def write_tables(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]]) -> DataFrame:
    """(table, n): every table written below path, one row for each of its keys, and how many rows there are.

    Of rows with equal keys the least stays, so that writing again gives the same tables."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        rest = [c for c in df.columns if c not in keys[name]]
        one = df.groupBy(*keys[name]).agg(F.min(F.struct(*rest)).alias("__v")).select(*keys[name], "__v.*") if rest else df.distinct()
        one.select(*df.columns).write.mode("overwrite").parquet(f"{path}/{name}")
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n")) for n in tables]
    return reduce(DataFrame.union, counts)


def only_new(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys a store doesn't hold, so that a run that is repeated adds nothing."""
    return rows.join(existing.select(*keys), keys, "left_anti")


def graph_of(nodes: dict[str, tuple[DataFrame, str]], edges: dict[str, tuple[DataFrame, str, str]]) -> PropertyGraph:
    """A property graph of written tables; tables that are there already are kept."""
    g = PropertyGraph()
    for label, (df, pk) in nodes.items():
        g.add_node(label, df, pk)
    for name, (df, src, dst) in edges.items():
        g.add_rel(name, df, src, dst)
    return g
