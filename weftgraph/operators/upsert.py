"""Changes to node and edge tables, each a new DataFrame: upserts, deletions, richest-wins merges, variants."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """Rows of new replace those of old with their keys; columns in keep_first keep an old value that isn't null."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    if keep_first:
        had = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep_first])
        new = new.join(had, list(keys), "left")
        new = new.withColumns({c: F.coalesce(f"__old_{c}", c) for c in keep_first}).drop(*[f"__old_{c}" for c in keep_first])
    return kept.unionByName(new.select(*old.columns), allowMissingColumns=True)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """At most one edge for each pair; old ones stay."""
    return old.unionByName(new.join(old, ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"]), allowMissingColumns=True)


def detach_delete(nodes: DataFrame, pk: str, gone: DataFrame, edges: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """nodes without the keys of gone (column pk), and every edge table without edges at them."""
    left = nodes.join(gone.select(pk), pk, "left_anti")
    out = {}
    for name, e in edges.items():
        for end in ("src", "dst"):
            e = e.join(gone.select(F.col(pk).alias(end)), end, "left_anti")
        out[name] = e
    return left, out


def owned_by(keys: DataFrame, pk: str, root: str) -> DataFrame:
    """The root's key and those of what it owns: the key itself or one that starts with it and '#'."""
    return keys.where((F.col(pk) == root) | F.col(pk).startswith(root + "#")).select(pk)


def richest(rows: DataFrame, keys: Sequence[str], richness: Column, ties: Sequence[Column]) -> DataFrame:
    """The richest row of each key; among equals the one with the greatest ties, in order.

    A partial aggregate finds it, so that a hot key's rows are neither sorted nor brought together."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(richness.alias("r"), *[t.alias(f"t{i}") for i, t in enumerate(ties)])).alias("__v"))
    return best.select(*keys, "__v.*").select(*rows.columns)


def merge_outcomes(rows: DataFrame, keys: Sequence[str], richness: Column, order: Sequence[Column]) -> DataFrame:
    """rows with ``outcome``: new, replaced or skipped, as they would be on arrival in order."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(richness).over(before)
    return rows.withColumn("outcome", F.when(best.isNull(), "new").when(richness > best, "replaced").otherwise("skipped"))


def variant_ids(rows: DataFrame, keys: Sequence[str], body: str, base_id: Column) -> DataFrame:
    """rows with ``variant_id``: the richest body of a key has the base id, others ``@`` and 12 digits of their SHA-1.

    The richest body's length and digest, not bodies, are aggregated and joined back; null keys are keys like others."""
    digest = F.sha1(F.col(body))
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.length(body), digest)).alias("__best")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    own = F.struct(F.length(body), digest)
    out = rows.join(best, on, "left").withColumn("variant_id", F.when(own.eqNullSafe(F.col("__best")), base_id).otherwise(F.concat(base_id, F.lit("@"), F.substring(digest, 1, 12))))
    return out.select(*rows.columns, "variant_id")


def unique_names(rows: DataFrame, base: str, order: Sequence[Column], buckets: int = 64) -> DataFrame:
    """rows with ``name``: base, base_2, base_3, ... in order of one column.

    Rows of a base are dealt to ranges of the order's values (quantiles of a sketch), numbered range by range, and start
    where those before end, so that a base that most rows have is numbered in many tasks."""
    (by,) = order
    dealt = rows.withColumn("__o", by)
    cuts = dealt.groupBy(base).agg(F.percentile_approx("__o", [k / buckets for k in range(1, buckets)], 1000).alias("__cuts")).withColumnRenamed(base, "__base")
    dealt = dealt.join(cuts, F.col(base).eqNullSafe(F.col("__base")), "left").withColumn("__b", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__o"))), F.lit(0))).drop("__cuts", "__base")
    sizes = dealt.groupBy(F.col(base).alias("__base"), F.col("__b").alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__base").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__base", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(base, "__b").orderBy("__o")))
    n = F.col("__start") + F.col("__r")
    joined = ranked.join(starts, F.col(base).eqNullSafe(F.col("__base")) & (F.col("__b") == F.col("__bucket")))
    return joined.withColumn("name", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), n.cast("string")))).select(*rows.columns, "name")


def replace_all(old: DataFrame, new: DataFrame, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """new in place of old, with carried columns of the old rows of the same keys where the new ones are null."""
    had = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in carried])
    out = new.join(had, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, f"__old_{c}") for c in carried}).select(*new.columns)
