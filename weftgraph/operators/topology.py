"""Network maps: link aggregation, ends that are managed or not, precedence, quality and path trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate_links(links: DataFrame, src: str, dst: str, first: dict[str, str], listed: dict[str, str], last: dict[str, str], order: Column) -> DataFrame:
    """One row for each pair: first values, ordered comma-joined lists and last non-empty values."""
    cols = [F.min_by(F.col(c), order).alias(n) for n, c in first.items()]
    cols += [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(c).cast("string").alias("v")))), lambda x: x["v"]), ",").alias(n) for n, c in listed.items()]
    cols += [F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), order)).alias(n) for n, c in last.items()]
    return links.groupBy(src, dst).agg(*cols, F.count(F.lit(1)).alias("n_links"))


def split_managed(links: DataFrame, prefix: str = "tpd_") -> DataFrame:
    """Links with ``target`` (managed or unmanaged), turned so that a managed end comes first; both unmanaged go."""
    a, b = F.col("src").startswith(prefix), F.col("dst").startswith(prefix)
    turned = links.where(~(a & b)).withColumn("__s", F.when(a, F.col("dst")).otherwise(F.col("src"))).withColumn("__d", F.when(a, F.col("src")).otherwise(F.col("dst")))
    return turned.withColumn("target", F.when(a | b, "unmanaged").otherwise("managed")).withColumn("src", F.col("__s")).withColumn("dst", F.col("__d")).drop("__s", "__d")


def by_precedence(rows: DataFrame, keys: Sequence[str], value: str, scope: str, order: Sequence[str]) -> DataFrame:
    """Each key's value from the scope that comes first in order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(scope))
    return rows.where(rank > 0).groupBy(*keys).agg(F.min_by(F.struct(value, scope), F.struct(rank, F.col(value))).alias("v")).select(*keys, f"v.{value}", f"v.{scope}")


def weak_links(links: DataFrame) -> DataFrame:
    """Links without a LAG, in bad health, or not forwarding, with the reason."""
    reason = F.when(F.coalesce("lag", F.lit("")) == "", "no_lag").when(~F.coalesce("health", F.lit("")).isin("", "Good"), "health").when(~F.coalesce("stp", F.lit("")).isin("", "FORWARDING"), "stp")
    return links.withColumn("reason", reason).where(F.col("reason").isNotNull())


def undirected(links: DataFrame, order: Column) -> DataFrame:
    """A simple graph: one edge for each pair of ends, the last by order; loops go."""
    rest = [c for c in links.columns if c not in ("src", "dst")]
    own = links.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), order.alias("__o"), *rest)
    best = own.groupBy("a", "b").agg(F.max_by(F.struct(*rest, F.lit(1).alias("__one")), F.col("__o")).alias("v"))
    return best.select(F.col("a").alias("src"), F.col("b").alias("dst"), "v.*").drop("__one")


def path_tree(rows: DataFrame, path: str, method: str, deprecated: Column) -> DataFrame:
    """(prefix, depth, n_paths, methods, deprecated) of every prefix of every path."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    each = rows.select(parts.alias("p"), F.col(method).alias("m"), deprecated.alias("d")).where(F.size("p") > 0)
    every = each.select(F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"), "p", "m", "d")
    prefix = F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/"))
    return every.groupBy(prefix.alias("prefix"), "depth").agg(F.count(F.lit(1)).alias("n_paths"), F.array_join(F.array_sort(F.collect_set("m")), ",").alias("methods"), F.bool_or("d").alias("deprecated"))


def levels(jobs: DataFrame, needs: DataFrame, most: int = 1000) -> list[str]:
    """Job names in an order that respects needs (job, needs); by name where there is a cycle. Jobs are a few scripts."""
    import graphlib

    names = sorted(r[0] for r in jobs.select("job").collect())
    of: dict[str, set[str]] = {n: set() for n in names}
    for a, b in needs.select("job", "needs").collect():
        if a in of and b in of:
            of[a].add(b)
    try:
        sorter, out = graphlib.TopologicalSorter(of), []
        sorter.prepare()
        while sorter.is_active():
            ready = sorted(sorter.get_ready())
            out += ready
            sorter.done(*ready)
        return out
    except graphlib.CycleError:
        return names


def rendered_trees(endpoints: DataFrame) -> DataFrame:
    """(category, text): each category's endpoints (method, path, category, deprecated) as an indented tree.

    A branch that leads to one branch only is on one line with it; an endpoint's line has its methods, sorted, and ``!`` if
    any of them is deprecated. A category's tree is one text, made in one task from its distinct paths."""
    per = endpoints.groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("(uncategorised)")).alias("category"), "path").agg(F.array_join(F.array_sort(F.collect_set(F.upper("method"))), ",").alias("methods"), F.bool_or(F.coalesce("deprecated", F.lit(False))).alias("deprecated"))

    def work(frame):
        import pandas as pd

        root: dict = {}
        ends: dict[tuple, str] = {}
        for path, methods, old in zip(frame["path"], frame["methods"], frame["deprecated"], strict=True):
            at, parts = root, tuple(p for p in path.split("/") if p)
            for p in parts:
                at = at.setdefault(p, {})
            ends[parts] = f"[{methods}]{' !' if old else ''}"
        name = frame["category"].iloc[0]
        lines = [f"## {name} ({len(frame)})"]
        todo = [((k,), 0) for k in sorted(root, reverse=True)]
        while todo:
            parts, depth = todo.pop()
            at = root
            for p in parts:
                at = at[p]
            label = [parts[-1]]
            while len(at) == 1 and parts not in ends:
                (k,) = at
                parts, at = (*parts, k), at[k]
                label.append(k)
            lines.append("  " * depth + "/".join(label) + (f"  {ends[parts]}" if parts in ends else "/"))
            todo += [((*parts, k), depth + 1) for k in sorted(at, reverse=True)]
        return pd.DataFrame([(name, "\n".join(lines))], columns=["category", "text"])

    return per.groupBy("category").applyInPandas(work, "category string, text string")
