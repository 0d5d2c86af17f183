"""Invariants, parity, coverage and gates: each check is one plan over the tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalar import ratio


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(nodes: DataFrame, pk: str, edges: DataFrame, end: str = "dst") -> DataFrame:
    """Nodes at which no edge ends."""
    return nodes.join(edges.select(F.col(end).alias(pk)), pk, "left_anti")


def inconsistent(children: DataFrame, pk: str, parent: str, edges: DataFrame) -> DataFrame:
    """Children whose parent column has no edge (src parent, dst child)."""
    on = edges.select(F.col("src").alias(parent), F.col("dst").alias(pk))
    return children.where(F.col(parent).isNotNull()).join(on, [parent, pk], "left_anti")


def not_exactly_one(nodes: DataFrame, pk: str, edges: DataFrame, end: str = "dst") -> DataFrame:
    """Nodes with another number of edges than one, with n."""
    n = edges.groupBy(F.col(end).alias(pk)).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(n, pk, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where("n <> 1")


def report(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(invariant, n, sample): each check's violations and its smallest key, in one job; n 0 where it holds."""
    each = [df.agg(F.count(F.lit(1)).alias("n"), F.min(key.cast("string")).alias("sample")).select(F.lit(name).alias("invariant"), "n", "sample") for name, (df, key) in checks.items()]
    return reduce(DataFrame.union, each)


def assert_holds(checks: dict[str, tuple[DataFrame, Column]]) -> None:
    bad = report(checks).where("n > 0").collect()
    if bad:
        raise AssertionError("; ".join(f"{r['invariant']}: {r['n']}, as {r['sample']}" for r in bad))


def parity(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(n_ours, n_theirs, n_missing, n_extra, coverage) of two key sets; coverage is 1 where there is nothing to cover."""
    a = theirs.select(F.col(key).alias("k")).distinct().withColumn("t", F.lit(1))
    b = ours.select(F.col(key).alias("k")).distinct().withColumn("o", F.lit(1))
    both = a.join(b, "k", "full")
    c = F.count
    out = both.agg(c("o").alias("n_ours"), c("t").alias("n_theirs"), F.count_if(F.col("o").isNull()).alias("n_missing"), F.count_if(F.col("t").isNull()).alias("n_extra"))
    return out.withColumn("coverage", ratio(F.col("n_theirs") - F.col("n_missing"), F.col("n_theirs"), 1.0))


def alias_equivalent(missing: DataFrame, ours: DataFrame, key: str) -> DataFrame:
    """Missing keys that are there once variant suffixes are taken off."""
    bare = lambda c: F.regexp_replace(c, "@[0-9a-f]{12}", "")
    return missing.withColumn("__b", bare(F.col(key))).join(ours.select(bare(F.col(key)).alias("__b")), "__b", "left_semi").drop("__b")


def alternate_target(missing: DataFrame, ours: DataFrame, context: Sequence[str]) -> DataFrame:
    """Missing rows whose context has one row on both sides: the same slot with another target."""
    one = lambda df, n: df.groupBy(*context).agg(F.count(F.lit(1)).alias(n)).where(f"{n} = 1").drop(n)
    return missing.join(one(missing, "a"), list(context), "left_semi").join(one(ours, "b"), list(context), "left_semi")


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float], ranges: int = 256) -> DataFrame:
    """The value at rank round-half-even(p * (n - 1)) of each group, no interpolation, as p50, p90, ... Nulls don't count.

    Equal values are counted with partial aggregation. Values are dealt to ranges between a group's least and greatest, and
    ranges' counts are summed first, so that a group's values never meet in one task; only the ranges that hold a wanted
    rank are looked into.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy(*group).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"), F.sum("n").alias("__all"))
    share = F.try_divide(F.col("v").cast("double") - F.col("__lo").cast("double"), F.col("__hi").cast("double") - F.col("__lo").cast("double"))
    dealt = counts.join(ends, list(group)).withColumn("__r", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * ranges), F.lit(ranges - 1)).cast("int"))
    sums = dealt.groupBy(*group, "__r").agg(F.sum("n").alias("s"), F.first("__all").alias("__all"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*group).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = F.explode(F.array(*[F.struct(F.lit(f"p{round(100 * p)}").alias("name"), F.bround(F.lit(p) * (F.col("__all") - 1)).cast("long").alias("at")) for p in shares])).alias("w")
    held = sums.withColumn("__b", before).select(*group, "__r", "__b", "s", want).where((F.col("w.at") >= F.col("__b")) & (F.col("w.at") < F.col("__b") + F.col("s")))
    inside = dealt.join(held.select(*group, "__r", "__b").distinct(), [*group, "__r"])
    upto = F.col("__b") + F.sum("n").over(Window.partitionBy(*group, "__r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = inside.select(*group, "__r", "v", upto.alias("upto"), "n")
    found = placed.join(held.select(*group, "__r", "w"), [*group, "__r"]).where((F.col("w.at") < F.col("upto")) & (F.col("w.at") >= F.col("upto") - F.col("n")))
    return found.groupBy(*group).agg(*[F.max(F.when(F.col("w.name") == f"p{round(100 * p)}", F.col("v"))).alias(f"p{round(100 * p)}") for p in shares])


def gates(metrics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(gate, ok) of a one-row frame of metrics, and ``all``."""
    every = reduce(lambda a, b: a & b, rules.values())
    pairs = F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in {**rules, "all": every}.items()])
    return metrics.select(F.explode(pairs).alias("g")).select("g.gate", "g.ok")


def coverage_status(attempted: Column, ok: Column, errors: Column, least: float = 0.95) -> Column:
    return F.when(ok == 0, "error").when((F.try_divide(ok.cast("double"), attempted) < least) | (errors > 0), "degraded").otherwise("ok")


# ---- decomposed documents
#: Shapes that have parts, and pairs of shape and kind that contradict each other.
WITH_PARTS = ["object", "union-oneOf", "union-anyOf", "allOf-composite", "map"]
CONTRADICTIONS = [("object", "primitive"), ("union-oneOf", "primitive"), ("union-anyOf", "primitive"), ("allOf-composite", "primitive"), ("map", "primitive"), ("primitive", "object")]


def _named() -> Column:
    return ~F.col("component_id").contains("#")


def undecomposed(components: DataFrame, properties: DataFrame, composed: DataFrame, values: DataFrame, most: int = 25) -> DataFrame:
    """Named components that have parts by shape and body, but no edge to any; the longest bodies first.

    components: component_id, kind, body_shape, body; the edge tables have ``src``. The limit is the report's."""
    empty = (F.col("body_shape") == "object") & ~F.col("body").contains('"properties"')
    rows = components.where((F.col("body") != "") & ~F.col("kind").isin("primitive", "unresolved") & F.col("body_shape").isin(WITH_PARTS) & ~empty & _named())
    for edges in (properties, composed, values):
        rows = rows.join(edges.select(F.col("src").alias("component_id")), "component_id", "left_anti")
    return rows.withColumn("body_length", F.length("body")).orderBy(F.desc("body_length"), "component_id").limit(most)


def primitive_with_parts(components: DataFrame) -> DataFrame:
    return components.where((F.col("kind") == "primitive") & (F.col("body") != "") & F.col("body_shape").isin(WITH_PARTS))


def objects_without_fields(components: DataFrame, properties: DataFrame) -> DataFrame:
    """Named objects whose body lists properties, but that have no edge to any."""
    rows = components.where((F.col("body_shape") == "object") & F.col("body").contains('"properties"') & (F.col("kind") != "unresolved") & _named())
    return rows.join(properties.select(F.col("src").alias("component_id")), "component_id", "left_anti")


def contradictions(components: DataFrame) -> DataFrame:
    wrong = reduce(lambda a, b: a | b, [(F.col("body_shape") == s) & (F.col("kind") == k) for s, k in CONTRADICTIONS])
    return components.where((F.col("body") != "") & wrong)


def not_one_match(rows: DataFrame, pk: str, column: str, edges: DataFrame, targets: DataFrame, target_pk: str) -> DataFrame:
    """rows with a filled column that don't have exactly one edge to a target of that value, with n.

    edges: src, dst; targets: target_pk and the column."""
    other = edges.join(targets.select(F.col(target_pk).alias("dst"), F.col(column).alias("__v")), "dst").groupBy(F.col("src").alias(pk), F.col("__v").alias(column)).agg(F.count(F.lit(1)).alias("n"))
    filled = rows.where(F.coalesce(column, F.lit("")) != "")
    return filled.join(other, [pk, column], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where("n <> 1")


# ---- parity of two stores
#: The columns that each key set is made of, and those that name a slot whose target may differ.
KEY_SETS = {
    "endpoints": ["method", "path"], "parameters": ["method", "path", "name", "location"], "request_bodies": ["method", "path", "content_type"], "body_references": ["method", "path", "content_type", "component_id"],
    "responses": ["method", "path", "status", "content_type"], "response_references": ["method", "path", "status", "content_type", "component_id"], "schema_components": ["component_id"], "properties": ["component_id", "property"],
    "property_types": ["component_id", "property", "target_component_id"], "composition": ["component_id", "kind", "target_component_id"], "value_schemas": ["component_id", "target_component_id"], "yang_paths": ["yang_path"],
    "property_yang": ["component_id", "property", "yang_path"], "configures_yang": ["method", "path", "yang_path"], "cli_commands": ["method", "path", "command_name"],
}
SLOTS = {"body_references": ["method", "path", "content_type"], "response_references": ["method", "path", "status", "content_type"], "property_types": ["component_id", "property"], "composition": ["component_id", "kind"], "value_schemas": ["component_id"]}
VARIANT, SYNTHETIC, PROSE = "@[0-9a-f]{12}(?=#|$)", ":Shape_[0-9a-f]+$", ["description", "example", "examples", "title"]


def shape_key(body: Column) -> Column:
    """A body's canonical JSON without prose, at every depth; '' for what is no object."""
    import json

    def clean(x):
        return {k: clean(v) for k, v in x.items() if k not in PROSE} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, list) else x

    def one(t):
        try:
            x = json.loads(t)
        except (TypeError, ValueError):
            return ""
        return json.dumps(clean(x), sort_keys=True, separators=(",", ":")) if isinstance(x, dict) else ""

    return F.pandas_udf(lambda texts: texts.map(one), "string")(body)


def parity_of(name: str, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(check, n_ours, n_theirs, missing, extra, alias, alternate, structural, coverage) of one of KEY_SETS.

    A key of theirs that ours lacks still counts as covered if it is there but for a variant's suffix, if its slot has one
    target on both sides, or, for synthetic components and their properties, if ours has an equal body (``body``)."""
    keys, slot = KEY_SETS[name], SLOTS.get(name)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bare = lambda c: F.regexp_replace(text(c), VARIANT, "") if c in ("component_id", "target_component_id") else text(c)
    whole = lambda df: df.withColumns({"__k": F.to_json(F.array(*[text(c) for c in keys])), "__b": F.to_json(F.array(*[bare(c) for c in keys]))})
    a, b = whole(ours).dropDuplicates(["__k"]), whole(theirs).dropDuplicates(["__k"])
    missing = b.join(a.select("__k").withColumn("__has", F.lit(True)), "__k", "left").where("__has is null").drop("__has")
    missing = missing.join(a.select("__b").distinct().withColumn("__alias", F.lit(True)), "__b", "left")
    if slot:
        at = F.to_json(F.array(*[bare(c) for c in slot]))
        single = lambda df, n: df.groupBy(at.alias("__s")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("__s", F.lit(True).alias(n))
        missing = missing.withColumn("__s", at).join(single(a, "__one_a"), "__s", "left").join(single(b, "__one_b"), "__s", "left")
        alternate = F.col("__alias").isNull() & F.col("__one_a").isNotNull() & F.col("__one_b").isNotNull()
    else:
        alternate = F.lit(False)
    if name in ("schema_components", "properties") and "body" in ours.columns:
        extra = [] if name == "schema_components" else ["property"]
        same = a.withColumn("__shape", shape_key(F.col("body"))).where("__shape <> ''").select("__shape", *extra).distinct().withColumn("__same", F.lit(True))
        missing = missing.withColumn("__shape", shape_key(F.col("body"))).join(same, ["__shape", *extra], "left")
        structural = F.col("__alias").isNull() & F.col("__same").isNotNull() & F.col("component_id").rlike(SYNTHETIC)
    else:
        structural = F.lit(False)
    counted = missing.agg(F.count(F.lit(1)).alias("missing"), F.count_if(F.col("__alias").isNotNull()).alias("alias"), F.count_if(alternate).alias("alternate"), F.count_if(structural).alias("structural"), F.min("__k").alias("sample"))
    sizes = a.agg(F.count(F.lit(1)).alias("n_ours")).join(b.agg(F.count(F.lit(1)).alias("n_theirs")))
    out = sizes.join(counted).join(a.join(b.select("__k"), "__k", "left_anti").agg(F.count(F.lit(1)).alias("extra")))
    covered = F.col("n_theirs") - F.col("missing") + F.col("alias") + F.col("alternate") + F.col("structural")
    return out.select(F.lit(name).alias("check"), "n_ours", "n_theirs", "missing", "extra", "alias", "alternate", "structural", ratio(covered, F.col("n_theirs"), 1.0).alias("coverage"), "sample")


def parity_text(reports: DataFrame) -> str:
    """One line if all is covered, else a line for each check with a gap and a sample. Reports are a row for each check."""
    rows = sorted(reports.collect(), key=lambda r: r["check"])
    bad = [r for r in rows if r["coverage"] < 1.0]
    if not bad:
        return f"parity: all {len(rows)} checks hold"
    return "\n".join([f"parity: {len(bad)} of {len(rows)} checks have gaps", *[f"- {r['check']}: {r['missing'] - r['alias'] - r['alternate'] - r['structural']} of {r['n_theirs']} missing, as {r['sample']}" for r in bad]])


# ---- health
def build_health(components: DataFrame, properties: DataFrame) -> DataFrame:
    """One row: components, properties, properties a component, and the share of components without a body."""
    c = components.agg(F.count(F.lit(1)).alias("components"), F.count_if(F.coalesce("body", F.lit("")) == "").alias("empty"))
    out = c.join(properties.agg(F.count(F.lit(1)).alias("properties")))
    return out.select("components", "properties", ratio(F.col("properties"), F.col("components"), 0.0, 2).alias("per_component"), F.round(100 * ratio(F.col("empty"), F.col("components"), 0.0, 6), 2).alias("percent_empty"))


def corpus_report(outcomes: DataFrame, samples: int = 25) -> DataFrame:
    """(status, n, metric sums, samples) of per-document outcomes (path, status, message, metrics map); samples are the first by path."""
    at = F.slice(F.array_sort(F.collect_list(F.struct("path", "message"))), 1, samples)
    ranked = outcomes.withColumn("__r", F.row_number().over(Window.partitionBy("status").orderBy("path")))
    heads = ranked.where(F.col("__r") <= samples).groupBy("status").agg(at.alias("samples"))
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_nodes").alias("n_nodes")).join(heads, "status")


def sync_health(attempted: Column, fetched: Column, cached: Column, missing: Column, error: Column) -> Column:
    """(status, reason) of a documentation source: error, degraded with why, or ok."""
    say = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return F.when(F.coalesce(error, F.lit("")) != "", F.struct(F.lit("error").alias("status"), error.alias("reason"))).when(fetched + cached == 0, say("error", "nothing was read")).when(missing > 0, say("degraded", "some are missing")).when(cached > 0, say("degraded", "some come from the cache")).otherwise(say("ok", ""))


def workflow_health(runs: DataFrame, as_of: Column, running_h: float = 2, quiet_h: float = 36) -> DataFrame:
    """workflow and problem of production runs (workflow, event, status, conclusion, started_at): the latest failed, hangs, or
    is too old. Runs of other events than schedule, push and dispatch don't count."""
    own = runs.where(F.col("event").isin("schedule", "push", "workflow_dispatch"))
    last = own.groupBy("workflow").agg(F.max_by(F.struct("status", "conclusion", "started_at"), F.col("started_at")).alias("r"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("r.started_at")) / 3600
    problem = F.when((F.col("r.status") != "completed") & (age > running_h), "hangs").when((F.col("r.status") == "completed") & (F.col("r.conclusion") != "success"), "failed").when(age > quiet_h, "too old")
    return last.select("workflow", problem.alias("problem")).where("problem is not null")
