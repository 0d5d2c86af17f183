"""Loads of what other systems answer: lists in envelopes, hierarchies, assignments, keyed parts, reports on sources and jobs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MAP, _LIST = "map<string,variant>", "array<variant>"


def records(c: Column, category: Column) -> Column:
    """The JSON texts of a response's records: of a list, else of the first list among ``items``, ``result`` and the category,
    else the response itself if it has a name; null for anything else."""
    members = F.from_json(c, _MAP)
    one = lambda key: F.to_json(F.try_element_at(members, key))
    lists = F.filter(F.array(F.trim(c), one(F.lit("items")), one(F.lit("result")), one(category)), lambda x: x.startswith("["))
    texts = F.transform(F.from_json(F.get(lists, F.lit(0)), _LIST), lambda v: F.to_json(v))
    return F.coalesce(texts, F.when(F.trim(c).startswith("{") & F.map_contains_key(members, "name"), F.array(c)))


def categories(found: DataFrame, column: str, fallback: Sequence[str]) -> DataFrame:
    """``category`` of found JSON values (texts, or objects with a name or category), sorted; the fallback where none are."""
    text = F.coalesce(F.get_json_object(column, "$.name"), F.get_json_object(column, "$.category"), F.when(~F.trim(F.col(column)).startswith("{"), F.trim(F.col(column), F.lit(' "'))))
    got = found.select(text.alias("category")).where("coalesce(category, '') <> ''").groupBy().agg(F.array_sort(F.collect_set("category")).alias("c"))
    spare = F.array(*[F.lit(x) for x in fallback])
    return got.select(F.explode(F.when(F.size("c") > 0, F.col("c")).otherwise(spare)).alias("category"))


def first_filled(*names: str) -> Column:
    """The first of several fields that is there and not empty, as text."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names])


def hierarchy(sites: DataFrame, organisation: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sites (id, siteId, name, siteName, collectionId): each hangs on its collection, else on the organisation.

    Rows without an id or a name are left out; of rows that share an id the least name counts."""
    named = sites.select(first_filled("id", "siteId").alias("id"), first_filled("name", "siteName").alias("name"), F.nullif(F.trim("collectionId"), F.lit("")).alias("collection"))
    nodes = named.where("id is not null and name is not null").groupBy("id").agg(F.min_by(F.struct("name", "collection"), F.struct("name", "collection")).alias("v")).select("id", "v.*")
    up = F.when(F.col("collection").isNotNull(), F.struct(F.lit("COLLECTION_HAS_SITE").alias("rel"), F.col("collection").alias("src"))).otherwise(F.struct(F.lit("ORG_HAS_SITE").alias("rel"), F.lit(organisation).alias("src")))
    return nodes.select("id", "name"), nodes.select(up.alias("u"), F.col("id").alias("dst")).select("u.rel", "u.src", "dst")


def assignments(profiles: DataFrame, scopes: DataFrame) -> DataFrame:
    """(profile_id, rel, scope): an edge for each scope that a profile (category, id, scope ids) is assigned to, by its type.

    scopes: scope, scope_type. A profile's id is ``category:id``; unknown scopes are left out."""
    each = profiles.select(F.concat_ws(":", "category", F.col("id").cast("string")).alias("profile_id"), F.explode("scopes").alias("scope")).distinct()
    rel = F.concat(F.lit("ASSIGNED_TO_"), F.upper("scope_type"))
    return each.join(scopes, "scope").select("profile_id", rel.alias("rel"), "scope")


def keyed_parts(owners: DataFrame, key: str, parts: str) -> DataFrame:
    """(part_id, owner, index, part): the parts of a list of each owner, keyed ``owner:index``."""
    each = owners.select(F.col(key).alias("owner"), F.posexplode(parts).alias("index", "part"))
    return each.select(F.concat_ws(":", F.col("owner").cast("string"), F.col("index").cast("string")).alias("part_id"), "owner", "index", "part")


def job_states(jobs: DataFrame) -> DataFrame:
    """One row: how many jobs ended each way and the state of all of them.

    jobs: status of success, partial, failed, error or cancelled. All well is success; none well is failed, or cancelled
    if nothing else happened; else partial."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = jobs.agg(F.count(F.lit(1)).alias("jobs"), *[n(s) for s in ("success", "partial", "failed", "error", "cancelled")])
    state = F.when(F.col("success") == F.col("jobs"), "success").when((F.col("cancelled") > 0) & (F.col("cancelled") == F.col("jobs")), "cancelled").when(F.col("success") + F.col("partial") == 0, "failed").otherwise("partial")
    return out.withColumn("state", state)


def scripts(catalogue: DataFrame, tag: str | None = None) -> DataFrame:
    """A catalogue (filename, tags) in order of name, with those of a tag alone if one is given."""
    return (catalogue.where(F.array_contains("tags", tag)) if tag else catalogue).orderBy("filename")


# ---- sources
def source_counters(fetches: DataFrame) -> DataFrame:
    """Of each source (source, outcome of cached, fetched or missing, reason): counters, total, and failures by reason."""
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    reasons = fetches.where("outcome = 'missing'").groupBy("source", F.coalesce("reason", F.lit("unknown")).alias("r")).agg(F.count(F.lit(1)).alias("k")).groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "k")))).alias("failure_reasons"))
    out = fetches.groupBy("source").agg(F.count(F.lit(1)).alias("discovered"), n("cached"), n("fetched"), n("missing"))
    return out.join(reasons, "source", "left").withColumn("failure_reasons", F.coalesce("failure_reasons", F.create_map().cast("map<string,bigint>")))


def scrape_report(pages: DataFrame) -> DataFrame:
    """One row of pages (page, outcome, status): counters, and ``blocked`` if every page that failed was refused (403) and none was read."""
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    failed = F.col("outcome") == "failed"
    out = pages.agg(F.count(F.lit(1)).alias("pages"), n("cached"), n("fetched"), n("failed"), F.coalesce(F.bool_and(F.when(failed, F.col("status") == 403)), F.lit(False)).alias("refused"))
    return out.withColumn("blocked", F.col("refused") & (F.col("cached") + F.col("fetched") == 0)).drop("refused")


def services(sidebars: DataFrame, base: str, included: Sequence[str] | None = None) -> DataFrame:
    """(slug, link) of a navigation tree's ``Services`` group (JSON text): links below ``base`` with a slug, trailing slashes
    gone, and of included slugs alone if they are given."""
    item = "struct<label:string,link:string>"
    groups = F.from_json(F.get_json_object("sidebar", "$.items"), f"array<struct<label:string,items:array<{item}>>>")
    each = sidebars.select(F.explode(groups).alias("g")).where("g.label = 'Services'").select(F.posexplode("g.items").alias("place", "i"))
    rows = each.select("place", F.rtrim(F.col("i.link"), F.lit("/")).alias("link")).where(F.col("link").contains("/services/") & (F.col("link") != base))
    rows = rows.withColumn("slug", F.regexp_extract("link", "/services/([^/]*)", 1))
    return (rows.where(F.col("slug").isin(list(included))) if included is not None else rows).select("slug", "link")


def spec_links(sidebar: Column, slug: str) -> Column:
    """(name, path) of the specifications that a service's navigation names, once each; change logs are none."""
    found = F.regexp_extract_all(sidebar, F.lit(rf'/services/{slug}(/[^\\"]*?)/openapi/[a-z0-9_-]+/'), F.lit(1))
    names = F.regexp_extract_all(sidebar, F.lit(rf'/services/{slug}/[^\\"]*?/openapi/([a-z0-9_-]+)/'), F.lit(1))
    pairs = F.filter(F.arrays_zip(names.alias("name"), found.alias("path")), lambda p: p["name"] != "changelog")
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["name"] == p["name"]))


def markdown_spec(text: Column) -> Column:
    """(spec, example) of a page in Markdown: its first JSON block with paths, and the first JSON block after that, or null."""
    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)```json\s*\n(.*?)\n\s*```"), F.lit(1)), lambda b: F.try_parse_json(b).isNotNull())
    is_spec = lambda b: F.trim(b).startswith("{") & F.get_json_object(b, "$.paths").isNotNull()
    at = F.get(F.filter(F.transform(blocks, lambda b, i: F.when(is_spec(b), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.struct(F.get(blocks, at).alias("spec"), F.get(blocks, at + 1).alias("example"))


def sampled_documents(docs: DataFrame, provider: str, path: str, n: int) -> DataFrame:
    """The first n documents of each provider by path. The cap is the feature."""
    return docs.withColumn("__r", F.row_number().over(Window.partitionBy(provider).orderBy(path))).where(F.col("__r") <= n).drop("__r")


def first_route(rows: DataFrame, key: str, routes: Sequence[str]) -> DataFrame:
    """key, body and route: the body of the first route, in order, that has one; both null where none has."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    route = reduce(lambda out, r: F.when(some(r), r).otherwise(out), reversed(routes), F.lit(None).cast("string"))
    return rows.select(key, F.coalesce(*[F.when(some(r), F.col(r)) for r in routes]).alias("body"), route.alias("route"))


def with_cached_outcomes(docs: DataFrame, body: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with what a cache (digest, status, result) says of their canonical body, and (hits, misses)."""
    from weftgraph.functions.jsonops import content_hash

    hashed = docs.withColumn("digest", content_hash(F.col(body)))
    out = hashed.join(cache.dropDuplicates(["digest"]), "digest", "left").withColumn("hit", F.col("status").isNotNull())
    return out, out.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def version_gate(manifests: DataFrame, version: int, tag: str = "", digest: str = "") -> DataFrame:
    """manifests with ``problem``: another version, tag or digest than asked for, the first that differs, or null."""
    wrong = lambda want, have, what: F.when(F.lit(want != "") & (F.coalesce(have, F.lit("")) != want), what)
    return manifests.withColumn("problem", F.coalesce(F.when(F.coalesce("version", F.lit(-1)) != version, "version"), wrong(tag, F.col("tag"), "tag"), wrong(digest, F.col("digest"), "digest")))


def install_matches(asset: str, member: str, projection: str) -> Column:
    """Whether a state's asset, member and projection are these; an older state without a projection is the default one's."""
    return (F.col("asset") == asset) & (F.col("member") == member) & (F.coalesce(F.nullif(F.col("projection"), F.lit("")), F.lit("default")) == projection)


def area_counts(paths: DataFrame, areas: Sequence[str]) -> DataFrame:
    """(area, n) of source files ``area/name.json``; a path of another form is an error when the counts are read."""
    part = F.split("path", "/")
    good = (F.size(part) == 2) & part[0].isin(list(areas)) & part[1].endswith(".json")
    area = F.when(good, part[0]).otherwise(F.raise_error(F.concat(F.lit("not a source: "), F.col("path"))).cast("string"))
    return paths.select(area.alias("area")).groupBy("area").agg(F.count(F.lit(1)).alias("n"))
