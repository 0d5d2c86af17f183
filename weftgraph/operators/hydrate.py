"""From JSON responses to observed objects, fields, facts and entities, their freshness, and what to do next.

All of it is DataFrame expressions: JSON is read as VARIANT, lists are higher-order functions, and what the members of an
endpoint say is collected once by grouping, not asked for one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import jsonops
from weftgraph.functions.scalar import contains_ci

#: Names of identifying fields, as looked for; those that a key is made of, by priority; those that rank
#: an endpoint's fields; and how far each is to be trusted.
IDENTITY = ["id", "uuid", "uid", "serial", "serialNumber", "serial_number", "mac", "macaddr", "macAddress", "name", "scopeId", "siteId", "deviceGroupId"]
KEY_FIELDS = ["id", "uuid", "serial", "serialNumber", "serial_number", "mac", "macaddr", "macAddress", "scopeId", "siteId", "deviceGroupId", "name"]
HINT_FIELDS = ["id", "uuid", "serial", "serialNumber", "serial_number", "mac", "macaddr", "macAddress", "scopeId", "name"]
STRONG_HINTS = ["id", "uuid", "serial", "serialNumber", "mac", "macaddr"]
STRONG_FIELDS = ["id", "uuid", "serial", "serialNumber", "mac", "macaddr", "macAddress"]
MEDIUM_FIELDS = ["serial_number", "scopeId", "siteId", "deviceGroupId", "name"]
#: What to do, the most useful first.
ACTIONS = ["use_materialized_facts", "materialize_existing_observation", "hydrate_endpoint", "refresh_hydration", "select_matching_provider", "ask_for_parameters", "use_stale_observation_or_configure_provider", "configure_provider_or_use_existing_graph", "unsupported"]


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c worked out once however often f names it."""
    return F.transform(F.array(c), f)[0]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---- responses
def _members(c: Column) -> Column:
    """An object's members as (key, json, text): the value as JSON, and as Python would print it."""
    entries = F.map_entries(F.from_json(c, "map<string,variant>"))

    def member(e: Column) -> Column:
        json = F.coalesce(F.to_json(e["value"]), F.lit("null"))
        text = F.when(json.startswith('"'), e["value"].try_cast("string")).when(json.isin("true", "false"), F.initcap(json)).otherwise(json)
        return F.struct(e["key"].alias("key"), json.alias("json"), text.alias("text"))

    return F.when(F.trim(c).startswith("{"), F.transform(entries, member))


def _list_size(json: Column) -> Column:
    return F.size(F.from_json(json, "array<variant>"))


def item_key(c: Column) -> Column:
    """The key of an envelope's items: ``items`` if a list, else the longest list but ``errors``, first of equals; else ''."""
    return let(F.filter(_members(c), lambda m: m["json"].startswith("[")), _item_key)


def _item_key(lists: Column) -> Column:
    items = F.filter(lists, lambda m: m["key"] == "items")
    others = F.filter(lists, lambda m: (m["key"] != "errors") & (_list_size(m["json"]) > 0))
    best = F.array_max(F.transform(others, lambda m, i: F.struct(_list_size(m["json"]).alias("n"), (-i).alias("i"), m["key"].alias("key"))))
    return F.when(F.size(items) > 0, "items").otherwise(F.coalesce(best["key"], F.lit("")))


def pager_key(c: Column) -> Column:
    """A page's list: ``items`` if a list, else the first list but ``errors``; null for none."""
    lists = F.filter(_members(c), lambda m: m["json"].startswith("[") & (m["key"] != "errors"))
    return let(lists, lambda own: F.coalesce(F.get(F.filter(own, lambda m: m["key"] == "items"), F.lit(0))["key"], F.get(own, F.lit(0))["key"]))


def objects(observations: DataFrame) -> DataFrame:
    """observation_id, item_index, pointer and raw: the items of each response (rawJson), or the response itself at -1.

    A response that isn't JSON has no objects."""
    rows = observations.where(F.try_parse_json("rawJson").isNotNull()).select("observation_id", F.col("rawJson"), item_key(F.col("rawJson")).alias("__k"))
    root = F.trim("rawJson")
    inner = F.get(F.filter(_members(F.col("rawJson")), lambda m: m["key"] == F.col("__k")), F.lit(0))["json"]
    items = F.when(root.startswith("["), F.from_json("rawJson", "array<variant>")).when(F.col("__k") != "", F.from_json(inner, "array<variant>"))
    base = F.when(F.coalesce(F.col("__k"), F.lit("")) == "", "").otherwise(F.concat(F.lit("/"), jsonops.pointer_escape(F.col("__k"))))
    listed = rows.select("observation_id", base.alias("base"), F.posexplode(items).alias("item_index", "v"))
    each = listed.select("observation_id", "item_index", F.concat("base", F.lit("/"), F.col("item_index").cast("string")).alias("pointer"), F.coalesce(F.to_json("v"), F.lit("null")).alias("raw"))
    alone = rows.where(items.isNull()).select("observation_id", F.lit(-1).alias("item_index"), F.lit("").alias("pointer"), F.col("rawJson").alias("raw"))
    return each.unionByName(alone)


def item_count(c: Column) -> Column:
    """How many objects a response has."""
    inner = F.get(F.filter(_members(c), lambda m: m["key"] == item_key(c)), F.lit(0))["json"]
    return F.when(F.trim(c).startswith("["), _list_size(c)).when(item_key(c) != "", _list_size(inner)).otherwise(1)


def fields(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id_col, name, value_json, kind): one row for each member of an object, sorted by name."""
    member = F.explode(F.map_entries(F.from_json(json_col, "map<string,string>"))).alias("e")
    out = rows.select(id_col, member).select(id_col, F.col("e.key").alias("name"), F.col("e.value").alias("value_json"))
    return out.withColumn("kind", jsonops.value_kind(F.col("value_json")))


# ---- identity
def identity(raw: Column) -> Column:
    """The identifying members of an object as (key, json, text), in the order of IDENTITY: by exact name, else by the last
    that is equal but for case; null and empty values don't identify. Null for what isn't an object."""
    names = _texts([n.lower() for n in IDENTITY])
    return let(F.filter(_members(raw), lambda m: F.array_contains(names, F.lower(m["key"]))), _identity)  # few are left of most objects


def _identity(members: Column) -> Column:
    def found(name: str) -> Column:
        filled = lambda m: ~m["json"].isin("null", '""')
        exact = F.get(F.filter(members, lambda m: (m["key"] == name) & filled(m)), F.lit(0))
        alike = F.try_element_at(F.filter(members, lambda m: F.lower(m["key"]) == name.lower()), F.lit(-1))
        return F.coalesce(exact, F.when(filled(alike), alike))

    return F.when(members.isNotNull(), F.filter(F.array(*[found(n) for n in IDENTITY]), lambda m: m.isNotNull()))


def identity_key(own: Column) -> Column:
    return let(own, _identity_key)


def _identity_key(own: Column) -> Column:
    """(key, field) of what ``identity`` found: ``field=value`` of the first of KEY_FIELDS in any case, of the only member, or
    ``identityHash=`` with 16 digits of the hash of all; both empty for none."""
    lower = _texts([n.lower() for n in KEY_FIELDS])
    ranked = F.filter(F.transform(own, lambda m: F.struct(F.array_position(lower, F.lower(m["key"])).alias("r"), m.alias("m"))), lambda x: x["r"] > 0)
    best = F.coalesce(F.array_min(F.transform(ranked, lambda x: F.struct(x["r"].alias("r"), x["m"].alias("m"))))["m"], F.when(F.size(own) == 1, own[0]))
    whole = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(own), lambda m: F.concat(jsonops.quoted(m["key"]), F.lit(":"), jsonops.ascii(m["json"]))), ","), F.lit("}"))
    none = F.struct(F.lit("").alias("key"), F.lit("").alias("field"))
    hashed = F.struct(F.concat(F.lit("identityHash="), F.left(F.sha2(whole, 256), F.lit(16))).alias("key"), F.lit("identityHash").alias("field"))
    named = F.struct(F.concat(best["key"], F.lit("="), best["text"]).alias("key"), best["key"].alias("field"))
    return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, none).when(best.isNotNull(), named).otherwise(hashed)


def confidence(field: Column, n_attributes: Column) -> Column:
    return F.when(field.isin(STRONG_FIELDS), "high").when(field.isin(MEDIUM_FIELDS) | (n_attributes >= 2), "medium").otherwise("low")


def entity_type(schema_id: Column, endpoint_id: Column) -> Column:
    """The last part of the schema's id without its anchor, else the last segment of the endpoint's path."""
    tail = F.substring_index(F.substring_index(F.coalesce(schema_id, F.lit("")), ":", -1), "#", 1)
    path = F.regexp_replace(F.coalesce(endpoint_id, F.lit("")), "^[^:]*:", "")
    segment = F.substring_index(F.trim(path, F.lit("/")), "/", -1)
    return F.coalesce(F.nullif(tail, F.lit("")), F.nullif(segment, F.lit("")), F.lit("RuntimeObject"))


def hashed_id(prefix: str, **parts: Column) -> Column:
    """``prefix:`` and the hash of the parts as a JSON object with sorted keys."""
    body = [F.concat(jsonops.quoted(F.lit(k)), F.lit(":"), jsonops.quoted(F.coalesce(c.cast("string"), F.lit("")))) for k, c in sorted(parts.items())]
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}")), 256))


def facts(observed: DataFrame) -> DataFrame:
    """observed (observation_id, object_id, run_id, endpoint_id, schema_component_id, raw) with fact_id, entity_type,
    identity_key, identity_field, confidence, attributes and ``skipped``: why there is no fact, or null."""
    own = identity(F.col("raw"))
    rows = observed.withColumn("__own", own).withColumn("__key", identity_key(F.col("__own")))
    n = F.coalesce(F.size(F.from_json("raw", "map<string,variant>")), F.lit(0))
    skipped = F.when(F.coalesce(F.size("__own"), F.lit(0)) <= 0, "identity_unknown").when(n <= 0, "attributes_not_object").when(F.col("__key.key") == "", "identity_ambiguous")
    kind = entity_type(F.col("schema_component_id"), F.col("endpoint_id"))
    made = hashed_id("fact", endpoint_id=F.col("endpoint_id"), entity_type=F.col("entity_type"), identity_key=F.col("__key.key"), observation_id=F.col("observation_id"), object_id=F.col("object_id"))
    out = rows.withColumn("entity_type", kind).withColumn("skipped", skipped)
    return out.withColumns({"fact_id": F.when(F.col("skipped").isNull(), made), "identity_key": F.col("__key.key"), "identity_field": F.col("__key.field"), "confidence": confidence(F.col("__key.field"), n), "attributes": jsonops.canonical(F.col("raw"))}).drop("__own", "__key")


def provenance(made: DataFrame) -> DataFrame:
    """(rel, src, dst): up to four edges of each fact, to or from its observation, object, run and endpoint."""
    f = made.where(F.col("skipped").isNull())
    edge = lambda rel, a, b: F.struct(F.lit(rel).alias("rel"), F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"))
    each = F.array(edge("OBSERVATION_MATERIALIZED_FACT", "observation_id", "fact_id"), edge("FACT_FROM_OBJECT", "fact_id", "object_id"), edge("FACT_FROM_RUN", "fact_id", "run_id"), edge("FACT_FROM_API", "fact_id", "endpoint_id"))
    filled = F.filter(each, lambda e: (F.coalesce(e["src"], F.lit("")) != "") & (F.coalesce(e["dst"], F.lit("")) != ""))
    return f.select(F.explode(filled).alias("e")).select("e.*").distinct()


def object_schema(observed: DataFrame, properties: DataFrame) -> DataFrame:
    """observed (schema_component_id, item_index, pointer) with resolved_component_id: the item schema of the list property
    that holds the object, else that property's type, else the root's schema.

    properties: parent_component_id, name, item_component_id, type_component_id."""
    parts = F.filter(F.split("pointer", "/"), lambda x: x != "")
    key = F.when((F.col("item_index") >= 0) & (F.size(parts) >= 2), parts[0])
    p = properties.groupBy(F.col("parent_component_id").alias("__c"), F.col("name").alias("__n")).agg(F.min(F.coalesce("item_component_id", "type_component_id")).alias("__r"))
    rows = observed.withColumn("__k", key)
    joined = rows.join(p, (rows.schema_component_id == F.col("__c")) & (F.col("__k") == F.col("__n")), "left")
    return joined.withColumn("resolved_component_id", F.coalesce(F.nullif(F.col("__r"), F.lit("")), F.col("schema_component_id"))).drop("__k", "__c", "__n", "__r")


def promote(facts: DataFrame, keys: list[str], at: str, order: Column) -> DataFrame:
    """One entity for each key: its latest fact, how many there are, first and last times."""
    latest = F.max_by("fact_id", order)
    return facts.groupBy(*keys).agg(latest.alias("latest_fact_id"), F.count(F.lit(1)).alias("fact_count"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


# ---- freshness
def freshness(at: Column, as_of: Column, ttl_s: Column) -> Column:
    """unknown, fresh or stale; a TTL of 0 or less is always stale."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(at)
    return F.when(at.isNull(), "unknown").when((ttl_s <= 0) | (age > ttl_s), "stale").otherwise("fresh")


def latest(observations: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest observation of each scope."""
    cols = [c for c in observations.columns if c not in keys]
    best = observations.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(at)).alias("o"))
    return best.select(*keys, "o.*")


def endpoint_states(endpoints: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """endpoint_id, state (missing, fresh, stale or unknown) and the latest observation's id, of every endpoint.

    observations: observation_id, endpoint_id, observedAt, staleAfterSeconds; of equal times the greatest id counts."""
    last = observations.groupBy("endpoint_id").agg(F.max_by(F.struct("observation_id", "observedAt", "staleAfterSeconds"), F.struct("observedAt", "observation_id")).alias("o"))
    rows = endpoints.select("endpoint_id").join(last, "endpoint_id", "left")
    state = F.when(F.col("o").isNull(), "missing").otherwise(freshness(F.col("o.observedAt"), as_of, F.col("o.staleAfterSeconds")))
    return rows.select("endpoint_id", state.alias("state"), F.col("o.observation_id").alias("observation_id"))


def ledger(calls: DataFrame, response_cap: int) -> DataFrame:
    """run rows of calls (run_id, endpoint_id, request, response, error, duration_ms): status, hashes, bytes and item count.

    A failed call, and one whose response is over the cap, is an error run without items; error texts end at 1,000 letters."""
    size = F.octet_length("response")
    problem = F.when(F.coalesce("error", F.lit("")) != "", F.col("error")).when(size > response_cap, F.concat(F.lit("response of "), size.cast("string"), F.lit(" bytes is over the cap")))
    sha = lambda c: F.coalesce(F.sha2(c, 256), F.lit(""))
    return calls.select("run_id", "endpoint_id", F.when(problem.isNull(), "success").otherwise("error").alias("status"), "duration_ms", sha(jsonops.canonical(F.col("request"))).alias("request_hash"), sha(F.col("response")).alias("response_hash"), F.coalesce(size, F.lit(0)).cast("long").alias("response_bytes"), F.when(problem.isNull(), item_count(F.col("response"))).otherwise(0).cast("long").alias("item_count"), F.coalesce(F.left(problem, F.lit(1000)), F.lit("")).alias("error"))


def observation_detail(observations: DataFrame, objs: DataFrame, flds: DataFrame, n_objects: int, n_fields: int) -> DataFrame:
    """observations without their raw text, each with its first objects (by index and pointer) and their first fields (by name).

    objs: observation_id, object_id, item_index, pointer; flds: object_id, name, value_json, kind. The bounds are the feature."""
    f = flds.withColumn("__r", F.row_number().over(Window.partitionBy("object_id").orderBy("name"))).where(F.col("__r") <= n_fields)
    f = f.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("name", "value_json", "kind"))).alias("fields"))
    o = objs.withColumn("__r", F.row_number().over(Window.partitionBy("observation_id").orderBy("item_index", "pointer"))).where(F.col("__r") <= n_objects)
    o = o.join(f, "object_id", "left").groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct("item_index", "pointer", "object_id", "fields"))).alias("objects"))
    return observations.drop("rawJson").join(o, "observation_id", "left")


# ---- candidates and plans
def paging_style(names: Column) -> Column:
    """(style, confidence, parameters) of how an endpoint pages, from its lower-cased query names."""
    has = lambda *n: reduce(lambda a, b: a & b, [F.array_contains(names, x) for x in n])
    says = lambda style, sure, *n: F.struct(F.lit(style).alias("style"), F.lit(sure).alias("confidence"), (_texts(list(n)) if n else F.array().cast("array<string>")).alias("parameters"))
    return F.when(has("offset", "limit"), says("offset", "medium", "limit", "offset")).when(has("next", "limit"), says("cursor", "medium", "limit", "next")).when(has("cursor"), says("cursor", "low", "cursor")).when(has("limit"), says("bounded_list", "low", "limit")).otherwise(says("none_detected", "low"))


def identity_hints(names: Column) -> Column:
    """(status, fields, confidence) of an endpoint's identifying names: by priority, then others by name."""
    known = _texts(HINT_FIELDS)
    rank = lambda n: F.struct(F.when(F.array_position(known, n) > 0, F.array_position(known, n)).otherwise(999).alias("r"), n.alias("n"))
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")), rank)), lambda x: x["n"])
    sure = F.when(F.get(ordered, F.lit(0)).isin(STRONG_HINTS), "high").otherwise("medium")
    none = F.struct(F.lit("unknown").alias("status"), F.array().cast("array<string>").alias("fields"), F.lit("low").alias("confidence"))
    return F.when(F.coalesce(F.size(ordered), F.lit(0)) <= 0, none).otherwise(F.struct(F.lit("candidate").alias("status"), ordered.alias("fields"), sure.alias("confidence")))


def preferred_root(responses: DataFrame) -> DataFrame:
    """endpoint_id and root (status, component_id, body_shape, schema_type): the first 2xx response with a schema by status,
    else the first that has one."""
    some = responses.where(F.coalesce("component_id", F.lit("")) != "")
    rank = F.struct(~F.col("status").startswith("2"), F.col("status"), F.coalesce("content_type", F.lit("")), F.col("component_id"))
    return some.groupBy("endpoint_id").agg(F.min_by(F.struct("status", "component_id", "body_shape", "schema_type"), rank).alias("root"))


def search_endpoints(endpoints: DataFrame, search: str = "", limit: int = 25, source: str = "", responses: DataFrame | None = None) -> DataFrame:
    """GET endpoints by path whose path, summary or operationId holds a text; with a source, those of which a response's
    schema is of that source. The limit is the feature."""
    rows = endpoints.where(F.col("method") == "GET")
    if search.strip():
        rows = rows.where(contains_ci(search.strip(), F.col("path"), F.col("summary"), F.col("operationId")))
    if source:
        rows = rows.join(responses.where(F.col("component_id").startswith(f"{source}:")), "endpoint_id", "left_semi")
    return rows.orderBy("path", "endpoint_id").limit(limit)


def candidates(endpoints: DataFrame, parameters: DataFrame, responses: DataFrame, hints: DataFrame) -> DataFrame:
    """Each endpoint with its execution shape, paging, root, identity, blockers and confidence.

    endpoints: endpoint_id, method, path; parameters: endpoint_id, name, location, required; responses: as preferred_root;
    hints: component_id, name (identifying properties of a schema, its own and inherited). Parameters, roots and hints are
    grouped once each."""
    low = F.lower("location")
    grouped = parameters.groupBy("endpoint_id").agg(
        F.array_sort(F.collect_set(F.when(low == "query", F.lower("name")))).alias("query_names"),
        F.array_sort(F.collect_list(F.when(low == "path", F.col("name")))).alias("path_parameters"),
        F.array_sort(F.collect_list(F.when(F.col("required"), F.col("name")))).alias("required_parameters"),
    )
    named = hints.groupBy("component_id").agg(F.collect_set("name").alias("hint_names"))
    root = preferred_root(responses)
    rows = endpoints.join(grouped, "endpoint_id", "left").join(root, "endpoint_id", "left")
    rows = rows.join(named, rows.root.component_id == named.component_id, "left").drop("component_id")
    none = F.array().cast("array<string>")
    for c in ("query_names", "path_parameters", "required_parameters"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    rows = rows.withColumns({"paging": paging_style(F.col("query_names")), "identity": identity_hints(F.col("hint_names"))})
    form = F.lower(F.coalesce(F.nullif(F.col("root.body_shape"), F.lit("")), F.col("root.schema_type"), F.lit("")))
    listed = (F.col("paging.style") != "none_detected") | form.isin("array", "map") | F.arrays_overlap("query_names", _texts(["limit", "offset", "next", "cursor"]))
    shape = F.when((F.size("path_parameters") > 0) | F.col("path").contains("{"), "parameterized_lookup").when(listed, "collection").otherwise("single_or_unknown")
    blockers = F.filter(F.array(F.when(F.upper("method") != "GET", "not_get"), F.when(F.col("root").isNull(), "no_response_schema")), lambda b: b.isNotNull())
    rows = rows.withColumns({"execution_shape": shape, "blockers": blockers})
    sure = F.when(F.upper("method") != "GET", "unsupported").when(F.size("blockers") > 0, "low").when((F.col("identity.confidence") == "high") & F.col("paging.confidence").isin("medium", "high"), "high").when(F.col("identity.status") == "candidate", "medium").otherwise("low")
    return rows.withColumn("confidence", sure).drop("hint_names")


def provider_of(name: Column, aliases: dict[str, list[str]], strict: bool = False) -> Column:
    """The canonical name of a provider from its aliases in any case; '' for an unknown one, or an error with ``strict``."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = reduce(lambda c, item: F.when(low.isin(item[1]), item[0]).otherwise(c), aliases.items(), F.lit("").cast("string"))
    wrong = F.concat(F.lit("provider must be one of: " + ", ".join(sorted(aliases)) + "; not "), low)
    return F.when(out != "", out).otherwise(F.raise_error(wrong).cast("string")) if strict else out


def endpoint_provider(explicit: Column, components: Column, endpoint_id: Column, aliases: dict[str, list[str]]) -> Column:
    """A stated provider, else that of the first component whose id begins with a known one, else of the endpoint's id."""
    first = F.get(F.filter(F.transform(components, lambda c: provider_of(F.substring_index(c, ":", 1), aliases)), lambda p: p != ""), F.lit(0))
    stated = F.trim(F.coalesce(explicit, F.lit("")))
    return F.when(stated != "", provider_of(stated, aliases)).otherwise(F.coalesce(first, provider_of(F.substring_index(endpoint_id, ":", 1), aliases)))


def readiness(settings: DataFrame) -> DataFrame:
    """provider, configured, client_available and can_hydrate of settings (provider, base_url, credentials, client)."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return settings.select("provider", "base_url", filled("credentials").alias("configured"), F.coalesce("client", F.lit(False)).alias("client_available"), F.coalesce("client", F.lit(False)).alias("can_hydrate"))


def call_errors(placeholders: Column, required: Column, given_path: Column, given_query: Column) -> Column:
    """Sorted distinct errors of a call before it is made: path placeholders and required parameters without a value."""
    lost = F.transform(F.array_except(placeholders, given_path), lambda n: F.concat(F.lit("path:"), n))
    need = F.transform(F.array_except(F.array_except(required, placeholders), given_query), lambda n: F.concat(F.lit("query:"), n))
    return F.array_sort(F.array_distinct(F.concat(lost, need)))


def body_findings(required: Column, known: Column, given: Column) -> Column:
    """(errors, warnings) of a body before it is sent: required fields that are missing, given ones that the schema lacks."""
    return F.struct(F.array_sort(F.array_except(required, given)).alias("errors"), F.when(F.size(known) > 0, F.array_sort(F.array_except(given, known))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def plan_action(*, endpoint_provider: Column, provider: Column, blockers: Column, errors: Column, can_hydrate: Column, observed: Column, state: Column, age_seconds: Column, fact_count: Column, freshness_target: Column) -> Column:
    """What to do next for an endpoint, the first of these that holds."""
    old = F.coalesce((freshness_target >= 0) & (age_seconds >= freshness_target), F.lit(False))
    fresh = (F.coalesce(state, F.lit("unknown")) == "fresh") & ~old
    return (
        F.when((F.coalesce(endpoint_provider, F.lit("")) != "") & (endpoint_provider != provider), "select_matching_provider")
        .when(F.size(blockers) > 0, "unsupported")
        .when(F.size(errors) > 0, "ask_for_parameters")
        .when(~can_hydrate & ~observed, "configure_provider_or_use_existing_graph")
        .when(~observed, "hydrate_endpoint")
        .when(fresh & (fact_count > 0), "use_materialized_facts")
        .when(fresh, "materialize_existing_observation")
        .when(~can_hydrate, "use_stale_observation_or_configure_provider")
        .otherwise("refresh_hydration")
    )


def best_action(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group of plans (action, endpoint_id, ord) the action that is most useful, the last plan that has it; a group
    without any known action gives its first."""
    rank = F.array_position(_texts(ACTIONS), F.col("action"))
    known = F.when(rank > 0, rank).otherwise(len(ACTIONS) + 1)
    place = F.when(rank > 0, -F.col("ord")).otherwise(F.col("ord"))
    return plans.groupBy(*keys).agg(F.min_by(F.struct("action", "endpoint_id"), F.struct(known, place)).alias("p")).select(*keys, "p.*")


def call_plan(action: Column, endpoint_id: Column, provider: Column, observation_id: Column) -> Column:
    """(tool, args) of the step that follows an action, or null: the call that hydrates, or the one that makes facts."""
    some = F.coalesce(observation_id, F.lit("")) != ""
    hydrate = F.struct(F.lit("hydrate_runtime_endpoint").alias("tool"), F.create_map(F.lit("endpoint_id"), endpoint_id, F.lit("provider"), provider).alias("args"))
    make = F.struct(F.lit("materialize_runtime_facts").alias("tool"), F.create_map(F.lit("observation_id"), observation_id).alias("args"))
    return F.when(action.isin("hydrate_endpoint", "refresh_hydration"), hydrate).when((action == "materialize_existing_observation") & some, make)
