"""Queries of model identities, overrides, inherited properties and input checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import model
from weftgraph.queries import query

TOKEN = "coalesce(nullif(lower(regexp_replace(regexp_replace({}, '[^0-9a-zA-Z]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'unnamed')"


@query("g16_identity_token", f"select p_partkey, {TOKEN.format('p_name')} as token, 'schema:' || {TOKEN.format('p_type')} as identity from part")
def g16(t):
    none = F.lit(None).cast("string")
    return t.part.select("p_partkey", model.identity_token(F.col("p_name")).alias("token"), model.schema_identity(none, F.col("p_type"), F.lit("")).alias("identity"))


@query(
    "g15_merged_models",
    f"""with n as (select 'schema:' || {TOKEN.format('p_type')} as identity, * from part),
    b as (select identity, p_brand, min(p_partkey) as o from n group by 1, 2),
    l as (select identity, string_agg(p_brand, ',' order by o) as brands from b group by 1)
    select n.identity, arg_min(p_name, p_partkey) as name, any_value(brands) as brands, bool_or(p_size > 40) as required, count(*) as n_nodes
    from n join l on n.identity = l.identity group by 1""",
)
def g15(t):
    none = F.lit(None).cast("string")
    nodes = t.part.select(model.schema_identity(none, F.col("p_type"), F.lit("")).alias("identity"), "p_partkey", F.col("p_name").alias("name"), F.array("p_brand").alias("brands"), (F.col("p_size") > 40).alias("required"))
    out = model.merge_models(nodes, "identity", "p_partkey", ["name"], ["brands"], ["required"])
    return out.withColumn("brands", F.array_join("brands", ",")).select("identity", "name", "brands", "required", "n_nodes")


@query(
    "g12_parameter_overrides",
    """select l_orderkey as owner, l_linestatus as name, l_returnflag as location, l_linenumber as ordinal, level from
    (select *, row_number() over (partition by l_orderkey, l_linestatus, l_returnflag order by level desc, l_linenumber desc) as r
     from (select *, cast(l_suppkey % 2 as int) as level from lineitem)) where r = 1""",
)
def g12(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("owner"), F.col("l_linestatus").alias("name"), F.col("l_returnflag").alias("location"), F.col("l_linenumber").alias("ordinal"), (F.col("l_suppkey") % 2).cast("int").alias("level"))
    return model.override_parameters(rows, "owner", "level", "ordinal")


@query(
    "h06_property_map",
    """with p as (select n_regionkey as root, n_name as name, 'n' || n_nationkey as id, 1 as depth from nation
    union all select n_regionkey, c_mktsegment, 'c' || c_custkey, 2 from customer join nation on c_nationkey = n_nationkey
    union all select r_regionkey, r_name, 'r' || r_regionkey, 0 from region)
    select 'r' || root as root, name, arg_min(id, (depth, id)) as property_id, min(depth) as depth from p group by root, name""",
)
def h06(t):
    def name(kind, c):
        return F.concat(F.lit(kind), F.col(c).cast("string"))

    composed = t.nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionByName(t.customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    kinds = [(t.region, "r", "r_regionkey", "r_name"), (t.nation, "n", "n_nationkey", "n_name"), (t.customer, "c", "c_custkey", "c_mktsegment")]
    parts = [d.select(name(k, i).alias("parent"), F.col(v).alias("name"), name(k, i).alias("property_id")) for d, k, i, v in kinds]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return model.property_map(t.region.select(name("r", "r_regionkey").alias("root")), composed, every, depth=2)


@query(
    "h07_missing_inputs",
    """with p as (select o_custkey as endpoint_id, o_orderpriority as name, case o_orderstatus when 'F' then 'query' when 'O' then 'path' else 'header' end as place
    from orders join customer on o_custkey = c_custkey where o_totalprice > 100000)
    select c_custkey as endpoint_id, 'missing path parameter' as problem, 'nation' as name from customer
    union select endpoint_id, case place when 'header' then 'unsupported place: header' else 'missing ' || place || ' parameter' end, name from p
    where place = 'header' or (place = 'query' and name <> '1-URGENT') or (place = 'path' and name <> '2-HIGH')""",
)
def h07(t):
    endpoints = t.customer.select(F.col("c_custkey").alias("endpoint_id"), F.lit("/v1/{region}/{nation}").alias("path"), F.array(F.lit("1-URGENT")).alias("query_names"), F.array(F.lit("region"), F.lit("2-HIGH")).alias("path_names"))
    place = F.when(F.col("o_orderstatus") == "F", "query").when(F.col("o_orderstatus") == "O", "path").otherwise("header")
    parameters = t.orders.select(F.col("o_custkey").alias("endpoint_id"), F.col("o_orderpriority").alias("name"), place.alias("location"), (F.col("o_totalprice") > 100000).alias("required"))
    return model.missing_inputs(endpoints, parameters)
