"""Queries that take every row of their tables, against brute force."""

import hashlib
import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.catalogue import QUERIES
from weftgraph.functions import jsonops
from weftgraph.operators import govern, paths

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_hash_of_every_event(spark):
    got = {r["event_id"]: r["hash"] for r in table(spark, "events").select("event_id", jsonops.content_hash(F.col("props")).alias("hash")).collect()}
    text = lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"))
    assert got == {r["event_id"]: hashlib.sha256(text(r["props"]).encode()).hexdigest() for r in table(spark, "events").collect()}


def test_canonical_hash(spark):
    texts = ['{"b": 1, "a": {"d": [1, {"z": null, "y": true}], "c": "x"}}', '{"B": 1.5, "a": 2, "A": []}', '{"\u00e9": "\u00fc"}', "[1, 2]", "{}", "null"]
    got = spark.createDataFrame([(x,) for x in [*texts, "no", None]], "t string").select("t", jsonops.content_hash(F.col("t")).alias("h")).collect()
    want = {x: hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for x in texts}
    assert {r["t"]: r["h"] for r in got} == want | {"no": None, None: None}


def places(spark):
    """Customer -> nation <- supplier by real key."""
    lives = [(f"c{r['c_custkey']}", f"n{r['c_nationkey']}") for r in table(spark, "customer").collect()]
    return lives + [(f"s{r['s_suppkey']}", f"n{r['s_nationkey']}") for r in table(spark, "supplier").collect()]


def all_depths(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for seed in near:
        now, depth = {seed}, 0
        while now:
            out |= {(seed, x): depth for x in now}
            now, depth = {y for x in now for y in near[x] if (seed, y) not in out}, depth + 1
    return out


def test_distances_over_all_keys(spark):
    depths = all_depths(places(spark))
    far = [d for (a, b), d in depths.items() if a != b]
    assert [tuple(r) for r in QUERIES["i21_distances"](spark, SF).collect()] == [(max(far), round(sum(far) / len(far), 2))]


def test_cuts_over_all_keys(spark):
    # A forest: every edge is a bridge, and nations of two or more are the cut points.
    edges = places(spark)
    got = QUERIES["i22_bridges_and_cut_points"](spark, SF).collect()
    assert {(r["a"], r["b"]) for r in got if r["kind"] == "bridge"} == {(min(e), max(e)) for e in edges}
    hubs = [b for _, b in edges]
    assert {r["a"] for r in got if r["kind"] == "articulation"} == {n for n in hubs if hubs.count(n) > 1}


def test_components_and_ranks_take_every_key(spark):
    nodes = {x for e in places(spark) for x in e}
    for name in ("i20_components", "i25_pagerank"):
        assert {r["node"] for r in QUERIES[name](spark, SF).collect()} == nodes


def test_distances_end_or_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    assert {(r["seed"], r["node"]): r["depth"] for r in paths.distances(chain, 5).collect()} == {(a, b): abs(a - b) for a in range(5) for b in range(5)}
    with pytest.raises(RuntimeError):
        paths.distances(chain, 3)


@pytest.mark.parametrize("pairs", [1 << 24, 30])
def test_lengths_of_trees_and_cycles(spark, pairs):
    # Rings with trees, a grid, an edge alone, a star, a path, parallel edges, loops and null ends; a random graph.
    import random

    draw = random.Random(5)
    edges = [(i, (i + 1) % 5) for i in range(5)] + [(0, 10), (10, 11), (10, 12), (12, 13), (3, 14), (13, 15), (20, 21), (21, 20), (21, 21), (9, 9), (None, 9)]
    edges += [(30, 31 + i) for i in range(6)] + [(40 + i, 41 + i) for i in range(7)] + [(60 + i, 61 + i) for i in range(8) if i % 3 < 2] + [(60 + i, 63 + i) for i in range(6)]
    edges += [(80 + draw.randrange(14), 80 + draw.randrange(14)) for _ in range(15)] + [(100 + i, 100 + draw.randrange(i)) for i in range(1, 25)]
    edges += [(200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (204, 205), (205, 206), (206, 204), (206, 207)]
    depths = all_depths([(a, b) for a, b in edges if None not in (a, b) and a != b])
    want = {}
    for (a, b), d in depths.items():
        least = min(y for x, y in depths if x == a)
        n, far, total = want.get(least, (0, 0, 0))
        want[least] = (n + (a == b), max(far, d), total + d)
    frame = spark.createDataFrame(edges, "src long, dst long")
    assert {r["component"]: (r["n_nodes"], r["diameter"], int(r["total"])) for r in paths.lengths(frame, pairs=pairs).collect()} == want


def test_lengths_end_or_raise(spark):
    for edges in ([(i, i + 1) for i in range(8)], [(i, (i + 1) % 9) for i in range(9)]):
        frame = spark.createDataFrame(edges, "src long, dst long")
        assert paths.lengths(frame, 5).count() == 1
        with pytest.raises(RuntimeError):
            paths.lengths(frame, 2)
    assert paths.lengths(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_distances_of_a_large_star(spark, tmp_path):
    # Ten billion pairs: they can't be listed.
    spark.range(100_000).selectExpr("id as c_custkey", "cast(if(id < 99999, 3, 7) as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 3), (2, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [tuple(r) for r in QUERIES["i21_distances"](spark, str(tmp_path)).collect()] == [(2, 2.0)]
    edges = spark.read.parquet(f"{tmp_path}/customer.parquet").select(F.col("c_custkey").alias("src"), (-F.col("c_nationkey")).cast("long").alias("dst"))
    m = 99_999
    assert {tuple(int(x) for x in r) for r in paths.lengths(edges).collect()} == {(-3, m + 1, 2, 2 * m * (m - 1) + 2 * m), (-7, 2, 1, 2)}


def test_reach_of_every_seed(spark):
    # 4 -> 5 -> 6 -> 7 -> 8 goes past three steps, 9 has no edge.
    step = {1: 2, 4: 5, 5: 6, 6: 7, 7: 8}
    edges = spark.createDataFrame(list(step.items()), "src long, dst long")
    seeds = spark.range(1, 10).withColumnRenamed("id", "node")
    want = {}
    for seed in range(1, 10):
        at, depth = seed, 0
        while at:
            want[seed, at] = depth
            at, depth = step.get(at), depth + 1
    assert {(r["seed"], r["node"]) for r in paths.closure(edges, seeds).collect()} == set(want)
    got = {(r["seed"], r["node"]): r["depth"] for r in paths.hops(edges, seeds, 0, 3).collect()}
    assert got == {k: d for k, d in want.items() if d <= 3}


def test_neighbours_and_merge_over_all_orders(spark, tmp_path):
    # Customers over 20 and orders over 400, which the subsets would leave out.
    orders = [(500, 30), (501, 30), (502, 30), (503, 31), (1, 2), (2, 2)]
    lines = [(500, 7, 10.0), (501, 7, 45.0), (502, 8, 40.0), (503, 7, 1.0), (503, 7, 2.0), (1, 9, 50.0), (2, 6, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in QUERIES["c18_neighbours"](spark, str(tmp_path)).collect())
    assert got == sorted((a, b) for a, c in orders for b, d in orders if c == d and a != b)
    cust = dict(orders)
    got = sorted(tuple(r) for r in QUERIES["d04_merge_edges"](spark, str(tmp_path)).select("src", "dst").collect())
    assert got == sorted({(cust[o], s) for o, s, _ in lines})


def capped(docs, most):
    out, total = set(), None
    for i, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        total = total if text is None else (total or 0) + len(text.encode())
        if total is not None and total <= most:
            out.add((i, total))
    return out


def test_byte_cap_over_all_documents(spark, tmp_path):
    # Ids from 2000 on, and 2,000 null or empty texts in front.
    docs = [(2000 + i, None if i < 1000 else "") for i in range(2100)] + [(9000 + 7 * i, "\u00e9" * 600) for i in range(100)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["running_bytes"]) for r in QUERIES["j04_byte_cap"](spark, str(tmp_path)).collect()}
    assert got == capped(docs, govern.BYTES) and max(b for _, b in got) > 48_000


@pytest.mark.parametrize("docs", [[], [(None, "abc"), (5, "x" * 4), (-(2**63), "yy"), (2**63 - 1, "z")], [(1, None), (2, None)], [(1, "x" * 99)]])
def test_byte_cap_edges(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (0, 3, 6, 8, 50):
        got = {tuple(r) for r in govern.cap_bytes_by_id(frame, "doc_id", F.col("text"), most, 3, 1).select("doc_id", "running_bytes").collect()}
        assert got == capped(docs, most)


def test_parity_of_keys_with_like_hashes(spark, tmp_path):
    # The SHA-1 of 98641 and of 393117, as text, begin with the same 32 bits.
    keys = [0, 98641, 2, 3, 4, 393117, 6, 7]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in QUERIES["e20_structural_parity"](spark, str(tmp_path)).collect()] == [(6, 2, 2, 0.75)]
