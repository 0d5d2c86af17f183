"""Paths over an edge table (src, dst): bounded hops, closure, components, distances, PageRank, cut points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import delete, shared_folder


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A frame that is written anew round by round; a round's table goes once the next one is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, shared_folder(spark), 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        if self.n:
            delete(self.spark, f"{self.base}/{self.n - 1}")
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)


def hops(edges: DataFrame, seeds: DataFrame, low: int, high: int) -> DataFrame:
    """(seed, node, depth): nodes that a path of low to high edges reaches from each seed, at their least such depth.

    seeds: node. The plan is a union of joins, so that a bounded pattern stays one query.
    """
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct()
    now = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"))
    out = now if low == 0 else None
    for k in range(1, high + 1):
        now = now.join(e, F.col("node") == F.col("__s")).select("seed", F.col("__d").alias("node"), F.lit(k).alias("depth")).distinct()
        if k >= low:
            out = now if out is None else out.unionByName(now)
    if out is None:
        raise ValueError("low may not be over high")
    return out.groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def walks(edges: DataFrame, seeds: DataFrame, low: int, high: int) -> DataFrame:
    """(seed, node, depth): a row for each walk of low to high edges from each seed, parallel edges apart.

    Walks are counted, not listed, on the way: a step joins distinct (seed, node) pairs with distinct edges and sums the
    products, so that only the last step makes as many rows as there are walks.
    """
    e = edges.groupBy(F.col("src").alias("__s"), F.col("dst").alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    now = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("n")).distinct()
    out = now if low == 0 else None
    for k in range(1, high + 1):
        now = now.join(e, F.col("node") == F.col("__s")).groupBy("seed", F.col("__d").alias("node")).agg(F.sum(F.col("n") * F.col("__n")).alias("n")).select("seed", "node", F.lit(k).alias("depth"), "n")
        if k >= low:
            out = now if out is None else out.unionByName(now)
    if out is None:
        raise ValueError("low may not be over high")
    return out.select("seed", "node", "depth", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def closure(edges: DataFrame, seeds: DataFrame, most: int = 1000) -> DataFrame:
    """(seed, node): all that each seed reaches, itself included; a worklist, each pair expanded once."""
    e = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).distinct()
    known, front = Rounds(edges.sparkSession), Rounds(edges.sparkSession)
    seen = now = known.write(seeds.select(F.col("node").alias("seed"), "node").distinct())
    for _ in range(most):
        step = now.join(e, F.col("node") == F.col("__s")).select("seed", F.col("__d").alias("node")).distinct()
        now = front.write(step.join(seen, ["seed", "node"], "left_anti"))
        if now.isEmpty():
            return seen
        seen = known.write(seen.unionByName(now))
    raise RuntimeError("the closure did not end")


def components(edges: DataFrame, nodes: DataFrame | None = None, most: int = 60) -> DataFrame:
    """(node, component): the least node of each undirected component, by alternating star contraction."""
    rounds = Rounds(edges.sparkSession)
    now = rounds.write(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    seen = mark(now)
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        now = rounds.write(large.join(least, "a").select(F.explode(pair).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        then = mark(now)
        if then == seen:
            break
        seen = then
    else:
        raise RuntimeError("star contraction did not settle")
    every = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    every = every.unionByName(nodes.select("node")) if nodes is not None else every
    return every.distinct().join(now.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def pagerank(edges: DataFrame, turns: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of turns, ranks summing to 1; dangling nodes share theirs with all."""
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n = nodes.count()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    links = cut(e.join(out, "src"))
    rank = nodes.join(out, F.col("node") == F.col("src"), "left").select("node", F.col("deg").isNull().alias("dangling"), F.lit(1.0 / max(n, 1)).alias("rank"))
    rounds = Rounds(edges.sparkSession)
    for _ in range(turns):
        rank = rounds.write(rank)
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = links.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("in"))
        base = F.lit((1 - damping) / max(n, 1) + damping * lost / max(n, 1))
        rank = rank.select("node", "dangling").join(got, F.col("node") == F.col("dst"), "left").select("node", "dangling", (base + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
    return rank.select("node", "rank")


def _both(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions, without loops and null ends."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def _reached(e: DataFrame, seeds: DataFrame, base: str, most: int) -> DataFrame:
    """(seed, node, depth) of all that each seed reaches over e (both directions), each pair written once, under base.

    Neighbours of a node at depth k are at k - 1, k or k + 1, so that only the last two rounds are looked into."""
    spark, over = e.sparkSession, e.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    now = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct()
    read = spark.read.schema(now.schema)
    for k in range(most + 1):
        now.write.parquet(f"{base}/{k}")
        now = read.parquet(f"{base}/{k}")
        if now.isEmpty():
            return read.parquet(*[f"{base}/{i}" for i in range(k + 1)])
        last = read.parquet(*[f"{base}/{i}" for i in range(max(k - 1, 0), k + 1)]).select("seed", "node")
        step = now.join(over, F.col("node") == F.col("__s")).select("seed", F.col("__d").alias("node")).distinct()
        now = step.join(last, ["seed", "node"], "left_anti").withColumn("depth", F.lit(k + 1))
    raise RuntimeError("the distances did not end")


def distances(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(seed, node, depth) of all pairs that an undirected path joins."""
    e = cut(_both(edges))
    return _reached(e, e.select(F.col("src").alias("node")), shared_folder(edges.sparkSession), most)


def lengths(edges: DataFrame, most: int = 1000, pairs: int = 1 << 24) -> DataFrame:
    """(component, n_nodes, diameter, total) of an undirected graph: each component's least node, its longest distance and the
    sum of the distances of its ordered pairs; a component's mean path is total / (n_nodes * (n_nodes - 1)).

    Pairs aren't listed where the graph is a tree. Nodes with one neighbour are folded into it round by round: an edge with
    w of a component's N nodes behind it is on the paths of 2 w (N - w) pairs. What is left, cycles and what joins them, is
    searched from each of its nodes, a folded tree counting with its weight and height; seeds are taken in blocks that reach
    about ``pairs`` nodes together, and a block's rows are summed up and deleted before the next.
    """
    spark, exact = edges.sparkSession, "decimal(38,0)"
    links, known, front = Rounds(spark), Rounds(spark), Rounds(spark)
    e = links.write(_both(edges))
    zero = F.lit(0).cast(exact)
    # Of what is folded into a node: its least node, number, height and longest path; the sums of w and w * w over its edges.
    nodes = known.write(e.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("low"), F.lit(1).cast("long").alias("w"), F.lit(0).alias("h"), F.lit(0).alias("best"), zero.alias("s1"), zero.alias("s2")))
    square = F.col("w").cast("decimal(19,0)") * F.col("w").cast("decimal(19,0)")
    for _ in range(most + 1):
        ones = e.groupBy("src").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
        back = ones.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back"))
        ones = ones.join(back, ["src", "dst"], "left").where("back is null or src > dst").drop("back")
        leaves = front.write(ones.join(nodes, F.col("src") == F.col("node")).drop("node"))
        if leaves.isEmpty():
            break
        sums = [F.min("low").alias("low2"), F.sum("w").alias("w2"), F.max("best").alias("best2"), F.sum(F.col("s1") + F.col("w")).cast(exact).alias("t1"), F.sum(F.col("s2") + square).cast(exact).alias("t2")]
        arms = leaves.groupBy("dst", (F.col("h") + 1).alias("arm")).agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("n"), *sums)
        two = F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat("arm", F.col("n")))), False), 1, 2)
        got = arms.groupBy("dst").agg(two.alias("arms"), F.min("low2").alias("low2"), F.sum("w2").alias("w2"), F.max("best2").alias("best2"), F.sum("t1").cast(exact).alias("t1"), F.sum("t2").cast(exact).alias("t2"))
        left = nodes.join(leaves.select(F.col("src").alias("node")), "node", "left_anti").join(got, F.col("node") == F.col("dst"), "left")
        high = F.sort_array(F.concat(F.coalesce("arms", F.array().cast("array<int>")), F.array("h")), False)
        added = {"w": F.col("w") + F.coalesce("w2", F.lit(0)), **{f"s{i}": (F.col(f"s{i}") + F.coalesce(f"t{i}", zero)).cast(exact) for i in (1, 2)}}
        best = F.greatest("best", "best2", F.get(high, F.lit(0)) + F.get(high, F.lit(1)))
        nodes = known.write(left.select("node", F.least("low", "low2").alias("low"), added["w"].alias("w"), F.get(high, F.lit(0)).alias("h"), best.alias("best"), added["s1"].alias("s1"), added["s2"].alias("s2")))
        gone = leaves.select("src", "dst").unionByName(leaves.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        e = links.write(e.join(gone, ["src", "dst"], "left_anti"))
    else:
        raise RuntimeError("the folding did not end")
    by = [F.sum("w").alias("n_nodes"), F.min("low").alias("low"), F.max("best").alias("best"), F.sum("s1").cast(exact).alias("s1"), F.sum("s2").cast(exact).alias("s2")]
    if e.isEmpty():
        out = nodes.withColumnRenamed("node", "component").groupBy("component").agg(*by).withColumns({"across": zero, "far": F.lit(0)})
    else:
        core = cut(components(e).join(nodes.select("node", "w", "h"), "node"))
        found = core.groupBy("component").agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        blocks = -(-int(found) // pairs)
        one, other = (core.select(*[F.col(c).alias(f"{c}_{i}") for c in core.columns]) for i in (1, 2))
        weight = F.col("w_1").cast("decimal(19,0)") * F.col("w_2").cast("decimal(19,0)") * F.col("depth")
        sums = shared_folder(spark)
        for k in range(blocks):
            base = shared_folder(spark)
            d = _reached(e, core.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k), base, most).where("depth > 0")
            d = d.join(one, F.col("seed") == F.col("node_1")).join(other, F.col("node") == F.col("node_2"))
            d = d.groupBy(F.col("component_1").alias("component")).agg(F.sum(weight).cast(exact).alias("across"), F.max(F.col("depth") + F.col("h_1") + F.col("h_2")).alias("far"))
            d.write.mode("append").parquet(sums)
            delete(spark, base)
        whole = spark.read.schema(d.schema).parquet(sums).groupBy("component").agg(F.sum("across").cast(exact).alias("across"), F.max("far").alias("far"))
        label = nodes.join(core.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        out = label.groupBy("component").agg(*by).join(whole, "component", "left").fillna(0, ["far"]).withColumn("across", F.coalesce("across", zero))
    total = 2 * (F.col("n_nodes").cast("decimal(19,0)") * F.col("s1") - F.col("s2")) + F.col("across")
    return out.select(F.col("low").alias("component"), "n_nodes", F.greatest("best", "far").alias("diameter"), total.cast(exact).alias("total"))


def cuts(edges: DataFrame) -> DataFrame:
    """(kind, a, b): bridges (a < b) and articulation points (b null) of an undirected graph, component by component.

    A component is handled in one task, as in a network map; components spread over tasks.
    """
    label = components(edges)
    own = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    kind = own.schema["a"].dataType.simpleString()

    def work(frame):
        import pandas as pd

        near: dict = {}
        for a, b in zip(frame["a"], frame["b"], strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        root = min(near)
        seen, low, rows, points, kids = {root: 0}, {root: 0}, [], set(), 0
        stack = [(root, None, iter(sorted(near[root])))]
        while stack:
            v, up, rest = stack[-1]
            for w in rest:
                if w not in seen:
                    seen[w] = low[w] = len(seen)
                    kids += v == root
                    stack.append((w, v, iter(sorted(near[w]))))
                    break
                if w != up:
                    low[v] = min(low[v], seen[w])
            else:
                stack.pop()
                if up is not None:
                    low[up] = min(low[up], low[v])
                    if low[v] > seen[up]:
                        rows.append(("bridge", min(v, up), max(v, up)))
                    if low[v] >= seen[up] and up != root:
                        points.add(up)
        if kids > 1:
            points.add(root)
        rows += [("articulation", p, None) for p in points]
        return pd.DataFrame(rows, columns=["kind", "a", "b"]).astype({"b": "Int64"} if kind in ("bigint", "int") else {})

    return own.join(label, own.a == label.node).select("a", "b", "component").groupBy("component").applyInPandas(work, f"kind string, a {kind}, b {kind}")


