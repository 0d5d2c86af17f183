"""The property graph: a registry of node and relationship tables, each a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


@dataclass
class Rel:
    table: DataFrame | Callable[[], DataFrame]  # src, dst and properties; a function's table is read when it is first asked for
    src_label: str
    dst_label: str

    @property
    def df(self) -> DataFrame:
        if callable(self.table):
            self.table = self.table()
        return self.table

    @df.setter
    def df(self, table: DataFrame) -> None:
        self.table = table


@dataclass
class PropertyGraph:
    nodes: dict[str, tuple[DataFrame | Callable[[], DataFrame], str]] = field(default_factory=dict)
    rels: dict[str, list[Rel]] = field(default_factory=dict)

    def add_node(self, label: str, df: DataFrame | Callable[[], DataFrame], pk: str) -> PropertyGraph:
        self.nodes[label] = (df, pk)
        return self

    def add_rel(self, name: str, df: DataFrame | Callable[[], DataFrame], src_label: str, dst_label: str) -> PropertyGraph:
        self.rels.setdefault(name, []).append(Rel(df, src_label, dst_label))
        return self

    def node(self, label: str) -> DataFrame:
        df, pk = self.nodes[label]
        if callable(df):
            df = df()
            self.nodes[label] = (df, pk)
        return df

    def pk(self, label: str) -> str:
        return self.nodes[label][1]

    def rel(self, *names: str) -> DataFrame:
        """Edges of the named tables: src, dst, rel, the labels of both ends, and properties."""
        frames = [r.df.withColumns({"rel": F.lit(n), "src_label": F.lit(r.src_label), "dst_label": F.lit(r.dst_label)}) for n in names for r in self.rels[n]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def labels(self, *names: str) -> DataFrame:
        """Nodes of several labels with ``_label``, missing columns null; other labels' tables aren't read."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.node(n).withColumn("_label", F.lit(n)) for n in names])

    def whole(self, label: str) -> DataFrame:
        """Nodes as one struct column ``n`` with their label."""
        return self.node(label).select(F.struct(F.lit(label).alias("_label"), "*").alias("n"))

    def load_nodes(self, label: str, rows: DataFrame) -> PropertyGraph:
        """Append rows; keys that are there twice, or there already, are an error."""
        old, pk = self.node(label), self.pk(label)
        both = old.select(pk).unionByName(rows.select(pk))
        if twice := both.groupBy(pk).count().where("count > 1").limit(5).collect():
            raise ValueError(f"{label}: keys {[r[0] for r in twice]} are there twice")
        self.nodes[label] = (old.unionByName(rows, allowMissingColumns=True), pk)
        return self

    def load_rels(self, name: str, rows: DataFrame) -> PropertyGraph:
        """Append edges; ends that are no nodes are an error."""
        r = self.rels[name][0]
        for end, label in (("src", r.src_label), ("dst", r.dst_label)):
            keys = self.node(label).select(F.col(self.pk(label)).alias(end))
            if lost := rows.join(keys, end, "left_anti").limit(5).collect():
                raise ValueError(f"{name}: {end} of {lost[:5]} are no {label}")
        r.df = r.df.unionByName(rows, allowMissingColumns=True)
        return self

    def add_column(self, label: str, name: str, kind: str | DataType) -> PropertyGraph:
        """A null column, unless it is there."""
        df, pk = self.node(label), self.pk(label)
        if name not in df.columns:
            self.nodes[label] = (df.withColumn(name, F.lit(None).cast(kind)), pk)
        return self

    def counts(self) -> DataFrame:
        """(kind, name, n) of every table, in one job."""
        each = [self.node(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), F.lit(n).alias("name"), "n") for n in self.nodes]
        each += [self.rel(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rel").alias("kind"), F.lit(n).alias("name"), "n") for n in self.rels]
        return reduce(DataFrame.union, each)

    def describe(self) -> str:
        """The schema as Markdown."""
        out = ["## Nodes"]
        for n in sorted(self.nodes):
            df, pk = self.node(n), self.pk(n)
            out.append(f"- **{n}** (key {pk}): " + ", ".join(f"{c} {t}" for c, t in df.dtypes))
        out.append("## Relationships")
        for n, own in sorted(self.rels.items()):
            out += [f"- **{n}**: {r.src_label} -> {r.dst_label}" + "".join(f", {c} {t}" for c, t in r.df.dtypes if c not in ("src", "dst")) for r in own]
        return "\n".join(out)

    def hint(self) -> str:
        nodes = "; ".join(f"{n}({', '.join(df.columns)})" for n, df in sorted((n, self.node(n)) for n in self.nodes))
        rels = "; ".join(f"{r.src_label}-[{n}]->{r.dst_label}" for n, own in sorted(self.rels.items()) for r in own)
        return f"{nodes} | {rels}"

    def property_hint(self, label: str, name: str) -> str:
        """What to say when a label has no such property."""
        if label not in self.nodes:
            return f"There is no label {label}; labels are {', '.join(sorted(self.nodes))}."
        return f"{label} has no property {name}; it has {', '.join(self.node(label).columns)}."


def driver_graph(spark, sf_dir: str) -> PropertyGraph:
    """The driver's tables as a graph, its edges from foreign keys. A table is opened when a query names it."""
    opened: dict[str, DataFrame] = {}

    def t(name: str) -> DataFrame:
        if name not in opened:
            opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return opened[name]

    def edge(name: str, a: str, b: str, *more: str) -> Callable[[], DataFrame]:
        return lambda: t(name).select(F.col(a).alias("src"), F.col(b).alias("dst"), *more)

    keys = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}
    g = PropertyGraph()
    for label, (name, pk) in keys.items():
        g.add_node(label, lambda name=name: t(name), pk)
    g.add_rel("IN_REGION", edge("nation", "n_nationkey", "n_regionkey"), "Nation", "Region")
    g.add_rel("LIVES_IN", edge("customer", "c_custkey", "c_nationkey"), "Customer", "Nation")
    g.add_rel("BASED_IN", edge("supplier", "s_suppkey", "s_nationkey"), "Supplier", "Nation")
    g.add_rel("PLACED_BY", edge("orders", "o_orderkey", "o_custkey"), "Order", "Customer")
    g.add_rel("HAS_PART", edge("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity"), "Order", "Part")
    g.add_rel("SHIPPED_BY", edge("lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity"), "Order", "Supplier")
    return g
