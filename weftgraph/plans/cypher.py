"""A subset of openCypher, compiled to DataFrame joins.

Clauses: MATCH, OPTIONAL MATCH (each with WHERE), UNWIND, CALL ... YIELD, WITH (with WHERE, ORDER BY, SKIP, LIMIT), RETURN,
UNION [ALL]. Patterns: labels and label disjunctions in WHERE, property maps (on bound nodes too), both directions,
alternated relationships, edge variables, bounded variable length (one row for each walk). ``EXISTS { MATCH ... }`` is a
semi-join and ``NOT EXISTS`` an anti-join where they stand as conjuncts of a WHERE, and a joined mark elsewhere. A variable's properties are flat columns named ``var.prop``, so that Catalyst
prunes what a query doesn't name. Write clauses are refused.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.paths import hops, walks
from weftgraph.plans.graph import PropertyGraph

_TOKEN = re.compile(r"\s+|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+|\d+)|(?P<par>\$\w+)|(?P<id>\w+|`[^`]+`)|(?P<op><-|->|<=|>=|<>|\.\.|[-\[\](){}<>=,.:*+/%|])")
WRITES = {"create", "merge", "set", "delete", "remove", "drop", "alter", "copy", "load", "install", "detach"}
AGGREGATES = {"count", "collect", "sum", "avg", "min", "max"}
FUNCTIONS = {"tolower": F.lower, "toupper": F.upper, "trim": F.trim, "coalesce": F.coalesce, "abs": F.abs, "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.try_cast("long"), "tofloat": lambda c: c.try_cast("double"), "list_contains": F.array_contains, "round": F.round, "timestamp": lambda c=None: F.current_timestamp() if c is None else F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")), "current_timestamp": F.current_timestamp, "ends_with": F.endswith, "split": lambda s, d: F.split(s, F.regexp_replace(d, r"([\W])", r"\\$1")), "left": F.left, "right": F.right, "substring": lambda s, a, n: F.substring(s, a + 1, n)}


#: Units of a duration, with their lengths in seconds.
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
TYPES = {"string": "string", "int64": "long", "int32": "int", "int": "int", "double": "double", "float": "float", "bool": "boolean", "boolean": "boolean", "timestamp": "timestamp", "date": "date"}
#: Table functions of CALL: name -> (graph, arguments) -> DataFrame.
PROCEDURES: dict[str, Any] = {}


def procedure(name: str):
    """Register a table function that ``CALL name(...) YIELD ...`` can read."""

    def register(f):
        PROCEDURES[name.lower()] = f
        return f

    return register


class CypherError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected {text[at : at + 12]!r}")
            if m.lastgroup:
                self.toks.append((m.lastgroup, m[0]))
            at = m.end()
        self.i = 0

    def peek(self, k: int = 0) -> str:
        return self.toks[self.i + k][1].lower() if self.i + k < len(self.toks) else ""

    def kind(self) -> str:
        return self.toks[self.i][0] if self.i < len(self.toks) else ""

    def take(self) -> str:
        if self.i >= len(self.toks):
            raise CypherError("the query ends too early")
        self.i += 1
        return self.toks[self.i - 1][1]

    def ate(self, *words: str) -> bool:
        if all(self.peek(k) == w and (w[0].isalpha() is False or self.toks[self.i + k][0] == "id") for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.ate(word):
            raise CypherError(f"expected {word!r}, found {self.peek()!r}")

    def name(self) -> str:
        kind, x = self.toks[self.i] if self.i < len(self.toks) else ("", "")
        if kind != "id":
            raise CypherError(f"expected a name, found {x!r}")
        self.i += 1
        return x.strip("`")


def _turned(edges: DataFrame) -> DataFrame:
    ends = {"src": "dst", "dst": "src", "src_label": "dst_label", "dst_label": "src_label"}
    return edges.select(*[F.col(ends.get(c, c)).alias(c) for c in edges.columns])


class _Marked(Exception):
    """An EXISTS that isn't a conjunct."""


class Query:
    def __init__(self, graph: PropertyGraph, text: str, params: dict[str, Any] | None = None):
        self.graph, self.params, self.p = graph, params or {}, _Parser(text)
        if not isinstance(self.params, dict):
            raise CypherError("parameters must be an object")
        for k, (kind, x) in enumerate(self.p.toks):
            if kind == "id" and x.lower() in WRITES and (k == 0 or self.p.toks[k - 1][1] not in (".", ":")):
                raise CypherError(f"{x.upper()} is not allowed in a read query")
        self.df: DataFrame | None = None
        self.vars: dict[str, list[str]] = {}  # node and edge variables: their properties
        self.fresh = 0
        self.marks: list[tuple[str, DataFrame, list[str]]] | None = None  # EXISTS within an expression: what to join before it is used

    # ---- clauses
    def run(self) -> DataFrame:
        out = self._single()
        while self.p.ate("union"):
            keep = self.p.ate("all")
            self.df, self.vars = None, {}
            out = out.union(self._single())
            out = out if keep else out.distinct()
        if self.p.i < len(self.p.toks):
            raise CypherError(f"unexpected {self.p.peek()!r}")
        return out

    def _single(self) -> DataFrame:
        p = self.p
        while True:
            if p.ate("optional", "match"):
                self._match(True)
            elif p.ate("match"):
                self._match(False)
            elif p.ate("unwind"):
                items = self._expr()
                p.need("as")
                name = p.name()
                base = self._base()
                self.df = base.withColumn(name, F.explode(items))
            elif p.ate("call"):
                self._call_procedure()
            elif p.ate("with"):
                self._project(False)
                if p.ate("where"):
                    self.df = self._filtered(self.df)
            elif p.ate("return"):
                self._project(True)
                return self.df
            else:
                raise CypherError(f"unexpected {p.peek()!r}")

    def _call_procedure(self) -> None:
        """CALL f(arguments) YIELD a [AS b], ...: the function's rows, joined with what is there if anything is."""
        p, name = self.p, self.p.name().lower()
        if name not in PROCEDURES:
            raise CypherError(f"there is no procedure {name}; they are {', '.join(sorted(PROCEDURES))}")
        p.need("(")
        args = []
        while not p.ate(")"):
            args.append(self._value())
            p.ate(",")
        rows, picked = PROCEDURES[name](self.graph, *args), []
        if p.ate("yield"):
            while True:
                col = p.name()
                if col not in rows.columns:
                    raise CypherError(f"{name} yields {', '.join(rows.columns)}, not {col}")
                picked.append(F.col(f"`{col}`").alias(p.name() if p.ate("as") else col))
                if not p.ate(","):
                    break
            rows = rows.select(*picked)
        if p.peek() == "where":
            raise CypherError("no WHERE after YIELD; put WITH before it")
        self.df = rows if self.df is None else self.df.join(rows)

    def _value(self) -> Any:
        """A constant or a parameter as a Python value."""
        kind, x = self.p.kind(), self.p.take()
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", x[1:-1])
        if kind == "num":
            return float(x) if "." in x else int(x)
        if kind == "par" and x[1:] in self.params:
            return self.params[x[1:]]
        raise CypherError(f"a procedure takes constants and parameters, not {x!r}")

    # ---- conditions
    def _filtered(self, df: DataFrame) -> DataFrame:
        """df under the condition that follows."""
        p, start = self.p, self.p.i
        plain: list[Column] = []
        tests: list[tuple[bool, DataFrame, Column]] = []
        while True:
            at = p.i
            wanted = not p.ate("not")
            if p.ate("exists", "{"):
                tests.append((wanted, *self._exists(df)))
            else:
                p.i, self.marks = at, None
                try:
                    plain.append(self._not())
                except _Marked:
                    plain, tests = [], []
                    break
            if not p.ate("and"):
                break
        else:
            pass
        if plain or tests:
            if p.peek() != "or":
                for c in plain:
                    df = df.where(c)
                for wanted, other, cond in tests:
                    df = df.join(other, cond, "left_semi" if wanted else "left_anti")
                return df
        p.i, self.marks = start, []
        kept = self.df
        self.df = df
        cond = self._expr()
        self.df = kept
        columns = df.columns
        for name, other, on in self.marks:
            df = df.join(other.select(*[F.col(f"`__m.{v}._id`") for v in on]).distinct().withColumn(name, F.lit(True)), reduce(lambda a, b: a & b, [F.col(f"`{v}._id`").eqNullSafe(F.col(f"`__m.{v}._id`")) for v in on]), "left")
        self.marks = None
        return df.where(cond).select(*[F.col(f"`{c}`") for c in columns])

    def _exists(self, outer: DataFrame) -> tuple[DataFrame, Column]:
        """The rows of a pattern in braces, and the condition that joins them with outer; its own variables stay within."""
        p = self.p
        if not p.ate("match"):
            raise CypherError("EXISTS takes a MATCH in braces")
        known, kept = dict(self.vars), self.df
        found: DataFrame | None = None
        while True:
            found = self._path(found, set())
            if not p.ate(","):
                break
        shared = [v for v in known if f"{v}._id" in found.columns and f"{v}._id" in outer.columns]
        for v in shared:
            found = found.withColumnsRenamed({c: f"__m.{c}" for c in found.columns if c.startswith(f"{v}.")})
        conds = [F.col(f"`{v}._id`") == F.col(f"`__m.{v}._id`") for v in shared]
        if p.ate("where"):
            self.df = outer
            conds.append(self._expr())
            self.df = kept
        p.need("}")
        self.vars, self.df = known, kept
        return found, reduce(lambda a, b: a & b, conds) if conds else F.lit(True)

    def _mark(self) -> Column:
        """EXISTS within a larger expression: a mark that the outer rows are joined with."""
        if self.marks is None:
            raise _Marked
        p = self.p
        known = dict(self.vars)
        found: DataFrame | None = None
        p.need("match")
        while True:
            found = self._path(found, set())
            if not p.ate(","):
                break
        if p.ate("where"):
            kept, self.df = self.df, found
            found = found.where(self._expr())
            self.df = kept
        p.need("}")
        on = [v for v in known if f"{v}._id" in found.columns and f"{v}._id" in self.df.columns]
        if not on:
            raise CypherError("an EXISTS within OR or CASE needs a variable of the query")
        self.vars = known
        name = f"__e.{len(self.marks)}"
        self.marks.append((name, found.withColumnsRenamed({f"{v}._id": f"__m.{v}._id" for v in on}), on))
        return F.col(f"`{name}`").isNotNull()

    def _base(self) -> DataFrame:
        if self.df is None:
            self.df = SparkSession.active().range(1).select()
        return self.df

    # ---- patterns
    def _load(self, var: str, labels: list[str]) -> DataFrame:
        for x in labels:
            if x not in self.graph.nodes:
                raise CypherError(self.graph.property_hint(x, ""))
        frames = []
        for x in labels:
            df = self.graph.node(x)
            frames.append(df.select(F.col(self.graph.pk(x)).alias(f"{var}._id"), F.lit(x).alias(f"{var}._label"), *[F.col(c).alias(f"{var}.{c}") for c in df.columns]))
        self.vars[var] = list(dict.fromkeys(c.removeprefix(f"{var}.") for f in frames for c in f.columns if not c.startswith(f"{var}._")))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def _node(self) -> tuple[str, list[str], dict[str, Column]]:
        p = self.p
        p.need("(")
        var = p.name() if p.kind() == "id" else self._new()
        labels = []
        while p.ate(":") or p.ate("|"):
            labels.append(p.name())
        return var, labels, self._map(")")

    def _map(self, end: str) -> dict[str, Column]:
        out: dict[str, Column] = {}
        if self.p.ate("{"):
            while not self.p.ate("}"):
                key = self.p.name()
                self.p.need(":")
                out[key] = self._expr()
                self.p.ate(",")
        self.p.need(end)
        return out

    def _new(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    def _rel(self) -> tuple[str, list[str], dict[str, Column], int, int, str]:
        p = self.p
        back = p.ate("<-")
        if not back:
            p.need("-")
        var, names, props, lo, hi = self._new(), [], {}, 1, 1
        if p.ate("["):
            if p.kind() == "id":
                var = p.name()
            while p.ate(":") or p.ate("|"):
                p.ate(":")
                names.append(p.name())
            if p.ate("*"):
                lo = int(p.take()) if p.kind() == "num" else 1
                hi = int(p.take()) if p.ate("..") else lo
            props = self._map("]")
        if back:
            p.need("-")
            return var, names, props, lo, hi, "in"
        return var, names, props, lo, hi, "out" if p.ate("->") else (p.need("-") or "both")

    def _match(self, optional: bool) -> None:
        p, known = self.p, set(self.vars)
        found: DataFrame | None = None
        while True:
            found = self._path(found, known)
            if not p.ate(","):
                break
        shared = [v for v in known if f"{v}._id" in found.columns]
        if self.df is None:
            self.df = self._filtered(found) if p.ate("where") else found
            return
        for v in shared:
            found = found.withColumnsRenamed({c: f"__m.{c}" for c in found.columns if c.startswith(f"{v}.")})
        on = [F.col(f"`{v}._id`") == F.col(f"`__m.{v}._id`") for v in shared]
        cond = reduce(lambda a, b: a & b, on) if on else F.lit(True)
        if optional and p.peek() == "where":
            p.take()
            cond = cond & self._expr()
        self.df = self.df.join(found, cond, "left" if optional else "inner")
        self.df = self.df.select(*[F.col(f"`{c}`") for c in self.df.columns if not c.startswith("__m.")])
        if not optional and p.ate("where"):
            self.df = self._filtered(self.df)

    def _path(self, found: DataFrame | None, known: set[str]) -> DataFrame:
        p = self.p
        var, labels, props = self._node()
        steps = []
        while p.peek() in ("-", "<-"):
            rel = self._rel()
            steps.append((rel, self._node()))
        labels_of = {var: labels, **{n[0]: n[1] for _, n in steps}}
        at = var
        for (_, names, _, lo, hi, way), (to, _, _) in steps:  # unlabelled ends take their label from the relationship
            ends = [(r.src_label, r.dst_label) for n in names for r in self.graph.rels.get(n, [])]
            if ends and way != "both":
                a, b = (at, to) if way == "out" else (to, at)
                labels_of[a] = labels_of.get(a) or sorted({x for x, _ in ends})
                labels_of[b] = labels_of.get(b) or sorted({y for _, y in ends})
            at = to
        df = found

        def bring(v: str, own: dict[str, Column]) -> DataFrame:
            if not labels_of.get(v):
                labels_of[v] = sorted(self.graph.nodes)
            new = self._load(v, labels_of[v])
            for k, x in own.items():
                new = new.where(F.col(f"`{v}.{k}`") == x)
            return new

        def narrowed(df: DataFrame, v: str, own: dict[str, Column], named: list[str]) -> DataFrame:
            """df where a node that is there already has these labels and properties too."""
            for k, x in own.items():
                if k not in self.vars[v]:
                    raise CypherError(f"{v} has no property {k}; it has {', '.join(self.vars[v])}.")
                df = df.where(F.col(f"`{v}.{k}`") == x)
            return df.where(F.col(f"`{v}._label`").isin(named)) if named else df

        if df is None or f"{var}._id" not in df.columns:
            new = bring(var, props)
            df = new if df is None else df.join(new)
        else:
            df = narrowed(df, var, props, labels)
        at = var
        for (rvar, names, rprops, lo, hi, way), (to, named, own) in steps:
            for n in names or sorted(self.graph.rels):
                if n not in self.graph.rels:
                    raise CypherError(f"There is no relationship {n}; they are {', '.join(sorted(self.graph.rels))}.")
            edges = self.graph.rel(*(names or sorted(self.graph.rels)))
            for k, x in rprops.items():
                edges = edges.where(F.col(k) == x)
            if way == "in":
                edges = _turned(edges)
            elif way == "both":
                edges = edges.unionByName(_turned(edges))
            if (lo, hi) != (1, 1):
                key = lambda label, node, name: F.struct(F.col(label).alias("l"), F.col(node).alias("k")).alias(name)  # noqa: E731  keys of two labels may be equal
                seeds = df.select(key(f"`{at}._label`", f"`{at}._id`", "node")).distinct()
                reach = hops if self._only_distinct() else walks
                edges = reach(edges.select(key("src_label", "src", "src"), key("dst_label", "dst", "dst")), seeds, lo, hi)
                edges = edges.select(F.col("seed.k").alias("src"), F.col("node.k").alias("dst"), F.col("seed.l").alias("src_label"), F.col("node.l").alias("dst_label"))
            flat = edges.select(*[F.col(c).alias(f"{rvar}.{c}") for c in edges.columns])
            self.vars[rvar] = [c for c in edges.columns if c not in ("src", "dst", "rel", "src_label", "dst_label")]
            df = df.join(flat, self._meets(edges, at, rvar, "src", labels_of[at] if (lo, hi) == (1, 1) else None))
            if f"{to}._id" in df.columns:
                df = narrowed(df.where(self._meets(edges, to, rvar, "dst", labels_of.get(to) if (lo, hi) == (1, 1) else None)), to, own, named)
            else:
                new = bring(to, own)
                df = df.join(new, self._meets(edges, to, rvar, "dst", labels_of[to] if (lo, hi) == (1, 1) else None))
            at = to
        return df

    def _only_distinct(self) -> bool:
        """Whether the next projection is DISTINCT without aggregates, so that the number of walks doesn't matter."""
        toks = [x.lower() for _, x in self.p.toks[self.p.i :]]
        at = next((k for k, x in enumerate(toks) if x in ("return", "with") and toks[k - 1] not in ("starts", "ends")), len(toks))
        return toks[at + 1 : at + 2] == ["distinct"] and not AGGREGATES.intersection(toks[at:])

    def _meets(self, edges: DataFrame, node: str, rel: str, end: str, labels: list[str] | None) -> Column:
        """The node is the edge's end; with several labels their keys may be equal, so that labels must be too."""
        same = F.col(f"`{rel}.{end}`") == F.col(f"`{node}._id`")
        if f"{end}_label" in edges.columns and (not labels or len(labels) > 1):
            same = same & (F.col(f"`{rel}.{end}_label`") == F.col(f"`{node}._label`"))
        return same

    # ---- projections
    def _project(self, final: bool) -> None:
        p = self.p
        base, distinct = self._base(), p.ate("distinct")
        items: list[tuple[str, Column, bool, str | None]] = []
        while True:
            start = p.i
            agg = self._has_aggregate()
            c = self._expr()
            text = "".join(x for _, x in p.toks[start : p.i])
            var = text if p.i == start + 1 and text in self.vars else None
            alias = p.name() if p.ate("as") else text
            items.append((alias, c, agg, var))
            if not p.ate(","):
                break
        keep_vars = {} if final else {a: self.vars[v] for a, _, _, v in items if v}
        plain: list[Column] = []
        for alias, c, agg, var in items:
            if agg:
                continue
            if var and not final:
                plain += [F.col(f"`{x}`").alias(alias + x[len(var) :]) for x in base.columns if x.startswith(f"{var}.")]
            else:
                plain.append(c.alias(alias))
        aggs = [c.alias(a) for a, c, agg, _ in items if agg]
        if aggs:
            out = base.groupBy(*plain).agg(*aggs)
            if final:
                out = out.select(*[F.col(f"`{a}`") for a, *_ in items])
        else:
            out = base.select(*plain) if not final or distinct else base.select(*[F.col(f"`{x}`") for x in base.columns], *[c.alias(f"__r.{k}") for k, (_, c, _, _) in enumerate(items)])
        if distinct:
            out = out.distinct()
        keep_base = final and not aggs and not distinct
        self.df = out
        if keep_base:
            self.alias = {a: f"__r.{k}" for k, (a, *_) in enumerate(items)}
        else:
            self.alias = {}
            self.vars = keep_vars
        if p.ate("order", "by"):
            keys = []
            while True:
                c = self._expr()
                keys.append(c.desc_nulls_last() if p.ate("desc") or p.ate("descending") else c.asc_nulls_last())
                p.ate("asc")
                if not p.ate(","):
                    break
            self.df = self.df.orderBy(*keys)
        if p.ate("skip"):
            self.df = self.df.offset(self._number())
        if p.ate("limit"):
            self.df = self.df.limit(self._number())
        if keep_base:
            self.df = self.df.select(*[F.col(f"`__r.{k}`").alias(a) for k, (a, *_) in enumerate(items)])
            self.alias = {}

    def _number(self) -> int:
        x = self.p.take()
        return int(self.params[x[1:]] if x[0] == "$" else x)

    def _has_aggregate(self) -> bool:
        depth, k = 0, self.p.i
        while k < len(self.p.toks):
            kind, x = self.p.toks[k]
            if depth == 0 and (x == "," or kind == "id" and x.lower() in ("as", "order", "skip", "limit", "match", "optional", "return", "with", "union", "unwind", "where")):
                return False
            if kind == "id" and x.lower() in AGGREGATES and self.p.toks[k + 1 : k + 2] and self.p.toks[k + 1][1] == "(":
                return True
            depth += (x in "([{") - (x in ")]}")
            k += 1
        return False

    # ---- expressions
    def _expr(self, found_labels: bool = False) -> Column:
        c = self._and()
        while self.p.ate("or"):
            c = c | self._and()
        return c

    def _and(self) -> Column:
        c = self._not()
        while self.p.ate("and"):
            c = c & self._not()
        return c

    def _not(self) -> Column:
        if self.p.ate("exists", "{"):
            return self._mark()
        return ~self._not() if self.p.ate("not") else self._compare()

    def _compare(self) -> Column:
        p, c = self.p, self._sum()
        while True:
            if p.ate("is", "not", "null"):
                c = c.isNotNull()
            elif p.ate("is", "null"):
                c = c.isNull()
            elif p.ate("contains"):
                c = c.contains(self._sum())
            elif p.ate("starts", "with"):
                c = c.startswith(self._sum())
            elif p.ate("ends", "with"):
                c = c.endswith(self._sum())
            elif p.ate("in"):
                c = F.array_contains(self._sum(), c)
            elif p.peek() in ("=", "<>", "<", ">", "<=", ">="):
                op, d = p.take(), self._sum()
                c = {"=": c == d, "<>": c != d, "<": c < d, ">": c > d, "<=": c <= d, ">=": c >= d}[op]
            else:
                return c

    def _sum(self) -> Column:
        c = self._product()
        while self.p.peek() in ("+", "-"):
            c = c + self._product() if self.p.take() == "+" else c - self._product()
        return c

    def _product(self) -> Column:
        c = self._atom()
        while self.p.peek() in ("*", "/", "%"):
            op, d = self.p.take(), self._atom()
            c = c * d if op == "*" else c / d if op == "/" else c % d
        return c

    def _atom(self) -> Column:
        p = self.p
        if p.i >= len(p.toks):
            raise CypherError("the query ends too early")
        kind, x = p.toks[p.i]
        p.i += 1
        if kind == "str":
            c = F.lit(re.sub(r"\\(.)", r"\1", x[1:-1]))
        elif kind == "num":
            c = F.lit(float(x) if "." in x else int(x))
        elif kind == "par":
            if x[1:] not in self.params:
                raise CypherError(f"parameter {x} is missing")
            v = self.params[x[1:]]
            c = F.array(*[F.lit(y) for y in v]) if isinstance(v, list) else F.lit(v)
        elif x == "(":
            c = self._expr()
            p.need(")")
        elif x == "-":
            c = -self._atom()
        elif x == "[":
            items = []
            while not p.ate("]"):
                items.append(self._expr())
                p.ate(",")
            c = F.array(*items) if items else F.array().cast("array<string>")
        elif kind == "id":
            c = self._named(x)
        else:
            raise CypherError(f"unexpected {x!r}")
        while p.ate("["):
            c = c[self._expr()]
            p.need("]")
        return c

    def _named(self, x: str) -> Column:
        p, low = self.p, x.lower()
        if low in ("true", "false"):
            return F.lit(low == "true")
        if low == "null":
            return F.lit(None)
        if low == "case":
            return self._case()
        x = x.strip("`")
        if p.peek() == "(":
            return self._call(low)
        if p.peek() == "." and p.toks[p.i + 1][0] == "id" and x in self.vars:
            p.take()
            prop = p.name()
            if prop not in self.vars[x]:
                raise CypherError(f"{x} has no property {prop}; it has {', '.join(self.vars[x])}.")
            return F.col(f"`{x}.{prop}`")
        if p.peek() == ":" and x in self.vars:
            p.take()
            return F.col(f"`{x}._label`") == p.name()
        if x in getattr(self, "alias", {}):
            return F.col(f"`{self.alias[x]}`")
        if p.peek() == "." and p.toks[p.i + 1][0] == "id":
            p.take()
            x = f"{x}.{p.name()}"
        if x in self.vars:
            return F.struct(F.col(f"`{x}._label`").alias("_label"), *[F.col(f"`{x}.{c}`").alias(c) for c in self.vars[x]]) if f"{x}._label" in self._base().columns else F.col(f"`{x}.src`")
        return F.col(f"`{x}`")

    def _case(self) -> Column:
        p, out = self.p, None
        while p.ate("when"):
            cond = self._expr()
            p.need("then")
            value = self._expr()
            out = F.when(cond, value) if out is None else out.when(cond, value)
        if p.ate("else"):
            out = out.otherwise(self._expr())
        p.need("end")
        return out

    def _call(self, name: str) -> Column:
        p = self.p
        p.need("(")
        if name in ("exists",) and p.peek() == "(":
            raise CypherError("EXISTS takes a MATCH in braces")
        if name == "count" and p.ate("*"):
            p.need(")")
            return F.count(F.lit(1))
        distinct = p.ate("distinct")
        if name in ("count", "collect", "labels", "id") and p.kind() == "id" and p.peek(1) == ")" and p.toks[p.i][1] in self.vars:
            v = p.name()
            p.need(")")
            key = f"{v}._id" if f"{v}._id" in self._base().columns or name in ("labels", "id") else f"{v}.src"
            if name == "labels":
                return F.array(F.col(f"`{v}._label`"))
            c = F.col(f"`{key}`")
            return c if name == "id" else F.count_distinct(c) if distinct else F.count(c) if name == "count" else F.array_sort(F.collect_list(c))
        if name == "cast":
            c = self._expr()
            p.need("as")
            kind = p.name().lower()
            if kind not in TYPES:
                raise CypherError(f"there is no type {kind}")
            kind = f"array<{TYPES[kind]}>" if p.ate("[") and p.ate("]") else TYPES[kind]
            p.need(")")
            return c.cast(kind)
        if name in ("duration", "interval") and p.ate("{"):
            parts = []
            while not p.ate("}"):
                unit = p.name().lower()
                if unit not in UNITS:
                    raise CypherError(f"there is no unit {unit}")
                p.need(":")
                parts.append(self._expr() * UNITS[unit])
                p.ate(",")
            p.need(")")
            return F.make_dt_interval(secs=reduce(lambda a, b: a + b, parts).cast("decimal(18,6)"))
        args = []
        while not p.ate(")"):
            args.append(self._expr())
            p.ate(",")
        if name in AGGREGATES:
            c = args[0]
            if name == "count":
                return F.count_distinct(c) if distinct else F.count(c)
            if name == "collect":
                return F.array_sort(F.collect_set(c) if distinct else F.collect_list(c))
            return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](c)
        if name == "range":
            return F.sequence(*args)
        if name == "size":
            kind = self._base().select(args[0].alias("x")).schema["x"].dataType.typeName()
            return F.call_function("cardinality", args[0]) if kind in ("array", "map") else F.length(args[0])
        if name in FUNCTIONS:
            return FUNCTIONS[name](*args)
        raise CypherError(f"there is no function {name}")


def cypher(graph: PropertyGraph, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The rows of a read query."""
    return Query(graph, text, params).run()
