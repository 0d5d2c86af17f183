"""Text search: an inverted index with BM25, weighted keywords, suggestions and a substring fallback."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scalar import contains_ci
from weftgraph.operators.paths import cut

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


@dataclass
class Index:
    postings: DataFrame  # term, id, tf, len
    terms: DataFrame  # term, df
    n: int
    average: float


def build(docs: DataFrame, id_col: str, *columns: str) -> Index:
    text = F.concat_ws(" ", *columns)
    words = docs.select(F.col(id_col).alias("id"), tokens(text).alias("w")).withColumn("len", F.size("w"))
    n, average = words.agg(F.count(F.lit(1)), F.avg("len")).first()
    postings = words.select("id", "len", F.explode("w").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    return Index(postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n, float(average or 0))


def bm25(docs: DataFrame, id_col: str, columns: Sequence[str], query: str, limit: int = 10, every: bool = False) -> DataFrame:
    """(id, score): the best documents for a query's words; ``every`` asks for all of them. Ties by id.

    Words in quotes have to stand side by side, a word that ends in ``*`` is a prefix. Documents are split once: a row of
    each has its length and how often it holds each asked word, and that small table gives statistics and scores alike.
    """
    asked = wanted(query)
    words = docs.select(F.col(id_col).alias("id"), tokens(F.concat_ws(" ", *columns)).alias("w"))
    per = cut(words.select("id", F.size("w").alias("len"), *[_times(F.col("w"), a).alias(f"t{i}") for i, a in enumerate(asked)]), "terms")
    stats = per.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(asked))])
    hit = reduce(lambda a, b: (a & b) if every else (a | b), [F.col(f"t{i}") > 0 for i in range(len(asked))], F.lit(every))
    joined = per.where(hit).crossJoin(F.broadcast(stats))  # one row of statistics

    def part(i: int) -> Column:
        idf = F.ln(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        return idf * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg")))

    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(asked))], F.lit(0.0))
    return joined.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def wanted(query: str) -> list[tuple[str, ...]]:
    """The words, ``prefix*`` words and quoted phrases of a query, each once."""
    found = [tuple(re.findall(r"[a-z0-9]+\*?", (quoted or word).lower())) for quoted, word in re.findall(r'"([^"]*)"|(\S+)', query)]
    return sorted({f for f in found if f})


def _times(words: Column, asked: tuple[str, ...]) -> Column:
    """How often the asked words stand side by side."""
    is_ = lambda x, a: x.startswith(a[:-1]) if a.endswith("*") else x == a
    if len(asked) == 1:
        return F.size(F.filter(words, lambda x: is_(x, asked[0])))
    here = lambda x, i: reduce(lambda a, b: a & b, [is_(F.get(words, i + k), a) for k, a in enumerate(asked)])
    return F.size(F.filter(F.transform(words, lambda x, i: F.coalesce(here(x, i), F.lit(False))), lambda ok: ok))


def keywords(rows: DataFrame, weights: dict[str, int], query: str, order: Sequence[str], limit: int = 40) -> DataFrame:
    """rows with ``score``: for every word the weights of the columns that hold it; all words must be somewhere."""
    words = query.lower().split()
    hit = lambda w, c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(w)
    per = [reduce(lambda a, b: a + b, [F.when(hit(w, c), v).otherwise(0) for c, v in weights.items()]) for w in words]
    kept = reduce(lambda a, b: a & b, [p > 0 for p in per])
    return rows.where(kept).withColumn("score", reduce(lambda a, b: a + b, per)).orderBy(F.desc("score"), *order).limit(limit)


def fallback(rows: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    return rows.where(contains_ci(query, *[F.col(c) for c in columns]))


def suggest(paths: DataFrame, path_col: str, wrong: str, limit: int = 5) -> DataFrame:
    """Paths that hold one of the wrong path's three longest telling segments; shortest first."""
    parts = sorted({p for p in wrong.lower().split("/") if len(p) >= 3 and not p.startswith("{")}, key=lambda p: (-len(p), p))[:3]
    if not parts:
        return paths.select(path_col).limit(0)
    hit = reduce(lambda a, b: a | b, [F.lower(path_col).contains(p) for p in parts])
    return paths.where(hit).select(path_col).distinct().orderBy(F.length(path_col), path_col).limit(limit)
