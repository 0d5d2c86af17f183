"""Quality classifier: document evidence shrunk towards its site by hierarchical empirical Bayes.

Two logistic models over words and style, fitted on a bounded sample of labelled documents, say how likely a
document is of good quality and how likely it is toxic; both together are its evidence. A word is a feature of
the one that it tells about with at least EVIDENCE standard deviations; how many there are follows from the sample.
Every document is scored once and its evidence written. Evidence is summed by
path within host and by host over all documents. Strengths of shrinkage come from the spread between hosts and
between the paths of a host (method of moments): a host's posterior leans on the global prior, a path's on its
host's, the more so the fewer documents there are. A document's log odds move by what its path's posterior has
over the global prior.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, bound_batches, over_batches, texts
from weftgraph.llm.decontaminate import WORDS

FIT_ROWS, EVIDENCE, LEAST_ROWS, MEMO = 20_000, 4.5, 5, 200_000
STEMS = (5, 6, 7, 8)  # bytes of the word beginnings that are features too, so that inflected words count together
_NOT_SYMBOL = bytes(c for c in range(256) if c not in b"#*$%&|<>@^~{}[]\\=")
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_LOWER = bytes(c for c in range(256) if not 97 <= c <= 122)
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_NOT_SHOUT = bytes(c for c in range(256) if c not in b"!?")
STYLE = 9


def style(text: bytes, words: list[bytes]) -> list[float]:
    """Shares of odd characters, repetition and length, each about 0 to 1."""
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words))
    upper, lower = len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _NOT_LOWER))
    return [
        min(1.0, 5 * len(text.translate(None, _NOT_SYMBOL)) / size),
        min(1.0, 2 * upper / max(1, upper + lower)),
        min(1.0, 5 * len(text.translate(None, _NOT_DIGIT)) / size),
        min(1.0, 10 * len(text.translate(None, _NOT_SHOUT)) / size),
        min(1.0, text.count(b"|") / max(1, n)),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - distinct / max(1, n),
        1.0 if n < 5 else 0.0,
        min(1.0, np.log1p(n) / 10),
    ]


def features_of(word: bytes) -> list[bytes]:
    return [word, *[b"^" + word[:n] for n in STEMS if len(word) > n]]


@dataclass
class Model:
    """weights are (2, words + STYLE + 1): of quality and of toxicity."""

    vocabulary: dict[bytes, int]
    weights: np.ndarray
    memo: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def seen(self, words: list[bytes]) -> list[int]:
        """The features of a document's words that the vocabulary has, each once."""
        memo, out = self.memo, set()
        if len(memo) > MEMO:
            memo.clear()
        for x in set(words):
            own = memo.get(x)
            if own is None:
                own = memo[x] = tuple(i for f in features_of(x) if (i := self.vocabulary.get(f)) is not None)
            out.update(own)
        return sorted(out)

    def odds(self, text: bytes) -> tuple[float, float]:
        words = text.translate(WORDS).split()
        w, seen, v = self.weights, self.seen(words), len(self.vocabulary)
        out = w[:, v : v + STYLE] @ np.array(style(text, words)) + w[:, -1]
        if seen:
            out = out + w[:, seen].sum(axis=1)
        return float(out[0]), float(out[1])


def _logistic(index: np.ndarray, row: np.ndarray, dense: np.ndarray, y: np.ndarray, own: np.ndarray, unseen: float, l2: float = 1e-4, turns: int = 300) -> np.ndarray:
    """Weights of words (those in own), style and the intercept, by Adam on all rows; only words are shrunk.

    Row ``row[k]`` has the word ``index[k]``; dense has a row's style and a one."""
    v = len(own)
    w = np.zeros(v + STYLE + 1)
    if not len(y) or y.min() == y.max():
        w[-1] = unseen if not len(y) else 6.0 if y[0] else -6.0
        return w
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, turns + 1):
        z = np.bincount(row, w[index], len(y)) + dense @ w[v:]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.concatenate([np.bincount(index, error[row], v), dense.T @ error])
        g[:v] = (g[:v] + l2 * w[:v]) * own
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, deviations: float = EVIDENCE) -> Model:
    """The model from at most ``fit_rows`` labelled documents, those with the least MD5 of their id.

    A document with several labels takes the lowest quality and the highest toxicity, labels with nulls are left out,
    and of rows that share an id the least text is taken. With labels of one class only the model says that class; without labels it keeps every document.
    """
    bound_batches(docs.sparkSession)
    whole = labels.where("doc_id is not null and quality is not null and toxic is not null")
    once = whole.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    sample = once.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fit_rows)
    scratch = Scratch(docs.sparkSession)
    held = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # the sample is bounded by fit_rows
    chosen = scratch.write(held.groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text")), "sample")

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [list({f for x in set(t.translate(WORDS).split()) for f in features_of(x)}) for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(got, pa.list_(pa.binary()))], names=["quality", "toxic", "words"])

    split = chosen.select("doc_id", "text", "quality", "toxic").mapInArrow(over_batches(words), "quality int, toxic int, words array<binary>")
    rows, bad, toxic = chosen.agg(F.count(F.lit(1)), F.sum(1 - F.col("quality")), F.sum("toxic")).first()
    of = split.select("quality", "toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("quality")).alias("bad"), F.sum("toxic").alias("toxic"))
    of = scratch.write(of.where(F.col("n") >= LEAST_ROWS), "words")
    vocab: dict[bytes, int] = {}
    heads: list[set[int]] = [set(), set()]
    for k, (name, total) in enumerate((("bad", bad), ("toxic", toxic))):
        if rows and total and total < rows:
            p = total / rows
            z = F.abs(F.col(name) - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
            for r in of.where(z >= deviations).select("word").orderBy("word").collect():  # features of at most fit_rows texts
                heads[k].add(vocab.setdefault(bytes(r["word"]), len(vocab)))
    lexicon = Model(vocab, np.zeros((2, 0)))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen, shape = [], []
        for t in texts(batch.column(1)):
            own = t.translate(WORDS).split()
            seen.append(lexicon.seen(own))
            shape.append(style(t, own))
        return pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(seen, pa.list_(pa.int32())), pa.array(shape, pa.list_(pa.float64()))], names=["quality", "toxic", "seen", "shape"])

    data = chosen.select("doc_id", "text", "quality", "toxic").mapInArrow(over_batches(features), "quality int, toxic int, seen array<int>, shape array<double>").toArrow().combine_chunks()  # at most fit_rows
    n, seen = data.num_rows, data["seen"].combine_chunks() if data.num_rows else pa.array([], pa.list_(pa.int32()))
    index, row = seen.flatten().to_numpy(), np.repeat(np.arange(n, dtype=np.int32), seen.value_lengths().to_numpy(zero_copy_only=False))
    shape = data["shape"].combine_chunks().flatten().to_numpy() if n else np.zeros(0)
    dense = np.hstack([shape.reshape(n, STYLE), np.ones((n, 1))])
    y = np.stack([data[c].to_numpy() for c in ("quality", "toxic")], axis=1).astype(float)
    own = np.array([[float(i in head) for i in range(len(vocab))] for head in heads]).reshape(2, -1)
    # a model needs the words that tell about it, and no others
    weights = []
    for k, unseen in enumerate((6.0, -6.0)):
        keep = own[k][index] > 0
        weights.append(_logistic(index[keep], row[keep], dense, y[:, k], own[k], unseen))
    return Model(vocab, np.stack(weights))


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs, with all its columns, plus __wg_q and __wg_t: log odds of good quality and of toxicity."""
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of at most fit_rows texts

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([shared.value.odds(t) for t in texts(batch.column(place))]).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(got[:, 0]), pa.array(got[:, 1])], names=[*batch.schema.names, "__wg_q", "__wg_t"])

    bound_batches(docs.sparkSession)
    schema = docs.select("*", F.lit(0.0).cast("double").alias("__wg_q"), F.lit(0.0).cast("double").alias("__wg_t")).schema
    return docs.mapInArrow(over_batches(work), schema)


def host_and_path(docs: DataFrame) -> tuple[Column, Column]:
    """Host: the source without scheme, up to its first slash. Path: the first segment after it, or the language."""
    source = F.regexp_replace(F.col("source").cast("string"), "^[a-z]+://", "") if "source" in docs.columns else F.lit(None).cast("string")
    segment = F.nullif(F.regexp_extract(source, "^[^/]*/([^/]*)", 1), F.lit(""))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return F.coalesce(F.substring_index(source, "/", 1), F.lit("")), F.coalesce(segment, lang, F.lit(""))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.ln(q / (1 - q))


def _p(q: str, t: str) -> Column:
    return 1 / (1 + F.exp(-F.col(q))) / (1 + F.exp(F.col(t)))


def sites(scored: DataFrame) -> DataFrame:
    """__wg_h, __wg_s, n, host_post, path_post and prior of each host and path of scored (__wg_h, __wg_s, p).

    The sums by path are written once, since the strengths need all of them before any posterior.
    """
    summed = scored.groupBy("__wg_h", "__wg_s").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = Scratch(scored.sparkSession).write(summed, "paths")
    hosts = paths.groupBy("__wg_h").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.count(F.lit(1)).alias("hp"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    sums = ["hn", "hs", "hq", "hp", "ss", "nn"]
    total = hosts.agg(*[F.sum(x).alias(x) for x in sums], F.count(F.lit(1)).alias("h"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("hss"), F.sum(F.col("hn") * F.col("hn")).alias("hnn"), F.sum(F.col("nn") / F.col("hn")).alias("own")).first()

    def strength(mean: float, within: float, between: float, spread: float) -> float:
        """Documents that the upper level is worth: within-variance over between-variance."""
        return float(np.clip(within / max(between / max(spread, 1e-9), 1e-9), 1.0, 1e6))

    n = float(total["hn"] or 0)
    if not n:
        return paths.select("__wg_h", "__wg_s", "n", *[F.lit(0.5).alias(x) for x in ("host_post", "path_post", "prior")])
    mean = total["hs"] / n
    h, k = float(total["h"]), float(total["hp"])
    within = max(1e-6, (total["hq"] - total["ss"]) / max(1.0, n - k))
    between_hosts = max(0.0, total["hss"] - n * mean * mean - (h - 1) * within)
    between_paths = max(0.0, total["ss"] - total["hss"] - (k - h) * within)
    host_k = strength(mean, within, between_hosts, n - total["hnn"] / n)
    path_k = strength(mean, within, between_paths, n - total["own"])
    post = (host_k * mean + F.col("hs")) / (host_k + F.col("hn"))
    posts = hosts.select("__wg_h", F.when(F.col("__wg_h") == "", F.lit(mean)).otherwise(post).alias("host_post"))
    out = paths.join(posts, "__wg_h")
    path = (path_k * F.col("host_post") + F.col("s")) / (path_k + F.col("n"))
    return out.select("__wg_h", "__wg_s", "n", "host_post", F.when(F.col("__wg_h") == "", F.lit(mean)).otherwise(path).alias("path_post"), F.lit(mean).alias("prior"))


def _placed(docs: DataFrame, model: Model) -> DataFrame:
    host, path = host_and_path(docs)
    return evidence(docs, model).withColumns({"__wg_h": host, "__wg_s": path})


def posteriors(scored: DataFrame) -> DataFrame:
    """scored (written: __wg_q, __wg_t, __wg_h, __wg_s and more) with __wg_pq, __wg_pt, __wg_site and __wg_p."""
    scratch = Scratch(scored.sparkSession)
    table = scratch.write(sites(scored.select("__wg_h", "__wg_s", _p("__wg_q", "__wg_t").alias("p"))), "sites")
    few = table.select("__wg_h", "__wg_s", F.col("path_post").alias("__wg_site"), F.col("prior").alias("__wg_prior"))
    odds = _logit(_p("__wg_q", "__wg_t")) + _logit(F.col("__wg_site")) - _logit(F.col("__wg_prior"))
    rows = scored.join(few, ["__wg_h", "__wg_s"])
    return rows.withColumns({"__wg_pq": 1 / (1 + F.exp(-F.col("__wg_q"))), "__wg_pt": 1 / (1 + F.exp(-F.col("__wg_t"))), "__wg_p": 1 / (1 + F.exp(-odds))})


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, p_quality, p_toxic, p_site (the path's posterior), p_keep and kept of each row of docs.

    Null and empty texts have no words and go by style and site. Rows without a source keep the global prior.
    Each row is judged alone; equal rows get equal results, rows that share an id one result each. An empty table
    gives an empty table; columns other than doc_id, text, lang and source are ignored.
    """
    rows = docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns])
    scored = _placed(rows, fit(docs, labels, fit_rows)).select("doc_id", "__wg_q", "__wg_t", "__wg_h", "__wg_s")
    rows = posteriors(Scratch(docs.sparkSession).write(scored, "scored"))
    return rows.select("doc_id", F.col("__wg_pq").alias("p_quality"), F.col("__wg_pt").alias("p_toxic"), F.col("__wg_site").alias("p_site"), F.col("__wg_p").alias("p_keep"), (F.col("__wg_p") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that the classifier rejects; all columns stay. Cases are as in ``report``."""
    scored = Scratch(docs.sparkSession).write(_placed(docs, fit(docs, labels, fit_rows)), "scored")
    return posteriors(scored).where(F.col("__wg_p") >= threshold).select(*docs.columns)
