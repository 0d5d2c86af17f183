"""The classifier against a plain version: odds word by word, posteriors site by site, weights by their gradient."""

import math
import random

import numpy as np
import pytest

from weftgraph.llm import classifier

WORDS = ["good", "fine", "calm", "awful", "nasty", "stone", "river", "the", "of"]


def made(seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        bad, toxic = r.random() < 0.3, r.random() < 0.2
        words = [r.choice(WORDS[5:]) for _ in range(20)] + [r.choice(["awful"] if bad else ["good", "fine"]) for _ in range(3)] + (["nasty"] if toxic else ["calm"])
        rows.append((i, " ".join(words), "en", f"http://{r.choice('abc')}.org/{r.choice('xy')}/p", int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = made(1, 400) + [(1000, None, None, None, 1, 0), (1001, "", "en", "", 1, 0), (3, "awful " * 30, "de", "http://a.org/x/p", 1, 1)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows[:300]], "doc_id long, quality int, toxic int")
    return docs, labels


def plain_odds(model, text):
    """Straight from the features' definition."""
    words = (text or "").encode().translate(classifier.WORDS).split()
    seen = {f for w in words for f in classifier.features_of(w)}
    v = len(model.vocabulary)
    out = []
    for w in model.weights:
        z = w[-1] + sum(w[i] for f, i in model.vocabulary.items() if f in seen)
        out.append(z + sum(a * b for a, b in zip(w[v : v + classifier.STYLE], classifier.style((text or "").encode(), words), strict=True)))
    return out


def plain_posteriors(rows):
    """rows: (host, path, p). Posteriors by their formulas, one site after the other."""
    hosts, paths = {}, {}
    for h, s, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, s), []).append(p)
    every = [p for *_, p in rows]
    n, mean, h, k = len(every), sum(every) / len(every), len(hosts), len(paths)
    square = lambda groups: sum(sum(g) ** 2 / len(g) for g in groups)
    within = max(1e-6, (sum(p * p for p in every) - square(paths.values())) / max(1.0, n - k))
    between_hosts = max(0.0, square(hosts.values()) - n * mean * mean - (h - 1) * within)
    between_paths = max(0.0, square(paths.values()) - square(hosts.values()) - (k - h) * within)
    clip = lambda x: min(max(x, 1.0), 1e6)
    host_k = clip(within / max(between_hosts / max(n - sum(len(g) ** 2 for g in hosts.values()) / n, 1e-9), 1e-9))
    path_k = clip(within / max(between_paths / max(n - sum(sum(len(g) ** 2 for (a, _), g in paths.items() if a == x) / len(own) for x, own in hosts.items()), 1e-9), 1e-9))
    post = {x: (host_k * mean + sum(g)) / (host_k + len(g)) for x, g in hosts.items()}
    return mean, {(x, s): mean if x == "" else (path_k * post[x] + sum(g)) / (path_k + len(g)) for (x, s), g in paths.items()}


def site_of(source, lang):
    bare = (source or "").removeprefix("http://")
    host, _, rest = bare.partition("/")
    return host, rest.split("/")[0] or lang or ""


def test_report_is_the_plain_version(spark, tables):
    docs, labels = tables
    model = classifier.fit(docs, labels)
    assert {b"awful", b"nasty"} <= set(model.vocabulary)
    rows = [tuple(r) for r in docs.collect()]
    odds = [plain_odds(model, text) for _, text, *_ in rows]
    sig = lambda z: 1 / (1 + math.exp(-z))
    p = [sig(q) * sig(-t) for q, t in odds]
    sites = [site_of(source, lang) for *_, lang, source in rows]
    prior, post = plain_posteriors([(*s, x) for s, x in zip(sites, p, strict=True)])
    logit = lambda x: math.log(min(max(x, 1e-9), 1 - 1e-9) / (1 - min(max(x, 1e-9), 1 - 1e-9)))
    want = sorted((i, sig(q), sig(t), post[s], sig(logit(x) + logit(post[s]) - logit(prior))) for (i, *_), (q, t), s, x in zip(rows, odds, sites, p, strict=True))
    got = sorted(tuple(r)[:5] for r in classifier.report(docs, labels).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-6, abs=1e-9)


def test_kept_documents_are_the_report_s(tables):
    docs, labels = tables
    kept = sorted(r["doc_id"] for r in classifier.report(docs, labels).where("kept").collect())
    assert sorted(r["doc_id"] for r in classifier.keep_good(docs, labels).collect()) == kept and 0 < len(kept) < docs.count()


def test_sample_is_bounded(spark, tables):
    """Rows that share the sampled ids don't widen the sample."""
    docs = spark.createDataFrame([(i % 3, f"text {i} awful", "en", "s") for i in range(900)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    model = classifier.fit(docs, labels, fit_rows=3)
    alone = classifier.fit(spark.createDataFrame([(i, min(f"text {k} awful" for k in range(i, 900, 3)), "en", "s") for i in range(3)], docs.schema), labels, fit_rows=3)
    assert model.vocabulary == alone.vocabulary and np.allclose(model.weights, alone.weights)


def test_features_follow_evidence(spark):
    """Every word that tells enough is a feature, however many there are and however long."""
    r = random.Random(2)
    tells = [f"tell{k:03d}" for k in range(300)] + ["x" * 200]
    rows = [(i, " ".join([*(tells if i % 2 else []), *[f"w{r.randrange(400)}" for _ in range(10)]])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = classifier.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int"))
    assert {t.encode() for t in tells} <= set(model.vocabulary)


def test_weights_are_near_their_optimum():
    """The gradient of the stated loss is small where the fit ends, but for what Adam's last steps leave."""
    r = np.random.default_rng(3)
    n, v = 500, 6
    has = r.random((n, v)) < 0.4
    dense = np.hstack([r.random((n, classifier.STYLE)), np.ones((n, 1))])
    y = (r.random(n) < 1 / (1 + np.exp(-(has @ np.array([2.0, -2.0, 1.0, 0, 0, 0]) - 0.5)))).astype(float)
    row, index = np.nonzero(has)
    own = np.array([1.0, 1, 1, 1, 1, 0])
    keep = own[index] > 0
    w = classifier._logistic(index[keep], row[keep], dense, y, own, 0.0, turns=3000)
    error = 1 / (1 + np.exp(-(has @ w[:v] + dense @ w[v:]))) - y
    gradient = np.concatenate([(has.T @ error / n + 1e-4 * w[:v]) * own, dense.T @ error / n])
    assert np.abs(gradient).max() < 2e-3 and w[5] == 0
