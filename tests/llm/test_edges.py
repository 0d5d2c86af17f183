"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; limits set low to reach every way."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm import brute
from weftgraph.llm import binary_output, chat_snapshots, classifier, decontaminate, encoders, packing, pii, quality_rules, sharding, simhash, suffix_dedup
from weftgraph.llm.common import RID, keyed
from weftgraph.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, kept string, spans string, h long, n long, component long, term string, p double, length int, part int"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "ti", "re", "lo", "mü", "sé", "ka"]) for _ in range(r.randint(1, 4))) for _ in range(n))


BASE = words(1, 120)
TEXTS = [
    None, "", " \t\n", "x", BASE, BASE, BASE[:300] + " changed here " + BASE[330:], BASE + ".", "a" * 20_000, words(2, 6000), "12 " * 400, words(3, 50) + BASE[100:500] + words(4, 50),
    "mail bob@x.org, bob@x.org from 10.0.0.1 or 300.1.1.1; card 4111 1111 1111 1111, call +1 (555) 123-4567", "a.b_c@d.e.f_g@h.i", "line one\nline one\n\nClick here\na | b | c | d", " one two   three", "<|endoftext|> x <|startoftext|>y", "ÀB ÇD " * 30,
]


@pytest.fixture(scope="module")
def docs(spark):
    ids = [None, 0, 1, 2, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23]
    rows = [(i, t, None, None if k % 3 else "s/p", k, "f", "k", "s", k, k, k, "t", 0.5, k, k) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))]
    rows += [rows[4], rows[4], rows[1]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ordered(docs):
    """(key, doc_id, text) as the operators order rows."""
    return [tuple(r) for r in keyed(docs.select("doc_id", "text")).select(RID, "doc_id", "text").orderBy(RID).collect()]


def test_keys(ordered):
    assert len({k for k, _, _ in ordered}) == len(ordered)
    assert [i for _, i, _ in ordered] == sorted([i for _, i, _ in ordered], key=lambda i: (i is not None, i or 0))


def test_keys_of_far_ids(spark):
    rows = [(-(2**63), "a"), (2**63 - 1, "b"), (2**63 - 1, "c"), (None, "d")]
    got = keyed(spark.createDataFrame(rows, "doc_id long, text string")).orderBy(RID).collect()
    assert [r["text"] for r in got] == ["d", "a", "b", "c"] and len({r[RID] for r in got}) == 4


def test_keys_of_many_null_ids(spark):
    """A third of the rows without an id, in order of their texts, and no row lost or met in one task alone."""
    r = random.Random(5)
    rows = [(None if i % 3 == 0 else i // 4, r.choice(["", None, words(i, 3), "Ünder", "same"])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = keyed(frame).orderBy(RID).collect()
    assert len({x[RID] for x in got}) == len(rows) and Counter((x["doc_id"], x["text"]) for x in got) == Counter(rows)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())
    assert [(x["doc_id"], x["text"]) for x in got] == sorted(rows, key=key)
    plan = keyed(frame)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_quality(docs, empty):
    got = Counter(tuple(r)[:7] for r in quality_rules.report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter((r["doc_id"], *brute.quality(r["text"]).values()) for r in docs.select("doc_id", "text").collect())
    assert got == want
    assert quality_rules.report(empty).count() == 0


def test_line_rules():
    keep = "A plain line of words that ends as it should.\n" + words(9, 40) + "."
    n, *_, kept, lost, boiler, nav, punct, left = quality_rules.judge((keep + "\nHome | About | Contact | Help\nread on about this and that").encode())
    assert kept and left.decode() == keep and (lost, boiler, nav, punct) == (13, 0, 1, 1)
    for bad in ("BUY NOW THIS IS LOUD TEXT.", "a!! b!! c!! d!! e!!", "## $$ %% && **.", "home | news | sport", "no end of a line here"):
        assert quality_rules.line_fault(bad.encode(), bad.encode().split())
    for good in ("Short heading", "This is one plain sentence, said once.", "« Une phrase entière, avec sa fin. »", "He said that it was “so.”"):
        assert not quality_rules.line_fault(good.encode(), good.encode().split())


def test_learnt_boilerplate(spark):
    """A line in ten texts among ever other lines is boilerplate; copies' and near copies' lines aren't."""
    line = "Share this page 12 with your friends."
    spread = [f"{words(800 + i, 14)}.\n{line.replace('12', str(i))}\n{words(900 + i, 14)}." for i in range(10)]
    body = [f"{words(700 + k, 12)}." for k in range(12)]
    copies = ["\n".join(body)] * 15
    near = ["\n".join([*body[:k], f"{words(600 + k, 12)}.", *body[k + 1 :]]) for k in range(12)]
    nine = [f"{words(200 + i, 14)}.\nOnly nine texts have this line.\n{words(300 + i, 14)}." for i in range(9)]
    rows = list(enumerate([*spread, *copies, *near, *nine, None, ""]))
    got = {r["doc_id"]: r for r in quality_rules.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i]["n_boilerplate"] == (i < 10), text
        assert got[i]["clean_text"] == "\n".join(x for x in (text or "").split("\n") if not (i < 10 and x.startswith("Share")))
        assert got[i]["kept"] == bool(text)


@pytest.mark.parametrize("cap", [1, 3, 32_768])
def test_suffix_dedup(docs, ordered, cap):
    got = sorted((tuple(r) for r in suffix_dedup.deduplicated(docs, bucket_cap=cap).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == sorted(brute.suffix_dedup([(i, t) for _, i, t in ordered]), key=str)


def test_suffix_dedup_random(spark):
    r = random.Random(5)
    parts = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(20, 260))).decode() for _ in range(12)]
    rows = [(i, "".join(r.choice(parts)[r.randint(0, 9) :] for _ in range(r.randint(0, 12)))) for i in range(60)]
    got = sorted(tuple(x) for x in suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), bucket_cap=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute.suffix_dedup(rows)


def test_maximal_groups(spark):
    a, b, c = words(11, 40)[:180], words(12, 40)[:150], words(13, 60)[:260]
    rows = [(0, "x" + a + "y" + b), (1, "p" + a + "q"), (2, "r" + b + "s" + a), (3, c), (4, c), (5, "1" + c[20:150] + "2")]
    job = suffix_dedup.Dedup(keyed(spark.createDataFrame(rows, "doc_id long, text string")))
    found = defaultdict(set)
    for r in job.groups().collect():
        found[r["h"], r["repeat"], r["c"], r["length"]].add((r[RID], r["start"]))
    texts = [t.encode() for _, t in rows]
    assert any({i for i, _ in places} == {3, 4, 5} for places in found.values()) and any({i for i, _ in places} == {0, 1, 2} for places in found.values())
    for (_, repeat, _, length), places in found.items():
        assert len({texts[i][s : s + length] for i, s in places}) == 1 and len(places) > 1 and length >= 100
        w = texts[next(iter(places))[0]][next(iter(places))[1] :][:length]
        every = {(i, m.start()) for i, t in enumerate(texts) for m in re.finditer(b"(?=" + re.escape(w) + b")", t)}
        assert places == every if repeat >= 0 else places <= every


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.deduplicated(empty).count() == 0


@pytest.mark.parametrize("cap", [1, 24])
def test_simhash(docs, ordered, cap):
    prints = {k: brute.fingerprint(t) for k, _, t in ordered}
    roots = brute.components(prints)
    got = simhash.near_duplicates(docs, bucket_cap=cap).collect()
    assert {r[RID]: (r["fp"] % (1 << 64), r["component"]) for r in got} == {k: (prints[k], roots[k]) for k in prints}
    assert simhash.keep_first(docs).columns == docs.columns
    assert simhash.keep_first(docs).count() == len(set(roots.values()))


def test_simhash_links_of_hot_blocks(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = {i: base[i % 4] ^ sum(1 << r.randrange(20) for _ in range(r.randint(0, 4))) for i in range(150)}
    prints |= {200 + i: r.getrandbits(64) for i in range(50)}
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in prints.values()})
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute.components(dict(zip(signed, [x % (1 << 64) for x in signed], strict=True)))
    for cap in (1, 5, 1000):
        from weftgraph.llm.common import Scratch

        scratch = Scratch(spark)
        got = {a: b for a, b in (tuple(x) for x in simhash.star_components(simhash.links(frame, scratch, cap), scratch).collect())}
        assert {x: got.get(x, x) for x in signed} == want


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


ITEMS = [(1, BASE), (2, "one two"), (3, None), (4, ""), (5, "b.c"), (None, "x"), (1, BASE), (6, words(2, 30)), (7, "three")]


@pytest.mark.parametrize("block", [7, 50_000])
def test_contamination(spark, docs, block):
    bench = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, block string")
    items = [(i, t) for i, t in ITEMS if i is not None]
    got = Counter(tuple(r) for r in decontaminate.report(docs, bench, block).drop("hit_runs").collect())
    texts = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *brute.contamination(r["text"], items).values()) for r in texts)
    assert got == want
    left = decontaminate.clean(docs, bench, block)
    assert left.columns == docs.columns
    assert left.count() == sum(not brute.contamination(r["text"], items)["contaminated"] for r in texts)


def test_contamination_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.report(empty, none).count() == 0


def test_wu_manber():
    r = random.Random(7)
    text = [r.choice([b"a", b"b", b"c"]) for _ in range(400)]
    pats = list({tuple(r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 6))) for _ in range(60)})
    want = {(k, i) for k, p in enumerate(pats) for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p}
    assert {(k, i) for k, i, _ in decontaminate.WuManber(pats).search(text)} == want


def test_sharding(docs, empty):
    got = sharding.assign(docs, [1.0] * 16, [1.0] * 17, buckets=4).collect()
    assert len(got) == docs.count()
    for s, n in Counter(r["shard"] for r in got).items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in got} == {(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in docs.collect()}
    assert sharding.assign(empty, [1.0], [1.0, 1.0]).count() == 0


def test_weighted_shards(spark):
    ids = spark.range(20_000).selectExpr("id as doc_id", "'t' as text")
    n = Counter(r["shard"] for r in sharding.assign(ids, [1.0, 3.0, 0.0]).collect())
    assert n[2] == 0 and 2.8 < n[1] / n[0] < 3.2


def test_packing(docs, ordered, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = packing.pack(docs, tokenizer("word_bpe_49k.json"), capacity=64).collect()
    want = Counter()
    for _, i, t in ordered:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 64)):
            want[i, k, a, len(ids[a : a + 64]), brute.crc_of(ids[a : a + 64])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty, tokenizer("word_bpe_49k.json")).count() == 0


def least_bins(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= items[i] and bins[k] not in bins[:k]:
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    r = random.Random(8)
    for _ in range(150):
        items = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        fixed, rest = packing.reduce_instance(Counter(items), 20)
        left = sorted((n for n, c in rest.items() for _ in range(c)), reverse=True)
        assert sum(s for s, _ in fixed) + least_bins(left, 20) == least_bins(items, 20)
        assert Counter(left) + Counter(n for s, own in fixed for n in own for _ in range(s)) == Counter(items)
        runs = packing.plan(Counter(items), 20)
        assert sum(len(x[0]) for x in runs.values()) >= 1


def test_best_fit_is_one_by_one_best_fit():
    r = random.Random(9)
    for _ in range(60):
        count = Counter(r.randint(1, 60) for _ in range(r.randint(1, 80)))
        rooms = []
        for n in sorted(count.elements(), reverse=True):
            fits = [x for x in rooms if x >= n]
            room = min(fits) if fits else 100
            if fits:
                rooms.remove(room)
            rooms.append(room - n)
        got = packing.best_fit(count, 100)
        assert sum(s for s, _ in got) == len(rooms)
        assert Counter(n for s, own in got for n in own for _ in range(s)) == count


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_is_the_library(name, spaced):
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer(name)), encoders.Encoder(tokenizer(name), spaced, room=50)
    r = random.Random(4)
    bits = ["a", "B", "é", "ß", "ñ", "don't", "I'LL", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", " ", " ", "　", "1", "²", "½", ".", "!!", "'s", "_", "<|endoftext|>", "<|", "日本", "é", "́", "😀", "İ", "ſ", "​", "Σ", "ς", "ª", "﻿"]
    for t in [*[t or "" for t in TEXTS], *("".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(3000))]:
        assert enc.ids(t.encode()) == enc.whole(t), t
        assert len(enc.whole(t)) == 4 * len(tok.encode(t, add_special_tokens=False).ids)


def test_binary_output(docs, ordered, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want, start = Counter(), 0
    for _, i, t in ordered:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, start, len(ids), brute.crc_of(ids)] += 1
        start += len(ids)
    assert Counter(tuple(r) for r in binary_output.round_trip(docs, tokenizer("byte_bpe_50k.json"), 3).collect()) == want
    assert binary_output.round_trip(empty, tokenizer("byte_bpe_50k.json"), 2).count() == 0


def test_planes():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        for most in (1, 2, 255, 256, 65_536, 1 << 20, 1 << 32):
            ids = r.integers(0, most, n, dtype=np.uint64).astype(np.uint32)
            planes = binary_output.planes_of(ids)
            assert (binary_output.ids_from(planes, n) == ids).all()
            for k, p in enumerate(planes):
                assert p == np.packbits((ids >> np.uint32(k)) & np.uint32(1), bitorder="little").tobytes()
            payload, index = binary_output.encode_segment(ids, block=64)
            assert (binary_output.decode_segment(payload, index) == ids).all()


def test_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([(10, 1, 0, 1), (None, 1, 0, 2), (12, None, 1, 3), (13, 0, None, 4), (10, 0, 0, 5)], "doc_id long, quality int, toxic int, n int")
    assert classifier.report(docs, labels).count() == docs.count()
    none = labels.limit(0)
    kept = classifier.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert classifier.report(empty, labels).count() == 0


def test_classifier_on_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = classifier.report(docs, seen).join(unseen, "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in got)
    assert right >= 0.95 * len(got)


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("big", "b", 0.85)] * 300 + [("bad", "a", 0.1)] * 300 + [("one", "a", 0.0)]
    got = {(r["__wg_h"], r["__wg_s"]): r for r in classifier.sites(spark.createDataFrame(rows, "__wg_h string, __wg_s string, p double")).collect()}
    prior = got["one", "a"]["prior"]
    assert abs(got["bad", "a"]["path_post"] - 0.1) < 0.05 < abs(got["one", "a"]["path_post"])
    assert got["bad", "a"]["path_post"] < prior < got["big", "a"]["path_post"]


def brute_terms(rows, share, gain):
    import math

    rows = list(dict.fromkeys(t or "" for t in rows))
    terms = [set(re.findall(r"[^\x00-\x60\x7B-\x7F]{4,}", brute.lower(t))) for t in rows]
    entities = [{f"{k}:{brute.lower(t[a:z])}" for a, k, z in brute.base_spans(t)} for t in rows]
    ne, nt = Counter(e for own in entities for e in own), Counter(w for own in terms for w in own)
    both = Counter((e, w) for es, ws in zip(entities, terms, strict=True) for e in es for w in ws)

    def bound(k, n, z=1.645):
        p = k / n
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    return {w for (e, w), n in both.items() if bound(n, nt[w]) >= share and math.log2(n / nt[w] * len(rows) / ne[e]) >= gain}


def test_pii(spark, docs, empty):
    r = random.Random(6)
    lines = [f"{words(100 + i, 12)} meridian Quartzite {'ann@corp.example' if i % 5 else ''} {words(300 + i, 5)} ok" for i in range(12)]
    few = [f"{words(700 + i, 9)} obsidian Feldspar 10.1.2.3" if i < 3 else f"{words(700 + i, 9)} feldspar" for i in range(5)]
    copies = ["one travertine text of bob@corp.example"] * 40
    texts = [t for t in TEXTS] + lines + few + copies + [words(500 + i, 30) for i in range(120)]
    r.shuffle(texts)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for share in (0.4, 0.5, 0.8):
        want = brute_terms(texts, share, 2.0)
        assert ("quartzite" in want) == (share <= 0.5)  # beside the address in 9 of its 12 documents: more often right than wrong
        assert ("obsidian" in want) == (share <= 0.5)  # 3 of 3
        assert "feldspar" not in want and "travertine" not in want  # 3 of 5; one text, however often it is copied
        got = {x["doc_id"]: x for x in pii.report(frame, share=share, gain_bits=2.0).collect()}
        for i, t in enumerate(texts):
            base = brute.base_spans(t)
            more = [(m.start(), 4, m.end()) for m in re.finditer(r"[^\x00-\x60\x7B-\x7F]{4,}", brute.lower(t or "")) if m[0] in want]
            more = [m for m in more if not any(a < m[2] and m[0] < z for a, _, z in base)]
            assert got[i]["spans"] == brute.span_names(sorted(base + more))
            assert got[i]["base_sha256"] == hashlib.sha256(brute.span_names(base).encode()).hexdigest()
    tables = pii.report(frame, share=0.8, gain_bits=2.0, broadcast_bytes=0).collect()
    assert {x["doc_id"]: x["spans"] for x in tables} == {i: x["spans"] for i, x in got.items()}
    assert Counter(x["base_sha256"] for x in pii.report(docs).collect()) == Counter(hashlib.sha256(brute.span_names(brute.base_spans(x["text"])).encode()).hexdigest() for x in docs.collect())
    assert pii.report(empty).count() == 0


def test_pii_of_many_entities_in_one_text(spark):
    many = " ".join(f"user{i}@corp.example {words(2000 + i, 3)}" for i in range(400))
    texts = [many, *[f"pangolin {i} user7@corp.example {words(4000 + i, 4)}" for i in range(4)], *[words(6000 + i, 20) for i in range(60)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_terms(texts, 0.5, 2.0)
    assert "pangolin" in want
    for r in pii.report(frame, gain_bits=2.0).collect():
        base = brute.base_spans(texts[r["doc_id"]])
        places = [m.span() for m in re.finditer(r"[^\x00-\x60\x7B-\x7F]{4,}", texts[r["doc_id"]]) if m[0] in want]
        assert r["n_term"] == sum(not any(a < z2 and a2 < z for a, _, z in base) for a2, z2 in places)


def test_pii_patterns_like_the_plain_ones(spark):
    r = random.Random(2)
    bits = ["a", "Z", "9", "1", "23", "255", "256", "4111111111111111", "+", "@", ".", "-", " ", "(", ")", "_", "%", "x@y.z", "é", "\U0001f600", "+1 ", "10.0.0.1", "0010", "\n"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 30)))) for i in range(1500)]
    rows.append((1500, "1 " * 5000 + "." * 3000 + "a@" * 3000 + "9" * 5000 + "a" * 50_000 + "@b.c"))
    got = {x["doc_id"]: x for x in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), share=1.0).collect()}
    for i, t in rows:
        assert got[i]["spans"] == brute.span_names(brute.base_spans(t)), t[:200]


def test_sanitise(docs):
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert out[18] == "mail <EMAIL>, <EMAIL> from <IP> or 300.1.1.1; card <CARD>, call <PHONE>"
    assert out[None] is None and out[0] == "" and pii.sanitise(docs).columns == docs.columns


def test_chat(spark):
    turns = [(1, 0, "u", "hi"), (2, 0, "u", "hi"), (2, 1, "a", "yo"), (3, 0, "u", "hi"), (3, 1, "a", "yo"), (4, 0, "u", None), (5, 0, "u", ""), (6, None, None, None), (None, 0, "u", "lost"), (7, 0, "u", "hi"), (7, 1, "a", "y"), (8, 0, "u", "hi")]
    frame = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, n_turns long")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in chat_snapshots.maximal(frame).collect()}
    assert got == {2: (2, 2), 4: (1, 1), 5: (1, 1), 6: (1, 1), 7: (2, 1)}
    assert chat_snapshots.maximal(frame.limit(0)).count() == 0


def test_chat_long(spark):
    """A conversation of many and long turns, logged after some of them."""
    every = [(k, "user" if k % 2 == 0 else "assistant", f"{k} " + "x" * (200_000 if k == 7 else 20)) for k in range(5000)]
    logs = [(c, *t) for c, n in enumerate((1, 8, 2500, 5000, 4999)) for t in every[:n]]
    frame = spark.createDataFrame(logs, "conv_id long, turn long, role string, text string").repartition(4)
    (row,) = chat_snapshots.maximal(frame).collect()
    assert (row["conv_id"], row["n_turns"], row["n_copies"]) == (3, 5000, 1)
    assert row["rendered"] == "".join(f"<|{r}|>\n{t}<|end|>\n" for _, r, t in every)
