"""The registered queries over a whole driver table against brute force."""

import duckdb
import pytest

from tests.llm import brute
from weftgraph.llm.queries import ORACLE, QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
BY = {q.split("_")[0]: q for q in QUERIES}


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()


def rows(spark, op):
    return {r["doc_id"]: r for r in QUERIES[BY[op]](spark, SF).collect()}


def test_quality_rules(spark, docs):
    got = rows(spark, "op1")
    for i, text in docs:
        want = brute.quality(text)
        assert {k: got[i][k] for k in want} == want
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert sum(r["kept"] for r in got.values()) > len(docs) / 2


def test_suffix_dedup(spark, docs):
    got = sorted(tuple(r) for r in QUERIES[BY["op2"]](spark, SF).collect())
    assert got == brute.suffix_dedup(docs)


def test_simhash(spark, docs):
    got = rows(spark, "op4")
    prints = {i: brute.fingerprint(t) for i, t in docs}
    roots = brute.components(prints)
    for i, _ in docs:
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
        assert got[i]["component_id"] == roots[i]


def test_contamination(spark, docs):
    got = rows(spark, "op5")
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    for i, text in docs:
        want = brute.contamination(text, items)
        assert {k: got[i][k] for k in want} == want


def test_sharding(spark, docs):
    got = rows(spark, "op6")
    assert len(got) == len(docs)
    for s in range(16):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))
    for i, text in docs:
        assert got[i]["size"] == len(text.encode()) + 1
        assert got[i]["text_crc32"] == __import__("zlib").crc32(text.encode())
        assert got[i]["grown_shard"] in (got[i]["shard"], 16)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = QUERIES[BY["op7"]](spark, SF).collect()
    by = {(r["doc_id"], r["piece"]): r for r in got}
    n = 0
    for i, text in docs:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part, r = ids[a : a + 4096], by[i, k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, len(part), brute.crc_of(part))
            n += 1
    assert n == len(got)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_classifier(spark, docs):
    got = rows(spark, "op8")
    labels = duckdb.sql(f"select doc_id, min(quality) q, max(toxic) t from '{SF}/labels.parquet' group by 1").fetchall()
    right = sum(got[i]["kept"] == (q == 1 and t == 0) for i, q, t in labels)
    assert len(got) == len(docs) and right >= 0.9 * len(labels)


def test_pii(spark, docs):
    got = rows(spark, "op9")
    for i, text in docs:
        base = brute.base_spans(text)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[1] == k for s in base) for k in range(4)]
        assert got[i]["base_sha256"] == __import__("hashlib").sha256(brute.span_names(base).encode()).hexdigest()
        own = [s for s in got[i]["spans"].split(",") if s and not s.startswith("term")]
        assert ",".join(own) == brute.span_names(base)


def test_binary_output(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got, start = rows(spark, "op10"), 0
    for i, text in docs:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        assert tuple(got[i])[1:] == (start, len(ids), brute.crc_of(ids))
        start += len(ids)


def test_chat(spark):
    turns = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet' order by 1, 2, 3, 4").fetchall()
    convs = {}
    for c, _, role, text in turns:
        convs.setdefault(c, []).append((role, text))
    got = {r["conv_id"]: r for r in QUERIES[BY["op3"]](spark, SF).collect()}
    assert {i: r["n_copies"] for i, r in got.items()} == brute.prefix_maximal(convs)
    for i, r in got.items():
        assert r["rendered"] == "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in convs[i])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: [str(x) for x in r]
    ours = sorted(([r[c] for c in columns] for r in got.collect()), key=key)
    theirs = sorted((list(r) for r in con.sql(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()), key=key)
    assert ours == theirs


def test_words_are_ascii_separated():
    assert brute.quality("a\u00a0b c")["n_words"] == 2
