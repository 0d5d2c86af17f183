"""The pipeline from end to end, each stage held against the plain version of its operator on that stage's own input."""

import random
from collections import Counter

import corpus_pipeline
from tests.llm import brute
from weftgraph.llm import classifier
from weftgraph.llm.common import table
from weftgraph.llm.queries import tokenizer


def made(spark, folder):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "ti", "re", "lo", "ka", "mu"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(30)
    docs = []
    for i in range(240):
        text = prose(r.randint(25, 80)) + "."
        if i % 6 == 0:
            text = "awful ### " * 20 + text
        if i % 20 == 7:
            text = f"{text} {passage}"
        if i % 9 == 4:
            text += f" Write to user{i}@corp.example or 10.0.0.{i}."
        docs.append((i, text))
    docs += [(500 + i, docs[i][1]) for i in range(0, 40)]  # exact copies
    docs += [(900, None), (901, ""), (902, docs[1][1])]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, prose(20)), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    sf = str(tmp_path)
    made(spark, sf)
    docs, seen = table(spark, sf, "documents"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(x) for x in docs.collect()]
        stage(spark, docs, sf).write.parquet(f"{sf}/out{k}")
        docs = spark.read.parquet(f"{sf}/out{k}")
        seen[name] = (before, [tuple(x) for x in docs.collect()])
        assert name == "best_fit_packing" or docs.columns == columns

    before, after = seen["quality_classifier"]
    kept = {r["doc_id"] for r in classifier.report(table(spark, sf, "documents"), table(spark, sf, "labels")).where("kept").collect()}
    assert Counter(after) == Counter(x for x in before if x[0] in kept) and len(after) < len(before)
    assert sum(i < 240 and i % 6 != 0 for i, *_ in after) >= 190  # clean documents stay

    before, after = seen["simhash_near_dedup"]
    roots = brute.components({x[0]: brute.fingerprint(x[1]) for x in before})
    assert Counter(after) == Counter(x for x in before if roots[x[0]] == x[0]) and len(after) < len(before)

    before, after = seen["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert Counter(after) == Counter(x for x in before if not brute.contamination(x[1], items)["contaminated"]) and len(after) < len(before)

    before, after = seen["pii"]
    assert [x[0] for x in sorted(before)] == [x[0] for x in sorted(after)]
    for x, y in zip(sorted(before), sorted(after), strict=True):
        spans = brute.base_spans(x[1])
        assert x[2:] == y[2:] and (spans or x[1] == y[1])
        assert all(x[1][a:z] not in y[1] for a, _, z in spans) and len(brute.base_spans(y[1])) == 0

    before, after = seen["best_fit_packing"]
    tok, want = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), Counter()
    for x in before:
        ids = [*tok.encode(x[1] or "", add_special_tokens=False).ids, 1]
        want[x[0], len(ids), brute.crc_of(ids)] += 1
    rows = docs.collect()
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 4096)

    whole = [tuple(x) for x in corpus_pipeline.run(spark, sf).select("doc_id", "length", "ids_crc32").collect()]
    assert sorted(whole) == sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in rows)
