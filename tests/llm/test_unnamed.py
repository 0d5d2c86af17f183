"""Benchmark rows without an item_id, through op5 and the pipeline's stage."""

import corpus_pipeline
from weftgraph.llm.queries import QUERIES


def test_items_without_id(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage), (2, "other")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, passage), (7, "absent")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in QUERIES["op5_decontaminate"](spark, str(tmp_path)).collect()}
    assert got == {1: (20, 0, True), 2: (0, 0, False)}
    assert [r["doc_id"] for r in corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()] == [2]
