"""The queries over the driver's tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import binary_output, chat_snapshots, classifier, decontaminate, oracle, packing, pii, quality_rules, sharding, simhash, suffix_dedup
from weftgraph.llm.common import RID, keyed, table

SHARDS = 16


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents")).drop("clean_text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.maximal(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = simhash.near_duplicates(docs)
    rows = docs.select(F.col(RID).alias("component"), F.col("doc_id").alias("component_id")).join(found, "component", "right")
    named = docs.select(RID, "doc_id").join(rows, RID)
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True).drop("hit_runs")


def op6_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return binary_output.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), parts)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_chat_snapshots, op4_simhash, op5_decontaminate, op6_rendezvous, op7_best_fit_packing, op8_quality_classifier, op9_pii, op10_bit_planes)}
ORACLE: dict[str, str] = {
    "op1_quality_rules": oracle.quality_sql(),
    "op2_suffix_dedup": oracle.repeats_sql(),
    "op3_chat_snapshots": oracle.CHATS,
    "op5_decontaminate": oracle.contamination_sql(),
    "op6_rendezvous": oracle.sharding_sql(SHARDS, SHARDS + 1),
}
