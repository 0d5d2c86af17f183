"""Rendezvous hashing over weighted shards, in DataFrame expressions alone.

Each shard draws a number from the record key and its own number; the shard with the least ``-ln(u) / weight``
takes the record. A shard that is added can only take records to itself. The draw is the first 52 bits of an
MD5, which any engine can make again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import ranked

SLOT_BUCKETS = 256


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from a record's key and a shard."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, that a record key goes to; shards of weight 0 get nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight over 0")
    score = [F.struct((-F.ln(draw(key, s)) / float(w)).alias("c"), F.lit(s).alias("s")) for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*score))["s"]


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    Rows with equal doc_ids go to one shard and get slots of their own, in order of text; a null doc_id is a key
    like any other; a null text counts as empty. Slots follow the key's MD5 bucket and doc_id, and are numbered
    bucket by bucket, so that a shard never meets in one task. An empty table gives an empty table, and other
    columns of docs are ignored.
    """
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id")
    more = shard_of(key, grown) if grown else F.lit(None).cast("int")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), shard_of(key, weights).alias("shard"), more.alias("grown_shard"))
    salt = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 6), 16, 10).cast("long")
    out = ranked(rows, [F.col("shard")], [key.asc_nulls_first(), F.col("text_crc32")], "slot", buckets, salt)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
