"""SimHash near-dedup: fingerprints are cut into blocks, close pairs share blocks, joined pairs are verified.

Five blocks; a pair that differs in at most two bits is equal on three of them, so each of the ten choices of
three blocks is a join key of about 38 bits. Exact copies collapse to one fingerprint before anything is joined.
A bucket with more than ``bucket_cap`` different fingerprints isn't compared pair by pair: its members meet at
midpoints instead. Two fingerprints differ in at most two bits exactly if flipping at most one bit of each
reaches a common value, and at most 27 members can meet at one value, so that no link is lost and no group of
pairs grows. Components come from alternating star contraction over written tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import RID, Scratch, bound_batches, keyed, over_batches, texts

BITS, BLOCKS, SAME, RADIUS, SEED = 64, 5, 3, 2, 42
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bits of XXH64 over the text's word shingles, repeats included; 0 for no words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return int.from_bytes(digest(b" ".join(words), SEED), "big")
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    first = (ends - lens)[: len(words) - width + 1].tolist()
    last = ends[width - 1 :].tolist()
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)])
    n, ones = len(first), np.zeros(BITS, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 8192):
        ones += np.unpackbits(rows[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """RID and ``fp`` (the fingerprint's 64 bits as a signed long) of each row of docs, which has RID."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t, width) for t in texts(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=[RID, "fp"])

    bound_batches(docs.sparkSession)
    return docs.select(RID, "text").mapInArrow(over_batches(work), f"{RID} long, fp long")


def _block_masks() -> list[int]:
    cuts = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(BLOCKS), SAME)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, scratch: Scratch, bucket_cap: int = 24) -> DataFrame:
    """Edges (a, b), a > b, that connect the distinct fingerprints ``fp`` as all pairs within RADIUS bits do."""
    masks = _block_masks()
    keys = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_long(m))) for m in masks])).alias("combo", "block"))
    sizes = keys.groupBy("combo", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.write(keys.join(sizes, ["combo", "block"]), "blocks")
    small = shared.where(F.col("n") <= bucket_cap).drop("n")
    left, right = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = left.join(right, ["combo", "block"]).where((F.col("a") > F.col("b")) & close).select("a", "b")
    free = [[_long(1 << i) for i in range(BITS) if not m >> i & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in bits]) for bits in free]), F.col("combo") + 1)
    large = shared.where(F.col("n") > bucket_cap)
    middles = large.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")).distinct()
    least = middles.groupBy("middle").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all"))
    stars = least.where(F.size("all") > 1).select(F.explode("all").alias("a"), "b").where("a > b")
    return pairs.union(stars).distinct()


def star_components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, root): for every node of the edges the smallest node that it reaches; itself for the root."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges0")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    seen = mark(now)
    for turn in range(1, most + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        then = scratch.write(small.select("e.a", "e.b").where("a <> b").distinct(), f"edges{turn}")
        now_mark = mark(then)
        scratch.drop(f"edges{turn - 1}")
        now = then
        if now_mark == seen:
            break
        seen = now_mark
    else:
        raise RuntimeError("star contraction did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, bucket_cap: int = 24) -> DataFrame:
    """RID, fp and ``component`` (the smallest RID reachable over links, itself included) of each row of docs.

    Null and empty texts have fingerprint zero and link like any other. Rows with equal ids or texts are
    separate rows that link. An empty table gives an empty table. Other columns of docs are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    have = docs if RID in docs.columns else keyed(docs)
    prints = scratch.write(fingerprints(have, width), "prints")
    firsts = scratch.write(prints.groupBy("fp").agg(F.min(RID).alias("first")), "firsts")
    roots = star_components(links(firsts.select("fp"), scratch, bucket_cap), scratch)
    labelled = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = scratch.write(labelled, "labelled")
    scratch.drop("blocks")
    groups = labelled.groupBy("root").agg(F.min("first").alias("component"))
    named = labelled.join(groups, "root").select("fp", "component")
    return prints.join(named, "fp").select(RID, "fp", "component")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that another row of their component precedes; all columns stay."""
    have = keyed(docs)
    scratch = Scratch(docs.sparkSession)
    gone = scratch.write(near_duplicates(have).where(F.col(RID) != F.col("component")).select(RID), "gone")
    return have.join(gone, RID, "left_anti").select(*docs.columns)
