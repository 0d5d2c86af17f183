"""Benchmark decontamination by Wu-Manber multi-pattern search over word sequences.

Patterns of one length in words form a class. Its shift table says for a block of words how far the search can
move on without passing an occurrence; a block that may end a pattern selects, by the hash of that block, a
bucket of patterns, which are compared word by word. The benchmark's windows are searched in blocks of a
bounded number of patterns, so that what tasks carry is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import RID, Scratch, bound_batches, keyed, over_batches, texts

WINDOW, PATTERNS = 13, 50_000
#: Lower-cases A-Z, keeps 0-9, a-z and bytes over 0x7F, and makes all else a space.
WORDS = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32) for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class WuManber:
    """Occurrences of many word sequences in a word sequence."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        by_length = defaultdict(list)
        for k, p in enumerate(patterns):
            by_length[len(p)].append((k, p))
        self.classes = []
        for m, own in sorted(by_length.items()):
            block = min(2, m)
            shift: dict[bytes, int] = {}
            buckets = defaultdict(list)
            for k, p in own:
                for end in range(block, m + 1):
                    key = b" ".join(p[end - block : end])
                    shift[key] = min(shift.get(key, m), m - end)
                buckets[b" ".join(p[m - block :])].append((p, k))
            self.classes.append((m, block, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> Iterable[tuple[int, int, int]]:
        """(pattern, first word, length) of every occurrence."""
        n = len(words)
        for m, block, shift, buckets in self.classes:
            far, get, end = m - block + 1, shift.get, m
            while end <= n:
                key = words[end - 1] if block == 1 else words[end - 2] + b" " + words[end - 1]
                if move := get(key, far):
                    end += move
                    continue
                for p, k in buckets[key]:
                    if words[end - m] == p[0] and tuple(words[end - m : end]) == p:
                        yield k, end - m, m
                end += 1


def _pattern_blocks(benchmark: DataFrame, scratch: Scratch, most: int, unnamed: bool) -> tuple[DataFrame, int]:
    """Distinct windows with their items, dealt to numbered blocks of about ``most`` patterns."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(b" ".join(w), i) for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) for w in set(windows_of(words_of(t)))]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["pattern", "item"])

    items = (benchmark if unnamed else benchmark.where(F.col("item_id").isNotNull())).select(F.col("item_id").cast("string").alias("item"), "text")
    rows = scratch.write(items.mapInArrow(over_batches(work), "pattern binary, item string").distinct(), "patterns")
    n = rows.count()
    blocks = max(1, -(-n // most))
    return rows.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks))), blocks


class Block:
    """Patterns and the items that hold them; a worker builds the search tables when it first needs them."""

    def __init__(self, of: dict[bytes, list[str | None]]):
        self.patterns = sorted(of)
        self.owners, self.made = [of[k] for k in self.patterns], None

    def __getstate__(self):
        return {**self.__dict__, "made": None}

    def search(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        """The hit words as disjoint runs (first, end, ...), and the items found."""
        if self.made is None:
            self.made = WuManber([tuple(k.split(b" ")) for k in self.patterns])
        runs, found = [], set()
        for k, first, m in self.made.search(words):
            found.update(i for i in self.owners[k] if i is not None)
            runs += [first, first + m]
        return merged(runs), sorted(found)


def _search(docs: DataFrame, rows: DataFrame, b: int):
    """docs with __wg_n, __wg_hit and __wg_items for one block of patterns, and the broadcast that it needs."""
    of = defaultdict(list)
    for r in rows.where(F.col("block") == b).select("pattern", "item").toLocalIterator():  # about PATTERNS rows
        of[bytes(r[0])].append(r[1])
    shared = docs.sparkSession.sparkContext.broadcast(Block(of))
    place = docs.columns.index("text")
    schema = docs.select("*", F.lit(0).cast("long").alias("__wg_n"), F.array(F.lit(0)).alias("__wg_hit"), F.array(F.lit("")).alias("__wg_items")).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = [words_of(t) for t in texts(batch.column(place))]
        got = [shared.value.search(words) for words in split]
        made = [pa.array([len(w) for w in split], pa.int64()), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "__wg_n", "__wg_hit", "__wg_items"])

    return docs.mapInArrow(over_batches(work), schema), shared


def contamination(docs: DataFrame, benchmark: DataFrame, block_patterns: int = PATTERNS, unnamed: bool = False) -> DataFrame:
    """docs, with all its columns, plus __wg_n (words), __wg_hit (disjoint runs of hit words as first, end pairs) and
    __wg_items (items found, as strings, sorted).

    A benchmark of one block is searched in the scan of docs itself. Of a larger one, block after block is searched and
    its hits written, so that neither the driver nor a task ever holds more than one block; hits meet by row.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    rows, blocks = _pattern_blocks(benchmark, scratch, block_patterns, unnamed)
    if blocks == 1:
        return _search(docs, rows, 0)[0]
    have = keyed(docs)
    parts = []
    for b in range(blocks):
        part, shared = _search(have.select(RID, "text"), rows, b)
        parts.append(scratch.write(part.drop("text"), f"hits{b}"))
        shared.destroy()
    every = reduce(DataFrame.union, parts)
    once = every.groupBy(RID).agg(F.max("__wg_n").alias("__wg_n"), F.flatten(F.collect_list("__wg_hit")).alias("__wg_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__wg_items")))).alias("__wg_items"))
    merge = F.pandas_udf(lambda col: col.map(merged), "array<int>")
    return have.join(once.withColumn("__wg_hit", merge("__wg_hit")), RID).drop(RID)


def report(docs: DataFrame, benchmark: DataFrame, block_patterns: int = PATTERNS, unnamed: bool = False) -> DataFrame:
    """Each row's doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit_runs.

    Null texts have no words and are never contaminated; items with equal ids count once. With
    ``unnamed``, windows of benchmark rows without an item_id count in n_hit, hit_runs and contaminated, and only the
    missing id is left out of n_items and items_sha256; otherwise such rows are ignored. An empty benchmark hits nothing.
    Equal rows are reported one by one.
    """
    one = contamination(docs.select("doc_id", "text"), benchmark, block_patterns, unnamed)
    n_hit, n = _hit_words("__wg_hit"), F.col("__wg_n")
    return one.select("doc_id", n.alias("n_words"), n_hit.alias("n_hit"), F.size("__wg_items").cast("long").alias("n_items"), F.sha2(F.array_join("__wg_items", ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= n)).alias("contaminated"), F.col("__wg_hit").alias("hit_runs"))


def _hit_words(runs: str):
    return F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def merged(runs) -> list[int]:
    """Disjoint runs, as first, end, first, end, ..., from runs in any order."""
    out: list[int] = []
    for a, z in sorted(zip(runs[::2], runs[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], int(z))
        else:
            out += [int(a), int(z)]
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block_patterns: int = PATTERNS, unnamed: bool = False) -> DataFrame:
    """docs without contaminated rows; all columns stay. Rows with null or empty texts have no words and stay; other
    cases are as in ``report``."""
    hit = _hit_words("__wg_hit")
    found = contamination(docs, benchmark, block_patterns, unnamed)
    return found.where(~((hit > 0) & (20 * hit >= F.col("__wg_n")))).select(*docs.columns)
