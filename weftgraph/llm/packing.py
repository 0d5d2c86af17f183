"""Best-fit packing after a Martello-Toth dominance reduction.

A sequence's capacity bounds the number of different piece lengths, so that the instance is a table of counts
by length whatever the number of pieces. On that table the reduction fixes sets of pieces that provably
dominate every other set with the same largest piece, and best-fit decreasing packs the rest; both work on
whole classes of equal pieces. The plan comes back as runs of ranks within a length, and pieces find their place
by rank, which is made without a length's pieces meeting in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import RID, Scratch, bound_batches, keyed, over_batches, ranked, texts
from weftgraph.llm.encoders import encoder

CAPACITY, END = 4096, 1


def reduce_instance(count: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
    """(fixed, rest): fixed has (sequences, lengths in each), rest the counts of what isn't fixed.

    With piece j, the largest left, and room r beside it, a set is fixed if every other set with j can be made
    from it by exchanging pieces for smaller ones: j alone if nothing fits; j and the largest fitting piece k if
    k fills r, if no two pieces fit in r, or if at most two fit and no two that fit exceed k.
    """
    left = {n: c for n, c in count.items() if c > 0}
    sizes = sorted(left)
    fixed: list[tuple[int, list[int]]] = []

    def least(k: int, without: int) -> list[int]:
        got: list[int] = []
        for n in sizes:
            got += [n] * min(k - len(got), left[n] - (n == without))
            if len(got) >= k:
                break
        return got

    def best_pair(room: int, without: int) -> int:
        most, lo, hi = 0, 0, bisect_left(sizes, room) - 1
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            if a + b > room or left[b] - (b == without) < 1 + (a == b):
                hi -= 1
            elif left[a] - (a == without) < 1:
                lo += 1
            else:
                most = max(most, a + b)
                lo += 1
        return most

    for j in sorted(sizes, reverse=True):
        while left.get(j, 0):
            room = capacity - j
            at = bisect_left(sizes, room + 1) - 1
            while at >= 0 and left[sizes[at]] - (sizes[at] == j) < 1:
                at -= 1
            if at < 0:
                k, sets = 0, left[j]
            else:
                k = sizes[at]
                small = least(3, j)
                two, three = sum(small[:2]) if len(small) > 1 else room + 1, sum(small) if len(small) > 2 else room + 1
                if not (k == room or two > room or (three > room and best_pair(room, j) <= k)):
                    break
                sets = left[j] // 2 if k == j else min(left[j], left[k])  # pieces only go, so that the test holds on
            fixed.append((sets, [j, k] if k else [j]))
            for n in (j, k) if k else (j,):
                left[n] -= sets
                if not left[n]:
                    del left[n]
                    sizes.remove(n)
            if not left.get(j, 0):
                break
    return fixed, left


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing over classes of equal pieces: (sequences, lengths in each)."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)

    def put(room: int, sets: int, held: list[int]) -> None:
        if sets:
            if not bins[room]:
                insort(rooms, room)
            bins[room].append((sets, held))

    for n in sorted(count, reverse=True):
        c = count[n]
        while c:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                put(capacity - n * each, c // each, [n] * each)
                if c % each:
                    put(capacity - n * (c % each), 1, [n] * (c % each))
                break
            room = rooms[at]
            sets, held = bins[room].pop()
            if not bins[room]:
                rooms.pop(at)
            each = room // n
            if full := min(sets, c // each):
                put(room - n * each, full, held + [n] * each)
                c -= full * each
                sets -= full
            if sets and c and c < each:
                put(room - n * c, 1, held + [n] * c)
                sets, c = sets - 1, 0
            put(room, sets, held)
    return [x for own in bins.values() for x in own]


def plan(count: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the runs of ranks: first rank, first sequence, offset in the sequence."""
    fixed, rest = reduce_instance(count, capacity)
    used: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for sets, held in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for n in held:
            runs[n].append((used[n], sequence, offset))
            used[n] += sets
            offset += n
        sequence += sets
    if dict(used) != {n: c for n, c in count.items() if c}:
        raise AssertionError("the plan doesn't hold every piece once")
    return {n: tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) for n, own in runs.items()}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """RID, doc_id, piece, start, length, ids_crc32 for each piece of each row of docs, which has RID."""
    last = np.array([end], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows = encoder(path, False), []
        step = 4 * capacity
        for k, t in enumerate(texts(batch.column(2))):
            raw = enc.ids(t) + last
            for i, a in enumerate(range(0, len(raw), step)):
                part = raw[a : a + step]
                rows.append((k, i, a // 4, len(part) // 4, zlib.crc32(part)))
        cols = np.array(rows, np.int64).reshape(-1, 5).T
        take = pa.array(cols[0])
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cols[1].astype(np.int32)), *[pa.array(c) for c in cols[2:]]], names=[RID, "doc_id", "piece", "start", "length", "ids_crc32"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(RID, "doc_id", "text").mapInArrow(over_batches(work, keeps=True), f"{RID} long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs.

    A null or empty text is the end id alone. Only documents over the capacity are cut. Equal rows are packed
    one by one. An empty table gives an empty table; other columns of docs are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(pieces(keyed(docs.select("doc_id", "text")), path, capacity, end), "pieces")
    count = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # at most one row for each length
    runs = plan(count, capacity)
    buckets = max(1, min(4096, sum(count.values()) // 20_000))
    placed = ranked(rows, [F.col("length")], [F.col(RID), F.col("piece")], "rank", buckets, F.xxhash64(RID, "piece"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 6))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            first, base, place = runs[n]
            run = np.searchsorted(first, rank[own], side="right") - 1
            sequence[own], offset[own] = base[run] + rank[own] - first[run], place[run]
        return pa.RecordBatch.from_arrays([*batch.columns[1:6], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.select(RID, "doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(over_batches(work), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
