"""Suffix-array dedup: repeats of at least ``length`` bytes as intervals of a common-prefix tree.

Every window of ``length`` bytes has an anchor: the GRAM bytes in it with the least hash, the leftmost of equals.
Equal windows have equal anchors at equal places, so that windows whose anchor occurs once can't repeat. The
windows of one anchor occurrence are consecutive; together they cover its context. Then

1. anchors are counted, and the occurrences of repeated ones are kept;
2. equal contexts (by the 128-bit BLAKE2b digest of their bytes) are one class, of which only the first occurrence goes
   on: all windows of the others repeat;
3. the classes that share an anchor are a bucket. Its contexts' suffixes form an enhanced suffix array (ranks,
   common-prefix lengths). Only suffixes whose window can't be extended to the left with all its occurrences
   enter, and a stack scan closes the intervals of common-prefix length ``length`` or more: each is a repeat with
   all its occurrences, maximal to the right. One whose bytes before the occurrences differ, or are cut off, is
   maximal to the left too: these are the groups that are put out (``groups``) and removed by;
4. buckets with over ``bucket_cap`` classes are not sorted in one task: their windows are compared by 128-bit
   digests, grouped with partial aggregation. The spans are the same.

An occurrence is removed over the longest maximal group in which it isn't the first. Contexts are cut at the windows
that share the anchor; a longer repeat shows in several buckets, and removed runs are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import RID, Scratch, bound_batches, keyed, over_batches, utf8

LENGTH, GRAM, BUCKET_CAP = 100, 32, 32_768
U = np.uint64
_BASE, _BASE2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240229)
_BYTE, _BYTE2 = (_rng.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2))
CHUNK = 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


class Rolling:
    """Hashes of substrings of a byte string, from prefix sums modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, base: np.uint64 = _BASE, byte: np.ndarray = _BYTE):
        n = len(buf)
        have = self._powers.get(int(base))
        if have is None or len(have[0]) <= n:
            inverse = U(pow(int(base), -1, 1 << 64))
            up, down = np.full(n + CHUNK, base, U), np.full(n + CHUNK, inverse, U)
            up[0] = down[0] = 1
            have = self._powers[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        self.up = have[0]
        self.sums = np.zeros(n + 1, U)
        np.cumsum(byte[buf] * have[1][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.up[start])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.up[:n])


def digests(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests of the substrings [start, end) of buf, as two columns of signed longs."""
    raw, make = buf.tobytes(), hashlib.blake2b
    whole = b"".join([make(raw[a:z], digest_size=16).digest() for a, z in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(whole, np.int64).reshape(-1, 2)


def anchor_runs(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM, lean: bool = False) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, context digest) of each anchor occurrence of the rows of buf; lean ones
    have no digest."""
    empty = tuple(np.zeros(n, t) for n, t in ((0, np.int64), (0, np.int64), (0, np.int64), (0, U), ((0, 2), np.int64)))
    n, width = len(buf), length - gram + 1
    if n < length:
        return empty
    rolling = Rolling(buf)
    grams = rolling.grams(gram)
    least = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: span - width], least[width - span :])
    anchor = (least & U(0xFFFFFFFF)).astype(np.int64)
    lens = np.diff(off)
    ok = np.repeat(lens >= length, lens)
    ends = off[1:][lens >= length]
    for k in range(1, length):  # the last windows would cross into the next row
        ok[ends - k] = False
    place = np.flatnonzero(ok[: len(anchor)])
    if not len(place):
        return empty
    anchor = anchor[place]
    new = np.empty(len(place), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    start, last = place[first], place[np.append(first[1:], len(place)) - 1]
    at = anchor[first]
    row = np.searchsorted(off, start, side="right") - 1
    return row, start - off[row], last - start + 1, grams[at], empty[-1] if lean else digests(buf, start, last + length)


def _chunks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about CHUNK bytes."""
    a, n = 0, len(off) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, side="right")) - 1)
        yield a, z
        a = z


def anchors(docs: DataFrame, length: int, gram: int, lean: bool) -> DataFrame:
    """h (anchor), and unless lean c and c2 (context), RID and run (first window * 2**16 + windows) of every occurrence.

    A row's hashes don't depend on the rows beside it.
    """
    names = ["h", *([] if lean else ["c", "c2", RID, "run"])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, z in _chunks(off):
                row, first, windows, h, c = anchor_runs(buf[off[a] : off[z]], off[a : z + 1] - off[a], length, gram, lean)
                cols = [h.view(np.int64), *([] if lean else [c[:, 0], c[:, 1], ids[a:z][row], (first << 16) | windows])]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], names=names)

    return docs.select(RID, "text").mapInArrow(work, ", ".join(f"{n} long" for n in names))


def common_prefix(buf: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes at places a and b of buf, at most ``most``."""
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    step = 16
    wide = np.concatenate([buf, np.zeros(step, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(wide, step)
    while len(live):
        same = view[a[live] + out[live]] == view[b[live] + out[live]]
        whole = same.all(axis=1)
        out[live] += np.where(whole, step, same.argmin(axis=1))
        live = live[whole & (out[live] < most[live])]
    return np.minimum(out, most)


def intervals(prefix: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first rank, last rank) of the common-prefix intervals; prefix[i] is that of ranks i - 1 and i.

    Children come before their parents.
    """
    stack: list[list[int]] = []
    for i, n in enumerate([*prefix[1:], 0], 1):
        low = i - 1
        while stack and stack[-1][0] > n:
            size, low = stack.pop()
            yield size, low, i - 1
        if n >= least and (not stack or stack[-1][0] < n):
            stack.append([n, low])


class Repeats:
    """The repeats among contexts: an enhanced suffix array and its common-prefix intervals.

    group, order: a context's bucket and its rank among all occurrences; windows start at the first ``windows``
    bytes of a context.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, group: np.ndarray, windows: np.ndarray, order: np.ndarray, length: int):
        self.length, self.buf = length, buf
        context = np.repeat(np.arange(len(windows)), windows)
        shift = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = off[context] + shift
        key = Rolling(buf).of(place, place + length) ^ _mix(group[context].astype(U) * _BASE2)
        key2 = Rolling(buf, _BASE2, _BYTE2).of(place, place + length)
        by = np.lexsort((key2, key))
        new = np.ones(len(by), bool)
        new[1:] = (key[by][1:] != key[by][:-1]) | (key2[by][1:] != key2[by][:-1])
        cls = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        before = np.where(shift > 0, buf[np.maximum(place - 1, 0)].astype(np.int64), -1)[by]
        low, high = (f.reduceat(before, first) if len(by) else before for f in (np.minimum, np.maximum))
        open_ = (np.bincount(cls) > 1) & ((low != high) | (low < 0)) if len(by) else np.zeros(0, bool)
        chosen = np.sort(by[open_[cls]])
        context, shift, place = context[chosen], shift[chosen], place[chosen]
        size = off[context + 1] - place
        # suffixes in order of bucket, bytes and length
        most = int(size.max()) if len(size) else length
        wide = np.concatenate([buf, np.zeros(most, np.uint8)])
        by = np.lexsort((size, group[context]))
        if len(by):
            rows = np.lib.stride_tricks.sliding_window_view(wide, most)[place[by]]
            rows[np.arange(most) >= size[by][:, None]] = 0
            head = group[context][by].astype(">u8").view(np.uint8).reshape(-1, 8)
            full = np.ascontiguousarray(np.concatenate([head, rows], axis=1)).view(np.dtype((np.void, most + 8))).ravel()
            by = by[np.argsort(full, kind="stable")]
        self.context, self.shift, self.size, self.place = context[by], shift[by], size[by], place[by]
        self.order, n = order[self.context], len(by)
        self.prefix = np.zeros(n, np.int64)
        if n > 1:
            same = group[self.context[1:]] == group[self.context[:-1]]
            self.prefix[1:] = common_prefix(wide, self.place[:-1], self.place[1:], np.where(same, np.minimum(self.size[1:], self.size[:-1]), 0))

    def tree(self) -> list[tuple[int, int, int]]:
        return list(intervals(self.prefix.tolist(), self.length))

    def maximal(self) -> Iterator[tuple[int, int, int, bool]]:
        """The intervals, and whether no byte extends them to the left: the byte before differs, or is cut off somewhere."""
        before = np.where(self.shift > 0, self.buf[np.maximum(self.place - 1, 0)].astype(np.int64), -1 - np.arange(len(self.place)))
        change = np.zeros(len(before) + 1, np.int64)
        if len(before) > 1:
            change[2:] = np.cumsum(before[1:] != before[:-1])
        for size, low, high in self.tree():
            yield size, low, high, change[high + 1] > change[low + 1]

    def removed(self) -> np.ndarray:
        """For each rank the bytes from its place that also start earlier, by the maximal groups that hold it; 0 for none."""
        out, order = [0] * len(self.place), self.order.tolist()
        first: dict[int, tuple[int, int]] = {}  # by first rank of a closed interval: its last rank and its first occurrence
        for size, low, high, whole in self.maximal():
            best, i = -1, low
            while i <= high:
                end, own = first.pop(i, (i, i))
                if best < 0:
                    best = own
                else:
                    if order[own] < order[best]:
                        best, own = own, best
                    if whole:
                        out[own] = max(out[own], size)
                i = end + 1
            first[low] = (high, best)
        return np.array(out, np.int64)


def _bucket_batches(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Whole buckets of a partition that is sorted by bucket (column 0), many at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            all_ = pa.Table.from_batches(held).combine_chunks()
            h = all_.column(0).to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
            if cut:
                yield all_.slice(0, cut).combine_chunks()
                held = all_.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _repeats(rows: pa.Table, length: int) -> tuple[Repeats, np.ndarray, np.ndarray]:
    h, ids, run = (rows.column(i).to_numpy() for i in range(3))
    buf, off = utf8(rows.column(3))
    order = np.empty(len(ids), np.int64)
    order[np.lexsort((run >> 16, ids))] = np.arange(len(ids))
    group = np.zeros(len(h), np.int64)
    group[1:] = np.cumsum(h[1:] != h[:-1])
    return Repeats(buf, off, group, run & 0xFFFF, order, length), ids, run


class Dedup:
    """The job over docs (RID, text): tables in the shared folder that later steps start from."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_cap: int = BUCKET_CAP):
        bound_batches(docs.sparkSession)
        self.docs, self.length, self.cap = docs.select(RID, "text"), length, bucket_cap
        self.scratch = scratch = Scratch(docs.sparkSession)
        counts = anchors(self.docs, length, gram, True).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        twice = scratch.write(counts.where("n > 1").select("h"), "twice")  # a table, so that the join can split a hot anchor
        self.runs = scratch.write(anchors(self.docs, length, gram, False).join(twice, "h", "left_semi"), "runs")
        scratch.release()
        firsts = self.runs.groupBy("h", "c", "c2").agg(F.min(F.struct(RID, "run")).alias("f"), F.count(F.lit(1)).alias("n"))
        self.firsts = scratch.write(firsts.select("h", "c", "c2", f"f.{RID}", "f.run", "n"), "firsts")
        shared = self.firsts.groupBy("h").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
        open_ = self.firsts.join(shared, "h").select("h", RID, "run", (F.col("classes") > self.cap).alias("large"))
        self.open = scratch.write(self._contexts(open_), "open")
        scratch.release()

    def _contexts(self, open_: DataFrame) -> DataFrame:
        length, names = self.length, ["h", RID, "run", "large", "bytes"]
        per = open_.groupBy(RID).agg(F.collect_list("h").alias("h"), F.collect_list("run").alias("run"), F.collect_list("large").alias("large"))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            buf, off = utf8(batch.column(1))
            raw, out = buf.tobytes(), []
            for k, (rid, hs, runs, large) in enumerate(zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)], strict=True)):
                base = int(off[k])
                for h, run, big in zip(hs, runs, large, strict=True):
                    a = base + (run >> 16)
                    out.append((h, rid, run, big, raw[a : a + (run & 0xFFFF) + length - 1]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names) if out else None

        return self.docs.join(per, RID).select(RID, "text", "h", "run", "large").mapInArrow(over_batches(work), f"h long, {RID} long, run long, large boolean, bytes binary")

    def _sorted(self) -> DataFrame:
        return self.open.where("not large").select("h", RID, "run", "bytes").repartition("h").sortWithinPartitions("h")

    def tree_spans(self) -> DataFrame:
        """RID, a, z: removed spans that the buckets' trees show."""
        length = self.length

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _bucket_batches(batches):
                found, ids, run = _repeats(rows, length)
                size = found.removed()
                hit = np.flatnonzero(size)
                own = found.context[hit]
                a = (run[own] >> 16) + found.shift[hit]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(a), pa.array(a + size[hit])], names=[RID, "a", "z"])

        return self._sorted().mapInArrow(work, f"{RID} long, a long, z long")

    def repeats(self) -> DataFrame:
        """Maximal repeats among classes of equal contexts: h and ``repeat`` name one, with its length in bytes, and the
        RID, run and start of an occurrence in each class's first context."""
        length = self.length

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _bucket_batches(batches):
                found, ids, run = _repeats(rows, length)
                h = rows.column(0).to_numpy()
                for size, low, high, whole in found.maximal():
                    if not whole:
                        continue
                    own = found.context[low : high + 1]
                    n = len(own)
                    cols = [h[own], np.full(n, (int(found.place[low]) << 12) | size), np.full(n, size), ids[own], run[own], (run[own] >> 16) + found.shift[low : high + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "repeat", "length", RID, "run", "start"])

        return self._sorted().mapInArrow(work, f"h long, repeat long, length long, {RID} long, run long, start long")

    def groups(self) -> DataFrame:
        """The maximal repeat groups with all their occurrences: h and ``repeat`` name one, length, and each occurrence's RID
        and start. A class of equal contexts that nothing else shares is a group of its own (``repeat`` is -1 and c tells
        it from others of its anchor). Buckets over ``bucket_cap`` have their classes only."""
        first = self.firsts.where("n > 1").select("h", "c", "c2", F.col(RID).alias("fr"), F.col("run").alias("fn"))
        members = self.runs.join(first, ["h", "c", "c2"])
        a, windows = F.shiftright("run", 16), F.col("run").bitwiseAND(F.lit(0xFFFF))
        alone = members.select("h", F.lit(-1).cast("long").alias("repeat"), "c", (windows + (self.length - 1)).alias("length"), RID, a.alias("start"))
        others = members.where((F.col(RID) != F.col("fr")) | (F.col("run") != F.col("fn"))).select("h", "fr", "fn", F.col(RID).alias("__r"), a.alias("__a"))
        shared = self.repeats()
        more = shared.withColumnsRenamed({RID: "fr", "run": "fn"}).join(others, ["h", "fr", "fn"])
        shown = more.select("h", "repeat", F.lit(0).cast("long").alias("c"), "length", F.col("__r").alias(RID), (F.col("start") - F.shiftright("fn", 16) + F.col("__a")).alias("start"))
        return shared.select("h", "repeat", F.lit(0).cast("long").alias("c"), "length", RID, "start").unionByName(shown).unionByName(alone)

    def window_spans(self) -> DataFrame:
        """RID, a, z: removed windows of the buckets that are too large for one task."""
        length = self.length

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if not len(batch):
                return None
            buf, off = utf8(batch.column(2))
            ids, run = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            windows = run & 0xFFFF
            context = np.repeat(np.arange(len(run)), windows)
            shift = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
            place = off[context] + shift
            keys = digests(buf, place, place + length)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (keys[:, 0], keys[:, 1], ids[context], (run >> 16)[context] + shift)], names=["k", "k2", RID, "a"])

        rows = self.open.where("large").select(RID, "run", "bytes").mapInArrow(over_batches(work), f"k long, k2 long, {RID} long, a long")
        first = rows.groupBy("k", "k2").agg(F.min(F.struct(RID, "a")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return rows.join(first, ["k", "k2"]).where(F.struct(RID, "a") != F.col("f")).select(RID, "a", (F.col("a") + length).alias("z"))

    def copy_spans(self) -> DataFrame:
        """RID, a, z: the contexts that aren't the first of their class."""
        first = self.firsts.where("n > 1").select("h", "c", "c2", F.col(RID).alias("fr"), F.col("run").alias("fn"))
        later = self.runs.join(first, ["h", "c", "c2"]).where((F.col(RID) != F.col("fr")) | (F.col("run") != F.col("fn")))
        a = F.shiftright("run", 16)
        return later.select(RID, a.alias("a"), (a + F.col("run").bitwiseAND(F.lit(0xFFFF)) + (self.length - 1)).alias("z"))

    def spans(self) -> DataFrame:
        """RID and ``spans`` (places as a * 2**32 + z, in any order) of the documents that lose bytes."""
        every = self.copy_spans().union(self.tree_spans()).union(self.window_spans())
        return every.groupBy(RID).agg(F.collect_list(F.shiftleft("a", 32).bitwiseOR(F.col("z"))).alias("spans"))


def merge_spans(spans: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint runs, in order, of spans given as a * 2**32 + z."""
    if not len(spans):
        return []
    spans = np.sort(spans)
    a, z = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > z[:-1]
    first = np.flatnonzero(new)
    return list(zip(a[first].tolist(), z[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (runs as [start, end]) and kept (bytes) of each row.

    Removed is every byte under ``length`` bytes that also start earlier: in a smaller doc_id or before in the
    same document. Rows that share a doc_id come in order of text, null ids first. Null and empty texts, and
    those shorter than ``length``, lose nothing. An empty table gives an empty table; other columns are ignored.
    """
    have = keyed(docs.select("doc_id", "text"))
    job = Dedup(have, length, gram, bucket_cap)
    spans = job.scratch.write(job.spans(), "spans")
    job.scratch.drop("runs", "open")
    job.scratch.release()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = utf8(batch.column(1))
        raw, rows = buf.tobytes(), []
        for k, spans in enumerate(batch.column(2)):
            text = raw[int(off[k]) : int(off[k + 1])]
            runs = merge_spans(spans.values.to_numpy()) if spans.is_valid else []
            parts, at = [], 0
            for a, z in runs:
                parts.append(text[at:a])
                at = z
            kept = b"".join([*parts, text[at:]])
            rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), runs, kept))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = have.join(spans, RID, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(over_batches(work), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>, kept binary")
