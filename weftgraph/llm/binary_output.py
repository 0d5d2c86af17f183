"""Token ids in a binary format: fixed blocks of ids, cut into bit planes, each plane compressed with zstandard.

A segment is a row of the written table: whole documents in ascending order, their ids one after the other,
dealt to blocks of BLOCK ids. A block's ids are transposed into as many bit planes as its largest id needs
(the rest are zero); every plane is a zstandard frame of its own. The chunk index of a segment holds each
block's ids, planes and place in the payload; the document index holds each document's number of ids. Segments
are numbered by part and place, and parts follow the order of documents. The table is written through Spark, so
that only finished tasks' files count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import RID, Scratch, bound_batches, give_back, keyed, over_batches, texts
from weftgraph.llm.encoders import encoder

BLOCK, SEGMENT, END, LEVEL = 65_536, 1 << 20, 2, 1


def _turn(octets: np.ndarray) -> np.ndarray:
    """Transposes each group of 8 bytes as a matrix of 8 by 8 bits; its own inverse."""
    x = octets.view("<u8")
    for far, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(far))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(far))
    return x.view(np.uint8)


def planes_of(ids: np.ndarray) -> list[bytes]:
    """The bit planes of a block of ids, least significant first; bit i of a plane's byte j is of id 8 * j + i."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    padded = np.zeros(-(-len(ids) // 8) * 8, "<u4")
    padded[: len(ids)] = ids
    octets = padded.view(np.uint8).reshape(-1, 4)
    out: list[bytes] = []
    for k in range(-(-width // 8)):
        turned = _turn(np.ascontiguousarray(octets[:, k])).reshape(-1, 8)
        out += [np.ascontiguousarray(turned[:, i]).tobytes() for i in range(min(8, width - 8 * k))]
    return out


def ids_from(planes: list[bytes], n: int) -> np.ndarray:
    octets = np.zeros((-(-n // 8) * 8, 4), np.uint8)
    for k in range(0, len(planes), 8):
        turned = np.zeros((len(octets) // 8, 8), np.uint8)
        for i, p in enumerate(planes[k : k + 8]):
            turned[:, i] = np.frombuffer(p, np.uint8)
        octets[:, k // 8] = _turn(turned.reshape(-1))
    return octets.reshape(-1).view("<u4")[:n]


def encode_segment(ids: np.ndarray, block: int = BLOCK, level: int = LEVEL) -> tuple[bytes, list[int]]:
    """(payload, index): the index has, for each block, its ids, its planes and each plane's bytes in the payload."""
    press, payload, index = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), block):
        own = ids[at : at + block]
        frames = [press.compress(p) for p in planes_of(own)]
        index += [len(own), len(frames), *map(len, frames)]
        payload += frames
    return b"".join(payload), index


def decode_segment(payload: bytes, index: list[int]) -> np.ndarray:
    open_, out, at, place = zstandard.ZstdDecompressor(), [], 0, 0
    while at < len(index):
        n, planes = index[at], index[at + 1]
        own = []
        for size in index[at + 2 : at + 2 + planes]:
            own.append(open_.decompress(payload[place : place + size]))
            place += size
        out.append(ids_from(own, n))
        at += 2 + planes
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def segments(docs: DataFrame, path: str, parts: int, end: int = END, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """The segments of docs, which has RID, in order of RID over ``parts`` parts."""
    last = np.array([end], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        enc, held, size = encoder(path, True), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, place
            ids = np.frombuffer(b"".join(x[2] for x in held), "<u4")
            payload, index = encode_segment(ids, block)
            row = [[part], [place], [[x[0] for x in held]], [[x[1] for x in held]], [[len(x[2]) // 4 for x in held]], [len(ids)], [index], [payload]]
            held, size, place = [], 0, place + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, KINDS, strict=True)], names=NAMES)

        for batch in batches:
            for rid, doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                raw = enc.ids(t) + last
                held.append((rid, doc, raw))
                size += len(raw) // 4
                if size >= segment:
                    yield flush()
        if held:
            yield flush()
        give_back()

    bound_batches(docs.sparkSession)
    ordered = docs.select(RID, F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, RID).sortWithinPartitions(RID)
    return ordered.mapInArrow(work, SCHEMA)


KINDS = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()), pa.binary()]
NAMES = ["part", "segment", "rids", "doc_ids", "lengths", "n_ids", "chunk_index", "payload"]
SCHEMA = "part int, segment int, rids array<long>, doc_ids array<long>, lengths array<long>, n_ids long, chunk_index array<int>, payload binary"


def write(docs: DataFrame, out: str, path: str, parts: int, end: int = END) -> None:
    """Write docs' ids to the table ``out``. Null and empty texts are the end id alone; rows that share a doc_id
    are written one by one, in order of text, and null doc_ids first. Other columns of docs are ignored."""
    made = segments(keyed(docs.select("doc_id", "text")), path, parts, end)
    made.write.mode("overwrite").option("compression", "none").parquet(out)


def read(spark, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian bytes) of each document, from the files."""
    stored = spark.read.schema(SCHEMA).parquet(out)
    sizes = stored.select("part", "segment", "n_ids")
    whole = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each part
    base = whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = (F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("before")
    starts = sizes.select("part", "segment", within).join(base, "part").select("part", "segment", (F.col("base") + F.col("before")).alias("first"))
    names = ["part", "segment", "doc_id", "place", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, raws = [], []
        for part, segment, docs, sizes, index, payload in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            place, raw = 0, decode_segment(payload, index).astype("<u4").tobytes()
            for doc, size in zip(docs, sizes, strict=True):
                own = raw[4 * place : 4 * (place + size)]
                rows.append((part, segment, doc, place, size, zlib.crc32(own)))
                raws += [own] * with_ids
                place += size
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], *[pa.array(raws, pa.binary())] * with_ids], names=names)

    bound_batches(spark)
    schema = "part int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    opened = stored.select("part", "segment", "doc_ids", "lengths", "chunk_index", "payload").mapInArrow(over_batches(work), schema)
    return opened.join(starts, ["part", "segment"]).select("doc_id", (F.col("first") + F.col("place")).alias("start"), *names[4:])


def round_trip(docs: DataFrame, path: str, parts: int, end: int = END) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row of docs, from files written and read back.

    A null or empty text has the end id alone. Documents come in order of doc_id, null ids first, rows that share an id in
    order of text. An empty table gives an empty table; other columns of docs are ignored. A text is encoded whole,
    whatever its length.
    """
    scratch = Scratch(docs.sparkSession)
    write(docs, f"{scratch.base}/ids", path, parts, end)
    return read(docs.sparkSession, f"{scratch.base}/ids")
