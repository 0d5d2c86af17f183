"""Chat formatting after a cumulative-snapshot collapse.

A service that logs a conversation after every turn leaves snapshots that are prefixes of later ones. Every
turn gets a rolling hash of all turns so far; a conversation whose last hash is also a hash within a longer one
is a prefix of it. Hashes are reduced to distinct ones before the anti-join, so that common first turns weigh
nothing, and of equal conversations the smallest id stays.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Scratch, bound_batches, over_batches

TEMPLATE = "<|{role}|>\n{text}<|end|>\n"


def turn_hashes(turns: list[tuple[str | None, str | None]]) -> list[bytes]:
    """The rolling hash after each turn; null and empty roles or texts are told apart."""
    out, last = [], b""
    for turn in turns:
        h = hashlib.blake2b(last, digest_size=16)
        for part in turn:
            raw = b"" if part is None else part.encode()
            h.update((-1 if part is None else len(raw)).to_bytes(8, "big", signed=True) + raw)
        last = h.digest()
        out.append(last)
    return out


def render(turns: list[tuple[str | None, str | None]], template: str = TEMPLATE) -> str:
    return "".join(template.format(role=r or "unknown", text=t or "") for r, t in turns)


def assemble(rows: DataFrame) -> DataFrame:
    """conv_id and ``turns``, in order of turn, role and text. Turns with a null conv_id are no conversation;
    null turn numbers come first; equal rows count as often as they are there. One row holds one conversation,
    as its rendering does."""
    kept = rows.where(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", "role", "text").alias("t"))
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _pairs(turns: list[dict]) -> list[tuple[str | None, str | None]]:
    return [(t["role"], t["text"]) for t in turns]


def rolled(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, ``last`` (the hash of all turns) and ``inner`` (those of its proper prefixes): 16 bytes a turn, no texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [turn_hashes(_pairs(turns)) for turns in batch.column(1).to_pylist()]
        n, last, inner = [len(h) for h in each], [h[-1] for h in each], [h[:-1] for h in each]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(last, pa.binary()), pa.array(inner, pa.list_(pa.binary()))], names=["conv_id", "n_turns", "last", "inner"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return assemble(rows).mapInArrow(over_batches(work), f"conv_id {kind}, n_turns long, last binary, inner array<binary>")


def rendered(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id and ``rendered`` of every conversation of rows."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        shown = [render(_pairs(turns), template) for turns in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string())], names=["conv_id", "rendered"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return assemble(rows).mapInArrow(over_batches(work), f"conv_id {kind}, rendered string")


def maximal(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered text of the conversations that no other extends.

    n_copies counts equal conversations (itself included). Hashes alone decide which stay; only those that stay are
    read again and rendered, so that a log with a snapshot for each turn isn't written out once for each of them.
    An empty table gives an empty table; other columns of rows are ignored.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    made = scratch.write(rolled(rows), "rolled")
    ends = made.groupBy("last").agg(F.min("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("n_copies"))
    inner = made.select(F.explode("inner").alias("last")).distinct()
    chosen = scratch.write(ends.join(inner, "last", "left_anti").select("conv_id", "n_turns", "n_copies"), "chosen")
    kept = rendered(rows.join(chosen.select("conv_id"), "conv_id", "left_semi"), template)
    return chosen.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
