"""Helpers that the training-data operators share: scratch tables, row keys, Arrow batches, ranks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.session import delete, shared_folder

RID = "__wg_rid"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, mb: int = 4) -> None:
    """Arrow batches are cut by bytes too, so that very long texts don't meet in one batch."""
    try:
        spark.conf.set(ARROW_BYTES, str(mb << 20))
    except Exception:  # noqa: BLE001  a Spark without the setting cuts by rows alone
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors.

    The folder is one of ``spark.checkpoint.dir``'s own, deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, shared_folder(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.base}/{name}")

    def release(self) -> None:
        """Let the driver forget shuffles that no plan refers to, so that executors delete their files.

        Spark deletes a shuffle's files when its plan is collected on the driver, which a driver with a calm heap may
        not do for the whole of a job; a job of many large shuffles would hold all of them on disk at once.
        """
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with RID, a long that is unique for each row and ordered as the ids are.

    It is the id itself where ids are unique and not null. Otherwise null ids come first, rows that share an
    id are ordered by text, and equal rows in any order, each with a key of its own.
    """
    counts = docs.groupBy(F.col(id_col).cast("long").alias("k")).count()
    worst = counts.agg(F.max("count"), F.sum(F.col("k").isNull().cast("long")), F.min("k"), F.max("k")).first()
    most, nulls, low, high = worst
    plain = F.col(id_col).cast("long")
    if most is None or (most == 1 and not nulls):
        return docs.withColumn(RID, plain)
    low, high = (low or 0), (high or 0)
    bits = int(most).bit_length()
    first = F.coalesce(F.hex(F.substring(F.encode(F.col(text_col), "UTF-8"), 1, 2)), F.lit(""))
    own = ordered(docs, [plain], first, [F.col(text_col).asc_nulls_first()], "__wg_rank")
    if (high - low + 2) < 1 << (62 - bits):
        shifted = F.coalesce(plain - F.lit(low) + 1, F.lit(0).cast("long"))
        return own.withColumn(RID, F.shiftleft(shifted, bits) + F.col("__wg_rank")).drop("__wg_rank")
    # ids that span nearly all longs and repeat: the dense order of the distinct ids comes first
    ids = docs.select(plain.alias("k")).distinct()
    dense = ordered(ids, [], F.coalesce(F.shiftright("k", 48), F.lit(-(1 << 20))), [F.col("k").asc_nulls_first()], "__wg_o")
    dense = dense.withColumnRenamed("k", "__wg_k")
    joined = own.join(dense, F.col("__wg_k").eqNullSafe(plain))
    return joined.withColumn(RID, F.shiftleft(F.col("__wg_o") + 1, bits) + F.col("__wg_rank")).drop("__wg_k", "__wg_o", "__wg_rank")


def ordered(df: DataFrame, group: list[Column], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """df with a gapless rank from 0 in order within each group (null is a group too).

    Rows are dealt to buckets whose own order is that of the rows; a bucket is ranked alone and starts where those before
    it end, so that a group that most rows are in is ranked in many tasks. Starts are a row for each group and bucket.
    """
    g = [f"__wg_g{i}" for i in range(len(group))]
    dealt = df.select("*", *[c.alias(n) for c, n in zip(group, g, strict=True)], bucket.alias("__wg_b"))
    sizes = dealt.groupBy(*g, "__wg_b").agg(F.count(F.lit(1)).alias("__wg_n"))
    before = Window.partitionBy(*g).orderBy("__wg_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(n).alias(f"{n}s") for n in g], F.col("__wg_b").alias("__wg_bs"), F.coalesce(F.sum("__wg_n").over(before), F.lit(0)).alias("__wg_s"))
    ranked_ = dealt.withColumn("__wg_r", F.row_number().over(Window.partitionBy(*g, "__wg_b").orderBy(*order)) - 1)
    on = F.col("__wg_b") == F.col("__wg_bs")
    for n in g:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}s"))
    out = ranked_.join(starts, on).withColumn(name, (F.col("__wg_s") + F.col("__wg_r")).cast("long"))
    return out.drop(*g, *[f"{n}s" for n in g], "__wg_b", "__wg_bs", "__wg_s", "__wg_r")


def ranked(df: DataFrame, group: list[Column], order: list[Column], name: str, buckets: int, salt: Column) -> DataFrame:
    """df with a gapless rank from 0 within each group, without a group's rows ever meeting in one task.

    Rows of a group are dealt to buckets by ``salt``; each bucket is ranked alone and starts where those before
    it end. The table of starts has one row for each group and bucket.
    """
    g = [f"__wg_g{i}" for i in range(len(group))]
    dealt = df.select("*", *[c.alias(n) for c, n in zip(group, g, strict=True)], F.pmod(salt, F.lit(buckets)).cast("int").alias("__wg_b"))
    sizes = dealt.groupBy(*g, "__wg_b").agg(F.count(F.lit(1)).alias("__wg_n"))
    before = Window.partitionBy(*g).orderBy("__wg_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*g, "__wg_b", F.coalesce(F.sum("__wg_n").over(before), F.lit(0)).alias("__wg_s"))
    own = dealt.withColumn("__wg_r", F.row_number().over(Window.partitionBy(*g, "__wg_b").orderBy(*order)) - 1)
    out = own.join(starts, [*g, "__wg_b"])
    return out.withColumn(name, (F.col("__wg_s") + F.col("__wg_r")).cast("long")).drop(*g, "__wg_b", "__wg_s", "__wg_r")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes, one after the other, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    n = len(column)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def texts(column: pa.Array) -> Iterator[bytes]:
    """The rows of a text column as UTF-8 bytes; null is empty."""
    buf, off = utf8(column)
    raw = buf.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        yield raw[a:b]


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and idle ones shouldn't hold what they used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What workers keep from task to task for one operator, as functions that let go of it.
KEPT: list[Callable[[], None]] = []


def over_batches(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, batch by batch. A worker that turns to an operator that keeps nothing lets go of what others kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            for let_go in KEPT:
                let_go()
        for batch in batches:
            if (out := work(batch)) is not None:
                yield out
        give_back()

    return run
