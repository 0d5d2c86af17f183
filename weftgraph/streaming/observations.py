"""Observations as a stream: windows over event time, and the latest state of each entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Events of Parquet files that arrive in a folder; times without zone are UTC."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; what comes later than ``late`` is left out."""
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def latest_state(path: str, keys: list[str], at: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that keeps the latest row of each key in a table at ``path``, one version for each batch."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cols = [c for c in batch.columns if c not in keys]
        newest = lambda df: df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(at)).alias("v")).select(*keys, "v.*")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [int(n[1:]) for n in names if n[1:].isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        before = [v for v in whole if v < number]  # a batch that is run again starts from the version before it, not from its own
        if number and not before:
            raise FileNotFoundError(f"batch {number} needs the version before it in {path}, and there is none")
        rows = spark.read.parquet(f"{path}/v{max(before)}").unionByName(batch) if before else batch
        newest(rows).write.mode("overwrite").parquet(f"{path}/v{number}")

    return step
