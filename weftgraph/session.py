"""Sessions with the settings that the engine relies on."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: UTC, ANSI and adaptive execution; sizes of partitions and joins are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("weftgraph")
    if master:
        builder = builder.master(master)
    return builder.config(map={**SETTINGS, **conf}).getOrCreate()


_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, deleted when the driver ends.

    Without the setting a temporary folder stands in on a local master, as in tests; on a cluster that is an error, since
    executors would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weftgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(clear_folders)
    _MADE.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_folders() -> None:
    """Delete what this driver has written under shared folders; results that were not yet read are lost."""
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):  # the JVM may have ended first; local files are still there then
            delete(spark, path)
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
