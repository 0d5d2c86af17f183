"""Files and tables: JSON documents with a reject table, cached copies, capped JSON sinks, tables swapped whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): path and raw text of every *.json below; rejects aren't JSON, aren't objects, or name a member twice."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    good = F.try_parse_json("raw").isNotNull() & F.ltrim("raw").startswith("{")
    return rows.where(good), rows.where(~good)


def fresh_or_stale(cached: DataFrame, fetched: DataFrame, key: str, as_of: Column, ttl_s: int) -> DataFrame:
    """One row for each key: the cached one while it is fresh, else the fetched one, else the stale one."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("fetched_at")
    c = cached.select(key, F.col("body").alias("__c"), (age < ttl_s).alias("__f"))
    both = c.join(fetched.select(key, F.col("body").alias("__n")), key, "full")
    body = F.when(F.coalesce("__f", F.lit(False)), F.col("__c")).otherwise(F.coalesce("__n", "__c"))
    how = F.when(F.coalesce("__f", F.lit(False)), "cached").when(F.col("__n").isNotNull(), "fetched").otherwise("stale")
    return both.select(key, body.alias("body"), how.alias("outcome"))


def corpus_identity(docs: DataFrame, body: str) -> DataFrame:
    """A hash of all documents that doesn't depend on their order: equal corpora can reuse what was made of them.

    Documents are hashed one by one; sums of the hashes' two halves are partial aggregates, so that no list grows.
    """
    h = F.sha2(F.col(body), 256)
    half = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = docs.agg(F.count(F.lit(1)).alias("n"), half(1).alias("a"), half(16).alias("b"), half(31).alias("c"))
    return sums.select("n", F.sha2(F.concat_ws("|", "n", "a", "b", "c"), 256).alias("identity"))


def capped_json(row: Column, raw_fields: Column, most: int) -> Column:
    """JSON of a struct; over ``most`` bytes that of the struct without raw fields; a stub if that is too long."""
    full, less = F.to_json(row), F.to_json(raw_fields)
    stub = F.to_json(F.struct(F.lit("response too large").alias("error"), F.octet_length(full).alias("size_bytes")))
    return F.when(F.octet_length(full) <= most, full).when(F.octet_length(less) <= most, less).otherwise(stub)


def swap_table(df: DataFrame, path: str) -> None:
    """Write beside ``path``, then put it in its place; what was there goes once the new table is whole."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.staged")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(fs_path(f"{path}.old"), True)
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(f"{path}.old"))
    fs.rename(fs_path(f"{path}.staged"), fs_path(path))
    fs.delete(fs_path(f"{path}.old"), True)


def paged(pages: DataFrame, key: str = "items") -> DataFrame:
    """(page, index, item) of page responses (page, body as JSON text)."""
    items = F.from_json(F.get_json_object("body", f"$.{key}"), "array<string>")
    return pages.select("page", F.posexplode(items).alias("index", "item"))
