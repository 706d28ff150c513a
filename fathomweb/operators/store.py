"""Stored responses and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweb import schemas


def write_responses(responses: DataFrame, path: str, is_new: bool) -> None:
    """A new store must not exist; an old one must. Tasks write in parallel; the commit protocol makes a write whole or void."""
    spark = responses.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    if not is_new and not exists:
        raise FileNotFoundError(path)
    responses.write.mode("errorifexists" if is_new else "append").parquet(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STORED).parquet(path)


def with_digests(responses: DataFrame) -> DataFrame:
    """Adds digest, is_duplicate (the same body has a smaller url) and charset."""
    keyed = responses.withColumn("digest", F.sha2(F.coalesce("body", F.lit("")), 256))
    first = keyed.groupBy("digest").agg(F.min("url").alias("first_url"))
    charset = F.lower(F.regexp_extract(F.coalesce("body", F.lit("")), r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1))
    return keyed.join(first, "digest").select(*responses.columns, "digest", (F.col("url") != F.col("first_url")).alias("is_duplicate"), charset.alias("charset"))


def summed(events: DataFrame) -> DataFrame:
    """(name, total) of counters (name, value)."""
    return events.groupBy("name").agg(F.sum("value").alias("total"))


def latest(events: DataFrame) -> DataFrame:
    """(name, value): each gauge's last value by (ts, value)."""
    return events.groupBy("name").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def throughput(responses: DataFrame, seconds: float) -> DataFrame:
    """(urls, bytes, bytes_per_second)."""
    out = responses.agg(F.count("*").alias("urls"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes"))
    return out.withColumn("bytes_per_second", F.col("bytes") / F.lit(float(seconds)))
