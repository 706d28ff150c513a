"""Seeds, bookmarks and synthetic URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweb.functions import urls


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url): one per line, blank lines dropped, in normal form."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''")
    return lines.select(urls.normalize(F.col("url")).alias("url"))


def write_seeds(df: DataFrame, path: str, url: str = "url") -> None:
    df.select(F.col(url).cast("string").alias("value")).write.text(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema."""
    return spark.read.schema(schema).json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def bookmark_uris(json: Column) -> Column:
    """All http(s) values of "uri" in a JSON text, at any depth, distinct and sorted."""
    found = F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(r'"uri"\s*:\s*"(http[^"]*)"'), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def synthetic_urls(spark: SparkSession, n: int, authorities: int = 100, seed: int = 0) -> DataFrame:
    """(seq, url): the same for the same arguments, however the rows are dealt."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    host = F.conv(F.substring(h, 1, 7), 16, 10).cast("bigint") % authorities
    url = F.concat(F.lit("http://host"), host.cast("string"), F.lit(".test/"), F.substring(h, 9, 4), F.lit("/"), F.substring(h, 13, 6))
    return spark.range(n).select(F.col("id").alias("seq"), url.alias("url"))
