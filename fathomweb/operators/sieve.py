"""The seen-set: each URL is let through once and once only, in order of first arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(urls: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """One row per key: the smallest ``order``. An aggregation with map-side combination, no window."""
    rest = [c for c in urls.columns if c not in (key, order)]
    picked = F.min_by(F.struct(*rest), order) if rest else None
    out = urls.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order), *([picked.alias("_rest")] if rest else []))
    return out.select(key, order, *(F.col(f"_rest.{c}").alias(c) for c in rest)).select(*urls.columns)


def unseen(urls: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key history doesn't have."""
    return urls.join(seen.select(key).distinct(), key, "left_anti").select(*urls.columns)


def flush(urls: DataFrame, seen: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """What a flush lets through: first arrivals that history doesn't have. History is consulted after the batch has been reduced."""
    return unseen(first_arrivals(urls, key, order), seen, key)


def with_history(emitted: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """History after a flush."""
    return seen.select(key).unionByName(emitted.select(key))


def consistent(seen: DataFrame, key: str = "url") -> DataFrame:
    """(n, n_distinct, consistent): history holds each key once."""
    out = seen.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_distinct"))
    return out.withColumn("consistent", F.col("n") == F.col("n_distinct"))


def two_flushes(keys: DataFrame) -> DataFrame:
    """Emission by flush number for rows (flush, seq, key): a key belongs to the flush and place of its first arrival."""
    first = keys.groupBy("key").agg(F.min(F.struct("flush", "seq")).alias("f"))
    return first.select(F.col("f.flush").alias("flush"), F.col("f.seq").alias("seq"), "key")
