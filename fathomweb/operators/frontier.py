"""From extracted links to visit states: quotas, routing, per-authority queues.

Authorities may be skewed. Counting combines map-side; queues are ranked by windows, which Spark sorts
and spills, and are collected into one row only up to a limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomweb.functions import html, urls


def page_links(pages: DataFrame, engine: str = "regex") -> DataFrame:
    """(page_id, pos, url, base): links of each page, resolved against its URL and normalised; only http and https."""
    found = pages.select("page_id", F.col("url").alias("base"), F.posexplode(html.extract(engine, "links", F.col("html"))).alias("pos", "link"))
    url = urls.normalize(urls.resolve(F.col("base"), F.trim("link")))
    return found.select("page_id", "pos", url.alias("url"), "base").where(urls.fetchable(F.col("url")))


def new_links(pages: DataFrame, engine: str = "regex") -> DataFrame:
    """(page_id, pos, url): each page's distinct links, at their first place."""
    return page_links(pages, engine).groupBy("page_id", "url").agg(F.min("pos").alias("pos"))


def authority_counts(responses: DataFrame) -> DataFrame:
    """(authority, n): stored responses of each authority."""
    return responses.select(urls.authority(F.col("url")).alias("authority")).groupBy("authority").agg(F.count("*").alias("n"))


def within_quota(ready: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Rows (url, ...) whose authority has fewer than ``most`` stored responses."""
    keyed = ready.withColumn("authority", urls.authority(F.col("url")))
    return keyed.join(counts, "authority", "left").where(F.coalesce("n", F.lit(0)) < most).select(*ready.columns)


def looked_up(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """(authority, n) with 0 for authorities that have no count."""
    return keys.join(counts, "authority", "left").select("authority", F.coalesce("n", F.lit(0)).alias("n"))


def routed(ready: DataFrame, counts: DataFrame, registered: DataFrame, most: int) -> DataFrame:
    """(url, seq, authority, route): drop if over quota, spool if the authority is registered, else new."""
    keyed = ready.withColumn("authority", urls.authority(F.col("url")))
    known = registered.select("authority").distinct().withColumn("known", F.lit(True))
    route = F.when(F.coalesce("n", F.lit(0)) >= most, "drop").when(F.col("known"), "spool").otherwise("new")
    return keyed.join(counts, "authority", "left").join(known, "authority", "left").select("url", "seq", "authority", route.alias("route"))


def visit_states(ready: DataFrame, most: int = 1000) -> DataFrame:
    """(authority, n_paths, path_queries): each authority's first ``most`` path-queries in order; the rest stays in the spool."""
    order = Window.partitionBy("authority").orderBy("seq", "path_query")
    keyed = ready.select(urls.authority(F.col("url")).alias("authority"), urls.path_query(F.col("url")).alias("path_query"), "seq")
    kept = keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path_query"))), lambda s: s["path_query"])
    return kept.groupBy("authority").agg(F.count("*").alias("n_paths"), listed.alias("path_queries"))


def split_by_membership(keys: DataFrame, members: DataFrame) -> DataFrame:
    """(authority, registered)."""
    known = members.select("authority").distinct().withColumn("registered", F.lit(True))
    return keys.join(known, "authority", "left").select("authority", F.coalesce("registered", F.lit(False)).alias("registered"))


def new_urls(pages: DataFrame, seen: DataFrame, most: int, engine: str = "regex") -> DataFrame:
    """(url, page_id, pos, authority, place): links of all pages that quota and history allow, at their first arrival, ranked in their authority's queue.

    ``seen`` (url) is history; the quota counts the pages of each authority.
    """
    from .sieve import first_arrivals, unseen

    found = new_links(pages, engine).select("url", F.struct("page_id", "pos").alias("seq"))
    emitted = unseen(first_arrivals(within_quota(found, authority_counts(pages), most)), seen)
    keyed = emitted.select("url", "seq.page_id", "seq.pos", urls.authority(F.col("url")).alias("authority"))
    order = Window.partitionBy("authority").orderBy("page_id", "pos")
    return keyed.withColumn("place", F.row_number().over(order))


def spool_dequeue(spool: DataFrame, limit: int, key: str = "authority", order: str = "seq") -> DataFrame:
    """The first ``limit`` rows of each key's queue, with their place."""
    w = Window.partitionBy(key).orderBy(order)
    return spool.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def spool_sizes(spool: DataFrame, key: str = "authority") -> DataFrame:
    """(key, n)."""
    return spool.groupBy(key).agg(F.count("*").alias("n"))


def spool_remove(spool: DataFrame, gone: DataFrame, key: str = "authority") -> DataFrame:
    return spool.join(gone.select(key).distinct(), key, "left_anti")


def limited_cookies(cookies: DataFrame, most: int) -> DataFrame:
    """Rows (owner, pos, name, value, domain, path) of each owner's longest prefix whose running size stays below ``most``."""
    size = sum((F.length(F.coalesce(c, F.lit(""))) for c in ("value", "domain", "path")), F.length(F.coalesce("name", F.lit(""))))
    w = Window.partitionBy("owner").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return cookies.withColumn("total", F.sum(size).over(w)).where(F.col("total") < most)


def membership(added: DataFrame, removed: DataFrame, key: str = "authority") -> DataFrame:
    """A set of keys: those added, less those removed."""
    return added.select(key).distinct().join(removed.select(key).distinct(), key, "left_anti")


def total(counts: DataFrame) -> DataFrame:
    """(crawled): stored responses of all authorities, from their counts (authority, n)."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("crawled"))
