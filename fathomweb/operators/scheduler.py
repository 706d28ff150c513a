"""The workbench: which authority is visited next, with one visit per IP address at a time.

Tables: visit states (authority, ip, next_fetch, path_queries) and entries (ip, next_fetch, busy). Time is an
argument. Each step is a function of the tables, so a step can be checked, repeated and recovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heads(states: DataFrame, entries: DataFrame) -> DataFrame:
    """(ip, authority, ready_at) of each idle entry: the visit state that may go first, ties by authority, and when both may be visited."""
    first = states.groupBy("ip").agg(F.min(F.struct("next_fetch", "authority")).alias("head"))
    idle = entries.where(~F.col("busy")).select("ip", F.col("next_fetch").alias("entry_next"))
    return first.join(idle, "ip").select("ip", "head.authority", F.greatest("head.next_fetch", "entry_next").alias("ready_at"))


def ready(states: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """(ip, authority, ready_at): everything that one scheduling step may start, one per ip, in no order."""
    return heads(states, entries).where(F.col("ready_at") <= now).select("ip", "authority", "ready_at")


def peek(states: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """The earliest of ``ready``, at most one row."""
    return ready(states, entries, now).orderBy("ready_at", "authority").limit(1)


def popped(entries: DataFrame, picked: DataFrame) -> DataFrame:
    """Entries after ``picked`` (ip) has been taken: these ips are busy."""
    taken = picked.select("ip").distinct().withColumn("taken", F.lit(True))
    return entries.join(taken, "ip", "left").select("ip", "next_fetch", (F.col("busy") | F.coalesce("taken", F.lit(False))).alias("busy"))


def added(states: DataFrame, entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States and entries after ``new`` (as states, with ``locked``): a locked state frees its ip, others leave the flag as it is; unknown ips get an entry."""
    kept = states.join(new.select("authority"), "authority", "left_anti")
    states = kept.unionByName(new.select(*states.columns))
    touched = new.groupBy("ip").agg(F.max("locked").alias("locked"))
    both = entries.join(touched, "ip", "full_outer")
    busy = F.coalesce("busy", F.lit(False)) & ~F.coalesce("locked", F.lit(False))
    return states, both.select("ip", F.coalesce("next_fetch", F.lit(0)).alias("next_fetch"), busy.alias("busy"))


def purged(states: DataFrame, entries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the authorities of ``gone`` (authority, ip): their ips are free, and entries that nobody is left at go."""
    left = states.join(gone.select("authority"), "authority", "left_anti")
    freed = gone.select("ip").distinct().withColumn("freed", F.lit(True))
    some = left.select("ip").distinct().withColumn("some", F.lit(True))
    both = entries.join(freed, "ip", "left").join(some, "ip", "left").where(F.coalesce("some", F.lit(False)) | ~F.coalesce("freed", F.lit(False)))
    return left, both.select("ip", "next_fetch", (F.col("busy") & ~F.coalesce("freed", F.lit(False))).alias("busy"))


def delayed_entries(entries: DataFrame, times: DataFrame) -> DataFrame:
    """Entries with the next fetch of ``times`` (ip, at) where it has one."""
    return entries.join(times, "ip", "left").select("ip", F.coalesce("at", "next_fetch").alias("next_fetch"), "busy")


def done_route(paths: Column, spooled: Column, purge: Column) -> Column:
    """What becomes of a visited state: purge, add again, refill from the spool."""
    return F.when(purge, "purge").when(paths > 0, "add").when(spooled > 0, "refill").otherwise("purge")


def distributor_step(front: Column, required: Column, ready_urls: Column, now: Column, last_flush: Column) -> Column:
    """What the distributor does with its next turn."""
    small = front < required
    return F.when(~small, "wait").when((ready_urls == 0) & (now - last_flush >= 1000), "flush").when(ready_urls > 0, "enlarge").otherwise("wait")


def refill(spool: DataFrame, limits: DataFrame) -> DataFrame:
    """(authority, seq, path_query): from each authority's spool as many as its limit (authority, most) allows. Spools without a limit are dropped before anything is ranked."""
    w = Window.partitionBy("authority").orderBy("seq")
    ranked = spool.join(limits, "authority").withColumn("place", F.row_number().over(w))
    return ranked.where(F.col("place") <= F.col("most")).select("authority", "seq", "path_query")


def due(queue: DataFrame, now: int, at: str = "available_at") -> DataFrame:
    """Items of a delay queue whose time has come."""
    return queue.where(F.col(at) <= now)


def enqueued(paths: Column, path: Column) -> Column:
    """A visit state's path-queries with one more at the end."""
    return F.array_append(paths, path)


def first_path(paths: Column) -> Column:
    """The path-query that is next; null if there is none."""
    return F.get(paths, F.lit(0))


def dequeued(paths: Column) -> Column:
    """The path-queries without the next one."""
    return F.slice(paths, F.lit(2), F.greatest(F.size(paths), F.lit(1)))


def is_time(next_fetch: Column, now: int) -> Column:
    """Whether a visit state may be fetched by its own delay."""
    return next_fetch <= now


def fullness(states: DataFrame, most: int) -> DataFrame:
    """(path_queries, is_full): how many path-queries (column ``paths``) all states hold, and whether that is above the workbench's size."""
    return states.agg(F.coalesce(F.sum("paths"), F.lit(0)).alias("path_queries")).withColumn("is_full", F.col("path_queries") > most)


def required_front(entries: DataFrame, required: int, step: int = 100) -> DataFrame:
    """(idle, required): each idle fetcher raises the required front by ``step``."""
    return entries.agg(F.count_if(~F.col("busy")).alias("idle")).withColumn("required", required + step * F.col("idle"))


def gauges(entries: DataFrame, spool: DataFrame, key: str = "authority") -> DataFrame:
    """(ips, busy, queued, authorities): one row of sizes of the workbench and the spool."""
    queued = spool.agg(F.count("*").alias("queued"), F.count_distinct(key).alias("authorities"))
    both = entries.agg(F.count("*").alias("ips"), F.count_if("busy").alias("busy")).unionByName(queued, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in ("ips", "busy", "queued", "authorities")))


def ready_batch(ready: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows by ``order``: each task keeps that many, and they are merged."""
    return ready.orderBy(order).limit(most)


def in_range(items: DataFrame, below: int | None = None, at_least: int | None = None, key: str = "prio") -> DataFrame:
    """The items of a priority queue whose priority is below one bound and at least another. Order them by ``key`` to take them in turn."""
    return items.where((F.col(key) < below if below is not None else F.lit(True)) & (F.col(key) >= at_least if at_least is not None else F.lit(True)))
