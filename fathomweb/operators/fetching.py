"""DNS and fetch outcomes as state machines: one CASE over a joined policy of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomweb.functions import scalars, urls


#: Four decimal numbers, each up to 255.
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def resolved(states: DataFrame, host_ip: DataFrame) -> DataFrame:
    """(authority, host, ip): from the table, else localhost, else a literal address; ip is null where none of them has it."""
    keyed = states.select("authority", urls.host(F.col("authority")).alias("host"))
    literal = F.when(F.col("host") == "localhost", "127.0.0.1").when(F.col("host").rlike(IPV4), F.col("host"))
    return keyed.join(host_ip.select("host", "ip"), "host", "left").select("authority", "host", F.coalesce("ip", literal).alias("ip"))


def fetch_round(picked: DataFrame, states: DataFrame, pages: DataFrame, now: int, authority_delay: int, ip_delay: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of fetching: the first path-query of each picked authority.

    ``picked`` (ip, authority), ``states`` (authority, path_queries). Returns responses (url, status, body), the states
    left with their next fetch, and the next fetch (ip, at) of the addresses used.
    """
    first = picked.join(states, "authority").where(F.size("path_queries") > 0)
    responses = offline_fetch(first.select(F.concat("authority", F.element_at("path_queries", 1)).alias("url")), pages.withColumn("url", urls.normalize(F.col("url"))))
    left = first.select("authority", "ip", F.lit(now + authority_delay).cast("bigint").alias("next_fetch"), F.slice("path_queries", F.lit(2), F.size("path_queries")).alias("path_queries"))
    return responses, left, first.select("ip", F.lit(now + ip_delay).cast("bigint").alias("at")).distinct()


def dns_step(attempts: DataFrame, now: int, base_wait: int = scalars.DEFAULT_WAIT, most: int = 2) -> DataFrame:
    """(authority, ip, retries, outcome, available_at) of attempts (authority, ip, retries): added, or again after 1 h << retries, or dropped."""
    again = F.col("retries") < most
    return attempts.select(
        "authority", "ip",
        F.when(F.col("ip").isNull() & again, F.col("retries") + 1).otherwise(F.col("retries")).alias("retries"),
        F.when(F.col("ip").isNotNull(), "add").when(again, "delay").otherwise("drop").alias("outcome"),
        F.when(F.col("ip").isNull() & again, now + F.lit(base_wait).cast("bigint") * F.pow(F.lit(2), F.col("retries")).cast("bigint")).alias("available_at"),
    )


def fetch_step(results: DataFrame, policy: DataFrame, now: int, authority_delay: int) -> DataFrame:
    """(id, outcome, retries, last_exception, keep_path, next_fetch) of results (id, exception, io, last_exception, retries).

    No exception: success. An I/O exception sets the counter first (new: 0, the same again: + 1, another:
    unchanged), then is tried again, ends the host or drops the path. Any other exception drops the path.
    """
    joined = results.join(F.broadcast(policy), "exception", "left")  # the policy is a table of fixed size
    counter = F.when(F.col("last_exception").isNull(), 0).when(F.col("last_exception") == F.col("exception"), F.col("retries") + 1).otherwise(F.col("retries"))
    joined = joined.withColumn("counter", counter).withColumn("most", F.coalesce("max_retries", F.lit(scalars.DEFAULT_RETRIES)))
    none = F.col("exception").isNull()
    outcome = F.when(none, "success").when(~F.col("io"), "skip").when(F.col("counter") < F.col("most"), "retry").when(F.coalesce("host_killer", F.lit(False)), "purge").otherwise("skip")
    out = joined.withColumn("outcome", outcome)
    tried = F.col("outcome").isin("retry", "purge")
    return out.select(
        "id", "outcome",
        F.when(none, 0).when(~F.col("io"), F.col("retries")).otherwise(F.col("counter")).cast("int").alias("retries"),
        F.when(tried, F.col("exception")).when(none | F.col("io"), F.lit(None)).otherwise(F.col("last_exception")).alias("last_exception"),
        (F.col("outcome").isin("retry", "purge")).alias("keep_path"),
        F.when(F.col("outcome") != "purge", F.lit(now + authority_delay).cast("bigint")).alias("next_fetch"),
    )


def fresh_ips(host_ip: DataFrame, now: int, ttl: int) -> DataFrame:
    """Addresses that were used within the time to live."""
    return host_ip.where(F.col("ts") >= now - ttl)


def used_ips(host_ip: DataFrame, hosts: DataFrame, now: int) -> DataFrame:
    """``host_ip`` with the time of use of ``hosts`` (host) set to now."""
    used = hosts.select("host").distinct().withColumn("used", F.lit(True))
    return host_ip.join(used, "host", "left").select("host", "ip", F.when(F.col("used"), F.lit(now)).otherwise(F.col("ts")).cast("bigint").alias("ts"))


def offline_fetch(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, status, body): requests (url) answered from stored pages; 404 where there is none."""
    found = pages.select("url", F.col("html").alias("body"))
    return requests.join(found, "url", "left").select("url", F.when(F.col("body").isNull(), 404).otherwise(200).alias("status"), "body")
