"""robots.txt: parsing by lines, and the test whether a path may be fetched.

An empty line ends a group; a user-agent line of another agent does not. Carriage returns and white space
around a line are dropped, empty Disallow lines say nothing, sitemaps count in any group, and the first
crawl-delay that is a whole number counts; without one it is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELD = r"(?i)^([a-z-]+)\s*:\s*(.*)$"
#: The same for Java, whose ``.`` stops at more characters than a line feed, and whose ``\s`` has a vertical tab.
_FIELD = "(?s)" + FIELD.replace(r"\s", r"[ \t\n\f\r]")


def parse(robots: DataFrame, key: str = "authority", body: str = "body", agent: str | None = None) -> DataFrame:
    """(key, disallow sorted, sitemap in order, crawl_delay) for each key; lines are ranked within one key only.

    Files of one key are read as one, line by line. Where lines then stand in the same place, their text decides, and of delays
    the longest, so the result does not depend on the order of rows.
    """
    lines = robots.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(body), F.lit("")), "\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", r"[\r\t]", " "))
    so_far = Window.partitionBy(key).orderBy("pos", "line").rowsBetween(Window.unboundedPreceding, 0)
    in_group = Window.partitionBy(key, "part").orderBy("pos", "line").rowsBetween(Window.unboundedPreceding, 0)
    name, value = F.lower(F.regexp_extract("line", _FIELD, 1)), F.trim(F.regexp_extract("line", _FIELD, 2))
    ours = (F.col("value") == "*") | (F.lower("value") == (agent or "*").lower())
    lines = (
        lines.withColumn("line", line).withColumn("part", F.sum((F.col("line") == "").cast("int")).over(so_far))
        .withColumn("name", name).withColumn("value", value)
        .withColumn("relevant", F.max(((F.col("name") == "user-agent") & ours).cast("int")).over(in_group) == 1)
    )
    delay = F.when(F.col("relevant") & (F.col("name") == "crawl-delay") & F.col("value").rlike(r"^[+-]?[0-9]+\z"), F.expr("try_cast(value as int)"))
    pick = lambda test: F.when(test & (F.col("value") != ""), F.col("value"))
    return lines.groupBy(key).agg(
        F.array_sort(F.collect_list(pick(F.col("relevant") & (F.col("name") == "disallow")))).alias("disallow"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == "sitemap", F.struct("pos", "value")))), lambda s: s["value"]).alias("sitemap"),
        F.min_by(delay, F.when(delay.isNotNull(), F.struct("pos", -delay.cast("bigint")))).alias("crawl_delay"),
    )


def allowed(path: Column, disallow: Column) -> Column:
    """Whether no disallowed prefix begins the path."""
    return ~F.exists(F.coalesce(disallow, F.array().cast("array<string>")), lambda d: path.startswith(d))


def enqueue_robots(path_queries: Column) -> Column:
    return F.array_prepend(path_queries, F.lit("/robots.txt"))


def remove_robots(path_queries: Column) -> Column:
    return F.array_remove(path_queries, "/robots.txt")
