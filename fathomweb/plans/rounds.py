"""A crawl as rounds over tables: each round is a function of the tables, and is written before the next begins."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweb.config import CrawlConfig

#: Rounds whose tables are read one by one before they are written as one.
WIDTH = 16

#: Bytes of URLs, each with ``ROW`` more, that a join may send to the driver and on to all executors. Left alone, Spark decides
#: by the size of files, and URLs are many times larger in memory.
SENT, ROW = 32 << 20, 110


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; without one, only a session in one process gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fathomweb-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/fathomweb-{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sized(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` (url), and about what they take in memory."""
    rows, chars = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("url")), F.lit(0))).first()
    return rows, chars + ROW * rows


def _side(df: DataFrame, size: int) -> DataFrame:
    """``df`` as a side of a join: sent to all executors while it is small, and never beyond."""
    return F.broadcast(df) if size <= SENT else df.hint("merge")


def _unseen(found: DataFrame, seen: DataFrame, size: int) -> DataFrame:
    """``found`` less ``seen`` (each url once), which takes ``size`` bytes. A large ``seen`` is shuffled only if ``found`` is large, too."""
    if size > SENT:
        found = _written(found, "found")
        size = _sized(found)[1]
        if size <= SENT:
            seen = seen.join(F.broadcast(found), "url", "left_semi")
    return found.join(_side(seen, size), "url", "left_anti")


def reached(crawled: int | Column, max_urls: int | None) -> bool | Column:
    """Whether a crawl has got beyond its limit; without one, never. Rows for a column, a truth value for a number."""
    if max_urls is None:
        return F.lit(False) if isinstance(crawled, Column) else False
    return crawled > max_urls


def crawl(edges: DataFrame, seeds: DataFrame, config: CrawlConfig | Callable[[], CrawlConfig]) -> DataFrame:
    """(url, round): what a crawl from ``seeds`` (url) over the link graph ``edges`` (src, dst) visits, and when.

    A round visits what the last one found, less what has been visited. It stops when nothing is new, when more than
    ``max_urls`` have been visited, or when the settings, which are asked for again before each round, say so.
    """
    settings = config if callable(config) else lambda: config
    # written once, dealt by source: a round reads it, and joins a front that is broadcast while it is small
    edges = _written(edges.select("src", "dst").where("src is not null and dst is not null").distinct().repartition("src"), "edges")
    front = _written(seeds.select("url").distinct().withColumn("round", F.lit(0)), "front")
    seen, (n, size) = front, _sized(front)
    own = size
    for k in count(1):
        now = settings()
        if now.runtime_stop or reached(n, now.max_urls):
            break
        found = edges.join(_side(front.select(F.col("url").alias("src")), own), "src").select(F.col("dst").alias("url")).distinct()
        front = _written(_unseen(found, seen.select("url"), size).withColumn("round", F.lit(k)), "front")
        fresh, own = _sized(front)
        if not fresh:
            break
        n, size = n + fresh, size + own
        seen = seen.unionByName(front)
        if k % WIDTH == 0:
            seen = _written(seen, "seen")
    return seen


@dataclass
class Crawl:
    """A crawl session: settings and tables; ``stop``, from any thread, ends it before its next round."""

    spark: SparkSession
    config: CrawlConfig

    def stop(self) -> None:
        self.config = replace(self.config, runtime_stop=True)

    def run(self, edges: DataFrame, seeds: DataFrame) -> DataFrame:
        return crawl(edges, seeds, lambda: self.config)
