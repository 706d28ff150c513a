"""Small column functions of the crawler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How failures are treated. Name, wait before the next DNS try (ms), most retries, ends the host.
EXCEPTIONS = (
    ("NoRouteToHost", 3_600_000, 5, True),
    ("Socket", 60_000, 5, True),
    ("SocketTimeout", 60_000, 5, False),
    ("UnknownHost", 3_600_000, 2, True),
    ("SSLPeerUnverified", 3_600_000, 0, True),
    ("CircularRedirect", 0, 0, False),
    ("Redirect", 0, 0, False),
    ("ConnectTimeout", 3_600_000, 2, True),
    ("ConnectionClosed", 60_000, 2, False),
    ("NoHttpResponse", 60_000, 2, False),
    ("HttpHostConnect", 3_600_000, 5, False),
    ("TruncatedChunk", 60_000, 1, False),
    ("MalformedChunkCoding", 60_000, 1, False),
)
DEFAULT_WAIT, DEFAULT_RETRIES = 3_600_000, 5
#: Units of a duration in ms.
UNITS = (("years", 31_536_000_000), ("days", 86_400_000), ("hours", 3_600_000), ("minutes", 60_000), ("seconds", 1000), ("milliseconds", 1))


def equals_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def multiple_of_8(x: Column) -> Column:
    """The largest multiple of 8 up to x."""
    return x.bitwiseAND(F.lit(-8))


def epoch_seconds(ms: Column) -> Column:
    return F.floor(ms / 1000)


def from_now(now: Column, ms: Column) -> Column:
    return now + ms


def ipv4_text(packed: Column) -> Column:
    """A 32-bit number as dotted text."""
    return F.concat_ws(".", *(F.shiftrightunsigned(packed, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def duration_text(ms: Column) -> Column:
    """'1 days 2 hours ...' with the units that are not 0; '0 milliseconds' for none."""
    out, rest = [], ms
    for name, size in UNITS:
        n = F.floor(rest / size)
        out.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"))))
        rest = rest % size
    joined = F.concat_ws(" ", *out)
    return F.when(joined == "", "0 milliseconds").otherwise(joined)


def exception_policy(spark: SparkSession) -> DataFrame:
    """(exception, wait, max_retries, host_killer): a table of fixed size."""
    return spark.createDataFrame(list(EXCEPTIONS), "exception string, wait bigint, max_retries int, host_killer boolean")


def cookie_size(cookie: Column) -> Column:
    return sum((F.length(F.coalesce(cookie[f], F.lit(""))) for f in ("value", "domain", "path")), F.length(F.coalesce(cookie["name"], F.lit(""))))


def workbench_size(bytes_: Column | int) -> Column:
    """How many path-queries a workbench of so many bytes holds."""
    return F.floor((F.lit(bytes_) if isinstance(bytes_, int) else bytes_) / 100)


def cache_entries(bytes_: Column | int) -> Column:
    return F.floor((F.lit(bytes_) if isinstance(bytes_, int) else bytes_) / 64)


def path_query_limit(entry_size: Column, authority_delay: Column, ip_delay: Column, workbench: Column, front: Column) -> Column:
    """How many path-queries a visit state may hold in memory."""
    scale = entry_size / F.greatest(F.lit(1.0), (authority_delay + 1) / (ip_delay + 1))
    share = F.ceil(workbench / (F.greatest(scale, F.lit(1e-9)) * front))
    by_space = F.greatest(F.lit(4.0), share.cast("double"))
    by_time = F.when(authority_delay > 0, F.lit(300_000.0) / authority_delay)
    return F.floor(F.least(F.coalesce(by_time, by_space), by_space))
