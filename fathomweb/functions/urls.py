"""URL algebra as column expressions (RFC 3986); no UDF.

A URL is split by one pattern, once for each function, whatever the function does with the parts. Normal form: scheme and host in lower case, no user information, no
fragment, dot segments removed; port, query and trailing slash are kept, and nothing is re-encoded.
Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986, appendix B: scheme with ':', '//' and authority, path, '?' and query, '#' and fragment.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
USERINFO = r"^//[^@]*@"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def _parts(url: Column) -> Column:
    """All that the functions below need of a URL; null for null."""
    names = ("scheme", "authority", "path", "query", "fragment")
    return F.when(url.isNotNull(), F.struct(*(part(url, i).alias(n) for i, n in enumerate(names, 1))))


def _scheme(p: Column) -> Column:
    return F.lower(F.regexp_replace(p["scheme"], ":$", ""))


def _host_port(p: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(p["authority"], USERINFO, "//"), "^//", ""))


def _host(host_port: Column) -> Column:
    return F.regexp_replace(host_port, ":[0-9]*$", "")


def _origin(p: Column) -> Column:
    """scheme://host:port of parts; null without scheme or host."""
    known = F.struct(_scheme(p).alias("scheme"), _host_port(p).alias("host_port"))
    return let(known, lambda k: F.when((k["scheme"] != "") & (_host(k["host_port"]) != ""), F.concat(k["scheme"], F.lit("://"), k["host_port"])))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_replace(part(url, 1), ":$", ""))


def host_port(url: Column) -> Column:
    """Host and port, in lower case, without user information."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), USERINFO, "//"), "^//", ""))


def host(url: Column) -> Column:
    return _host(host_port(url))


def authority(url: Column) -> Column:
    """scheme://host:port, the key by which a crawl is partitioned; null without scheme or host."""
    return let(_parts(url), _origin)


def path_query(url: Column) -> Column:
    """Path and query, without the fragment."""
    return let(_parts(url), lambda p: F.concat(p["path"], p["query"]))


def host_labels(url: Column) -> Column:
    return F.split(host(url), r"\.")


def strip_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def valid(url: Column) -> Column:
    """Whether there are a scheme and a host."""
    return F.when(url.isNotNull(), authority(url).isNotNull())


def fetchable(url: Column) -> Column:
    return F.when(url.isNotNull(), F.coalesce(authority(url).rlike("^https?:"), F.lit(False)))


def remove_dots(path: Column) -> Column:
    """Dot segments removed (RFC 3986, 5.2.4), by one fold over the segments with a stack. Most paths have none."""

    def step(stack: Column, s: Column) -> Column:
        up = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(s == "..", up).when(s == ".", stack).otherwise(F.array_append(stack, s))

    def folded(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        last = F.element_at(segments, -1)
        return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/"))

    dotted = path.startswith("/") & path.contains("/.")
    return F.when(~dotted, path).otherwise(let(F.split(F.regexp_replace(path, "^/", ""), "/"), folded))


def normalize(url: Column) -> Column:
    """Normal form of an absolute URL; others only lose their fragment."""

    def whole(p: Column) -> Column:
        return let(_origin(p), lambda origin: F.when(origin.isNotNull(), F.concat(origin, remove_dots(p["path"]), p["query"])))

    return let(url, lambda u: F.coalesce(let(_parts(u), whole), F.regexp_replace(u, "#.*$", "")))


def resolve(base: Column, link: Column) -> Column:
    """The link as seen from the base (RFC 3986, 5.2.2), fragment kept."""

    def target(b: Column, r: Column) -> Column:
        folder = F.regexp_extract(b["path"], "^(.*/)", 1)
        merged = F.when((b["authority"] != "") & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(folder, r["path"]))
        own = r["scheme"] != ""
        elsewhere = own | (r["authority"] != "")
        stays = ~elsewhere & (r["path"] == "")
        path = F.when(elsewhere | r["path"].startswith("/"), r["path"]).otherwise(merged)
        return F.concat(
            F.when(own, r["scheme"]).otherwise(b["scheme"]),
            F.when(elsewhere, r["authority"]).otherwise(b["authority"]),
            F.when(stays, b["path"]).otherwise(let(path, remove_dots)),
            F.when(stays & (r["query"] == ""), b["query"]).otherwise(r["query"]),
            r["fragment"],
        )

    return let(_parts(base), lambda b: let(_parts(link), lambda r: target(b, r)))


def make_absolute(parent: Column, child: Column) -> Column:
    """The child with the parent's scheme and host forced upon it."""
    return let(_parts(parent), lambda p: let(_parts(child), lambda c: F.concat(_scheme(p), F.lit("://"), _host_port(p), c["path"], c["query"], c["fragment"])))


def robots_url(url: Column) -> Column:
    return F.concat(authority(url), F.lit("/robots.txt"))


def url_hash(url: Column) -> Column:
    """128 bits as hexadecimal digits. Keys are always compared as URLs; hashes only deal and report."""
    return F.md5(url.cast("binary"))
