import json

import duckdb
import pytest

from fathomweb import queries
from fathomweb.config import CrawlConfig, read_config
from fathomweb.functions import html, robots, scalars, urls
from pyspark.sql import functions as F


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_normal_form(spark):
    cases = {
        "http://user:pw@Example.COM:8080/a/../b/./c?q=1#f": "http://example.com:8080/b/c?q=1", "HTTPS://A.test": "https://a.test", "http://h.test/../../up/": "http://h.test/up/",
        "http://h.test/a/b/..": "http://h.test/a/", "http://h.test/a?x=/../y": "http://h.test/a?x=/../y", "http://x_y.test/a b": "http://x_y.test/a b", "http://é.test/": "http://é.test/",
    }
    assert values(spark, urls.normalize, list(cases)) == list(cases.values())
    assert values(spark, urls.normalize, [None]) == [None]


def test_resolution_as_in_the_rfc(spark):
    """RFC 3986, 5.4.1 and 5.4.2."""
    want = {
        "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
        "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
        "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g",
        "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y",
    }
    assert values(spark, lambda c: urls.resolve(F.lit("http://a/b/c/d;p?q"), c), list(want)) == list(want.values())


def test_valid(spark):
    assert values(spark, urls.valid, ["http://a", "mailto:a@b", "/x", "http://", "//h/x"]) == [True, False, False, False, False]
    assert values(spark, urls.fetchable, ["ftp://a", "https://a"]) == [False, True]


DIRTY = "<!-- <a href=no> --><a href=one rel='x nofollow'>1</a><A class=b\nHREF='two &amp; 3'>t<a href>empty<script>'<a href=\"bad\">'</script><title>A &lt; B</title><p lang=fr>hi<b>there</p>"


def test_parser_engine(spark):
    assert values(spark, lambda c: html.extract("parser", "links", c), [DIRTY, None, ""]) == [["two & 3"], [], []]
    assert values(spark, lambda c: html.extract("parser", "title", c), [DIRTY, "x"]) == ["A < B", None]
    assert values(spark, lambda c: html.extract("parser", "lang_attributes", c), [DIRTY]) == [["fr"]]
    assert values(spark, lambda c: html.extract("parser", "text", c), ["<p>a<style>b</style> c&nbsp;d"]) == ["a c d"]
    with pytest.raises(ValueError):
        html.extract("none", "links", F.lit(""))


def test_math_needs_mathjax_on_demand(spark):
    page = "a $x$ b"
    assert values(spark, lambda c: html.math(c, True), [page, page + "<script src=mathjax.js></script>"]) == [[], ["$x$"]]
    assert values(spark, html.math, [page]) == [["$x$"]]


def test_robots_as_sql_where_it_is_determined(spark):
    """The first crawl-delay that is a whole number counts; any character but a line feed may stand in a value."""
    files = {
        "a": "User-agent: *\nCrawl-delay: x\nCrawl-delay: 5\nCrawl-delay: 7", "b": "User-agent: *\nCrawl-delay: 99999999999\nCrawl-delay: 3", "c": "User-agent: *\nCrawl-delay:\nCrawl-delay: +6", "d": "User-agent: *\nCrawl-delay: 2.5",
        "e": "User-agent: *\nDisallow: /a\u2028b\nDisallow: /c\x85\nDisallow: \x0b/d", "f": "User-agent: *\nCrawl-delay: 5\x01",
    }
    con = duckdb.connect()
    con.execute("create table pages (url varchar, page_id bigint)")
    con.execute("create table robots (authority varchar, body varchar)")
    con.executemany("insert into robots values (?, ?)", list(files.items()))
    sql = queries.ORACLE_SQL["robots_parse"].replace(queries.rows_of("robots"), "robots")
    want = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    df = robots.parse(spark.createDataFrame(list(files.items()), "authority string, body string"))
    assert {r.authority: (",".join(r.disallow), ",".join(r.sitemap), r.crawl_delay) for r in df.collect()} == want
    assert [want[k][2] for k in "abcdef"] == [5, 3, 6, None, None, None]


def test_robots_of_one_authority_twice(spark):
    """Neither the order of rows nor their partitions decide, where places tie."""
    files = [("a", f"User-agent: *\nDisallow: /{i}\nCrawl-delay: {i}") for i in (3, 11, 7, 0)] + [("b", "User-agent: *\nDisallow: /x"), ("b", "User-agent: other\nUser-agent: *"), ("b", "Disallow: /y\n\nDisallow: /z")]
    for order in (files, files[::-1], files[2:] + files[:2]):
        df = robots.parse(spark.createDataFrame(order, "authority string, body string").repartition(3))
        assert {r.authority: (r.disallow, r.crawl_delay) for r in df.collect()} == {"a": (["/0", "/11", "/3", "/7"], 11), "b": (["/z"], None)}


def test_durations(spark):
    df = spark.createDataFrame([(0,), (1,), (90_061_001,), (31_536_000_000,)], "x bigint")
    assert [r[0] for r in df.select(scalars.duration_text(F.col("x"))).collect()] == ["0 milliseconds", "1 milliseconds", "1 days 1 hours 1 minutes 1 seconds 1 milliseconds", "1 years"]


def test_limit_of_an_empty_entry(spark):
    limit = scalars.path_query_limit(F.lit(0), F.lit(0), F.lit(0), F.lit(100), F.lit(10))
    assert spark.range(1).select(limit.alias("n")).first().n >= 4


def test_config(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"max_urls": None, "authority_delay": 5, "root_dir": str(tmp_path / "new")}))
    config = read_config(str(file))
    assert config.authority_delay == 5 and config.max_urls is None and config.ip_delay == 2000 and config.root_dir.startswith("/")
    for bad in ({"nonsense": 1}, {"ip_delay": -1}, {"root_dir": str(tmp_path)}, {"is_new": False, "root_dir": str(tmp_path / "no")}, {"seed_file": str(tmp_path / "no"), "root_dir": str(tmp_path / "new")}):
        file.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            read_config(str(file))
    toml = tmp_path / "c.toml"
    toml.write_text(f"max_urls = 7\nroot_dir = '{tmp_path}/new'\n")
    assert read_config(str(toml)).max_urls == 7
    assert CrawlConfig().workbench_size == 5368709
