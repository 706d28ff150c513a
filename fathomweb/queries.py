"""One query per operator, on whole tables, and the same in SQL for DuckDB.

Where the driver's tables lack a case, a fixture of literal rows is used in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweb.config import CrawlConfig
from fathomweb.functions import html, robots, scalars, urls
from fathomweb.operators import fetching, frontier, scheduler, sieve, store
from fathomweb.plans import rounds
from fathomweb.sources import seeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

QUOTA = 5
NOW = 1_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- fixtures: the same rows in both engines

def fixture(spark: SparkSession, name: str) -> DataFrame:
    names, rows = FIXTURES[name]
    return spark.sql(f"select * from values {rows} as t({names})")


def rows_of(name: str) -> str:
    names, rows = FIXTURES[name]
    return f"(select * from (values {rows}) as t({names}))"


FIXTURES = {
    "urls": ("id, url", """
        (1, 'http://user:pw@Example.COM:8080/a/../b/./c?q=1&r=/../x#frag'), (2, 'HTTPS://www.Example.org'), (3, 'http://a/b/c/d;p?q'), (4, 'mailto:someone@example.com'),
        (5, '/just/a/path'), (6, 'http://x_y.test/a b'), (7, ''), (8, 'http://h.test/../../up/'), (9, 'ftp://h.test/a/b/..'), (10, 'http://h.test/a/.'), (11, 'http://h.test?only=query'), (12, 'http://'), (13, 'HTTP://www.www.test:80/%zz')"""),
    "links": ("id, link", """
        (1, 'g'), (2, './g'), (3, 'g/'), (4, '/g'), (5, '//g'), (6, '?y'), (7, 'g?y'), (8, '#s'), (9, 'g#s'), (10, 'g?y#s'), (11, ';x'), (12, 'g;x'), (13, ''), (14, '.'), (15, './'), (16, '..'), (17, '../'),
        (18, '../g'), (19, '../..'), (20, '../../g'), (21, '../../../g'), (22, '/./g'), (23, '/../g'), (24, 'g.'), (25, '..g'), (26, './../g'), (27, 'g/./h'), (28, 'g/../h'), (29, 'g:h'), (30, 'http://other.test/x/../y'), (31, 'mailto:a@b')"""),
    "pages": ("page_id, html", """
        (-1, '<html LANG="en"><head><title> A <b>b</b> &amp; c </title><script src="https://x/MathJax.js"></script></head><body><!-- <a href="no"> --><a rel="nofollow" href="/n">n</a><A class=x HREF=''/q''>q</A><a href=/u>u</a><p lang="de">$x^2$ and $$y$$ but \\\\[z\\\\] or \\\\(w\\\\)</p></body></html>'),
        (-2, '<p>no title<br><code class="python" data-lang="py">print(<b>1</b>)</code> text <code>x = 2</code><math><mi>x</mi><mo>+</mo></math> $not$'),
        (-3, '<title>open'), (-4, ''), (-5, cast(null as string)), (-6, '<script>if (a<b) { MATHJAX.go(); }</script><style>p{}</style>visible &lt;tag&gt;')"""),
    "robots": ("authority, body", """
        ('http://a.test', 'User-agent: *\nDisallow: /private\nDisallow: /tmp/\nCrawl-delay: 7\n\nUser-agent: other\nDisallow: /all\nSitemap: http://a.test/map.xml'),
        ('http://b.test', 'Sitemap: http://b.test/1\r\nUser-agent: other\r\nUser-agent: *\r\nDisallow: /x\r\nDisallow:\r\n   \r\nDisallow: /not\r\nSitemap: http://b.test/0'),
        ('http://c.test', 'User-agent: other\nDisallow: /c\nCrawl-delay: 2.5'), ('http://d.test', ''), ('http://e.test', 'user-AGENT:*\ndisallow:/e\nUser-agent: zed\nDisallow: /f\ncrawl-delay: x')"""),
    "states": ("authority, ip, next_fetch, paths", "('http://a.test', '127.0.0.1', 1300, 2), ('http://b.test', '127.0.0.2', 1200, 2), ('http://c.test', '127.0.0.3', 1400, 2), ('http://d.test', '127.0.0.2', 1500, 2)"),
    "ready_urls": ("seq, url", "(1, 'https://full.test/a/b/'), (2, 'https://known.test/get'), (3, 'https://new.test/'), (4, 'https://new.test/about/')"),
    "flushes": ("flush, seq, key", "(1, 1, 'A0'), (1, 2, 'A1'), (1, 3, 'A0'), (1, 4, 'A2'), (2, 5, 'A5'), (2, 6, 'A0'), (2, 7, 'A6'), (2, 8, 'A1'), (2, 9, 'A6'), (2, 10, 'A7')"),
    "done": ("authority, ip, paths, spooled, purge", "('https://first.test', '1.2.3.4', 2, 0, false), ('https://full.test', '2.3.4.5', 0, 2, false), ('https://empty.test', '3.4.5.6', 0, 0, false), ('https://gone.test', '4.5.6.7', 3, 1, true)"),
    "fronts": ("id, front, required, ready_urls, last_flush", "(1, 10, 1000, 0, 998000), (2, 10, 1000, 0, 999500), (3, 10, 1000, 7, 0), (4, 2000, 1000, 7, 0), (5, 10, 1100, 0, 0)"),
}


# ---------------------------------------------------------------- URLs in SQL

def _p(u: str, i: int) -> str:
    return f"regexp_extract({u}, '{urls.PARTS}', {i})"


def _scheme(u: str) -> str:
    return f"lower(regexp_replace({_p(u, 1)}, ':$', ''))"


def _host_port(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({_p(u, 2)}, '{urls.USERINFO}', '//'), '^//', ''))"


def _host(u: str) -> str:
    return f"regexp_replace({_host_port(u)}, ':[0-9]*$', '')"


def _valid(u: str) -> str:
    return f"({_scheme(u)} <> '' and {_host(u)} <> '')"


def _authority(u: str) -> str:
    return f"(case when {_valid(u)} then {_scheme(u)} || '://' || {_host_port(u)} end)"


def _path_query(u: str) -> str:
    return f"({_p(u, 3)} || {_p(u, 4)})"


def _dots(path: str) -> str:
    segments = f"string_split(regexp_replace({path}, '^/', ''), '/')"
    fold = f"list_reduce(list_prepend([]::varchar[], list_transform({segments}, lambda s: [s])), lambda a, x: case when x[1] = '..' then a[1:greatest(len(a) - 1, 0)] when x[1] = '.' then a else list_concat(a, x) end)"
    tail = f"case when {segments}[-1] in ('.', '..') then list_append({fold}, '') else {fold} end"
    return f"(case when {path} not like '/%' then {path} else '/' || array_to_string({tail}, '/') end)"


def _normalize(u: str) -> str:
    return f"(case when {_valid(u)} then {_scheme(u)} || '://' || {_host_port(u)} || {_dots(_p(u, 3))} || {_p(u, 4)} else regexp_replace({u}, '#.*$', '') end)"


def _resolve(b: str, link: str) -> str:
    s, a, p, q, f = (_p(link, i) for i in range(1, 6))
    bs, ba, bp, bq = (_p(b, i) for i in range(1, 5))
    merged = f"case when {ba} <> '' and {bp} = '' then '/' || {p} else regexp_extract({bp}, '^(.*/)', 1) || {p} end"
    return f"""(case when {s} <> '' then {s} || {a} || {_dots(p)} || {q} || {f} when {a} <> '' then {bs} || {a} || {_dots(p)} || {q} || {f}
        when {p} = '' and {q} <> '' then {bs} || {ba} || {bp} || {q} || {f} when {p} = '' then {bs} || {ba} || {bp} || {bq} || {f}
        when {p} like '/%' then {bs} || {ba} || {_dots(p)} || {q} || {f} else {bs} || {ba} || {_dots(f"({merged})")} || {q} || {f} end)"""


ALL_URLS = f"(select page_id as id, url from pages union all select -id, url from {rows_of('urls')})"


def all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").union(fixture(spark, "urls").select((-F.col("id")).cast("bigint"), "url"))


@query(f"select id, {_authority('url')} as authority from {ALL_URLS}")
def url_authority(spark, sf_dir):
    return all_urls(spark, sf_dir).select("id", urls.authority(F.col("url")).alias("authority"))


@query(f"select id, {_path_query('url')} as path_query from {ALL_URLS}")
def url_path_query(spark, sf_dir):
    return all_urls(spark, sf_dir).select("id", urls.path_query(F.col("url")).alias("path_query"))


@query(f"select id, array_to_string(string_split({_host('url')}, '.'), '|') as labels, len(string_split({_host('url')}, '.'))::int as n from {ALL_URLS}")
def url_host_labels(spark, sf_dir):
    labels = urls.host_labels(F.col("url"))
    return all_urls(spark, sf_dir).select("id", F.array_join(labels, "|").alias("labels"), F.size(labels).alias("n"))


@query(f"select id, regexp_replace({_host('url')}, '^www\\.', '') as host from {ALL_URLS}")
def url_strip_www(spark, sf_dir):
    return all_urls(spark, sf_dir).select("id", urls.strip_www(urls.host(F.col("url"))).alias("host"))


@query(f"select id, {_valid('url')} as valid, {_valid('url')} and {_scheme('url')} in ('http', 'https') as fetchable from {ALL_URLS}")
def url_valid(spark, sf_dir):
    return all_urls(spark, sf_dir).select("id", urls.valid(F.col("url")).alias("valid"), urls.fetchable(F.col("url")).alias("fetchable"))


@query(f"select id, {_normalize('url')} as normal from {ALL_URLS}")
def url_normalize(spark, sf_dir):
    return all_urls(spark, sf_dir).select("id", urls.normalize(F.col("url")).alias("normal"))


@query(f"select id, {_resolve(chr(39) + 'http://a/b/c/d;p?q' + chr(39), 'link')} as resolved from {rows_of('links')}")
def url_resolve(spark, sf_dir):
    return fixture(spark, "links").select("id", urls.resolve(F.lit("http://a/b/c/d;p?q"), F.col("link")).alias("resolved"))


@query(f"select id, 'http://parent.test:81' || {_p('url', 3)} || {_p('url', 4)} || {_p('url', 5)} as child from {ALL_URLS}")
def url_make_absolute(spark, sf_dir):
    return all_urls(spark, sf_dir).select("id", urls.make_absolute(F.lit("HTTP://u@Parent.test:81/x"), F.col("url")).alias("child"))


@query(f"select id, lower(hex(encode(url))) as bytes, url as back from {ALL_URLS}")
def url_bytes(spark, sf_dir):
    raw = F.encode("url", "UTF-8")
    return all_urls(spark, sf_dir).select("id", F.lower(F.hex(raw)).alias("bytes"), F.decode(raw, "UTF-8").alias("back"))


@query(f"select id, md5(url) as hash from {ALL_URLS}")
def url_hash(spark, sf_dir):
    return all_urls(spark, sf_dir).select("id", urls.url_hash(F.col("url")).alias("hash"))


@query(f"select id, {_authority('url')} || '/robots.txt' as robots from {ALL_URLS}")
def robots_url(spark, sf_dir):
    return all_urls(spark, sf_dir).select("id", urls.robots_url(F.col("url")).alias("robots"))


# ---------------------------------------------------------------- HTML

_FIX_PAGES = rows_of("pages").replace("cast(null as string)", "null").replace("\\\\", "\\")
ALL_PAGES = f"(select page_id, html from pages union all select * from {_FIX_PAGES})"


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "html").union(fixture(spark, "pages").select(F.col("page_id").cast("bigint"), "html"))


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _attr(tag: str, name: str) -> str:
    p = _q(html.attribute_pattern(name))
    return "(" + " || ".join(f"regexp_extract({tag}, '{p}', {i})" for i in (1, 2, 3)) + ")"


def _strip(x: str) -> str:
    out = f"regexp_replace({x}, '{html.TAG}', ' ', 'g')"
    for entity, sign in html.ENTITIES:
        out = f"replace({out}, '{entity}', '{_q(sign)}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _text(x: str) -> str:
    out = f"coalesce({x}, '')"
    for p in html.HIDDEN:
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return _strip(out)


def _latex(x: str) -> str:
    return "list_concat(" * 2 + f"regexp_extract_all({x}, '{html.LATEX[0]}'), regexp_extract_all({x}, '{html.LATEX[1]}')), regexp_extract_all({x}, '{html.LATEX[2]}'))"


_LINKS = f"""(select page_id, (i - 1)::int as pos, {_attr('l[i]', 'href')} as link from (select page_id, l, unnest(range(1, len(l) + 1)) as i from (
    select page_id, list_filter(regexp_extract_all(coalesce(html, ''), '{html.ANCHOR}'), lambda t: regexp_matches(t, '{_q(html.attribute_pattern("href"))}') and not contains({_attr('t', 'rel')}, 'nofollow')) as l from {{}})))"""


@query(f"select * from {_LINKS.format(ALL_PAGES)}")
def html_links(spark, sf_dir):
    return all_pages(spark, sf_dir).select("page_id", F.posexplode(html.extract("regex", "links", F.col("html"))).alias("pos", "link"))


@query(f"select page_id, {_text('html')} as text from {ALL_PAGES}")
def html_text(spark, sf_dir):
    return all_pages(spark, sf_dir).select("page_id", html.extract("regex", "text", F.col("html")).alias("text"))


@query(f"select page_id, case when regexp_matches(html, '{html.TITLE}') then {_strip(f'regexp_extract(html, {chr(39)}{html.TITLE}{chr(39)}, 1)')} end as title from {ALL_PAGES}")
def html_title(spark, sf_dir):
    return all_pages(spark, sf_dir).select("page_id", html.extract("regex", "title", F.col("html")).alias("title"))


@query(f"select page_id, array_to_string(regexp_extract_all(coalesce(html, ''), '{_q(html.LANG)}', 1), ',') as langs from {ALL_PAGES}")
def html_lang(spark, sf_dir):
    return all_pages(spark, sf_dir).select("page_id", F.array_join(html.extract("regex", "lang_attributes", F.col("html")), ",").alias("langs"))


@query(f"""select page_id, (i - 1)::int as pos, {_strip('c[i]')} as code, array_to_string(list_transform(list_zip(regexp_extract_all(a[i], '{_q(html.ATTRIBUTE)}', 1), regexp_extract_all(a[i], '{_q(html.ATTRIBUTE)}', 2)), lambda p: p[1] || '=' || p[2]), ' ') as lang_info
    from (select *, unnest(range(1, len(c) + 1)) as i from (select page_id, regexp_extract_all(coalesce(html, ''), '{html.CODE}', 1) as a, regexp_extract_all(coalesce(html, ''), '{html.CODE}', 2) as c from {ALL_PAGES}))""")
def html_code(spark, sf_dir):
    found = all_pages(spark, sf_dir).select("page_id", F.posexplode(html.extract("regex", "code", F.col("html"))).alias("pos", "c"))
    return found.select("page_id", "pos", "c.code", F.array_join(F.transform("c.lang_info", lambda p: F.concat(p["k"], F.lit("="), p["v"])), " ").alias("lang_info"))


@query(f"""select page_id, array_to_string(case when len(m) > 0 then list_transform(m, lambda x: {_strip('x')}) else {_latex('t')} end, ' ; ') as math
    from (select page_id, regexp_extract_all(coalesce(html, ''), '{html.MATH}', 1) as m, {_text('html')} as t from {ALL_PAGES})""")
def html_math(spark, sf_dir):
    return all_pages(spark, sf_dir).select("page_id", F.array_join(html.extract("regex", "math", F.col("html")), " ; ").alias("math"))


@query(f"select page_id, array_to_string({_latex('x')}, ' ; ') as latex from (select page_id, coalesce(html, '') as x from {ALL_PAGES})")
def html_latex(spark, sf_dir):
    return all_pages(spark, sf_dir).select("page_id", F.array_join(html.latex(F.col("html")), " ; ").alias("latex"))


@query(f"select page_id, len(list_filter(regexp_extract_all(coalesce(html, ''), '{html.SCRIPT}'), lambda s: contains(lower(s), 'mathjax'))) > 0 as mathjax from {ALL_PAGES}")
def html_mathjax(spark, sf_dir):
    return all_pages(spark, sf_dir).select("page_id", html.mathjax(F.col("html")).alias("mathjax"))


@query()
def html_parser_links(spark, sf_dir):
    """The parser engine; see the tests for its results on difficult markup."""
    return all_pages(spark, sf_dir).select("page_id", F.posexplode(html.extract("parser", "links", F.col("html"))).alias("pos", "link"))


# ---------------------------------------------------------------- robots

_ROBOTS_OF_PAGES = "'User-agent: *' || chr(10) || 'Disallow: /b' || (page_id % 7) || chr(10) || 'Disallow: /a' || (page_id % 3) || chr(10) || 'Crawl-delay: ' || (page_id % 5) || chr(10) || chr(10) || 'User-agent: x' || chr(10) || 'Disallow: /no'"
_ALL_ROBOTS = f"(select url as authority, {_ROBOTS_OF_PAGES} as body from pages union all select * from {rows_of('robots')})"
_LINES = f"""(select authority, i as pos, trim(regexp_replace(l[i], '[\\r\\t]', ' ', 'g')) as line from (select authority, l, unnest(range(1, len(l) + 1)) as i from (select authority, string_split(body, chr(10)) as l from {_ALL_ROBOTS})))"""
_PARSED = f"""(select authority, array_to_string(coalesce(list_sort(list(value) filter (relevant and name = 'disallow' and value <> '')), []), ',') as disallow,
    coalesce(string_agg(value, ',' order by pos) filter (name = 'sitemap'), '') as sitemap, arg_min(try_cast(case when regexp_full_match(value, '[+-]?[0-9]+') then value end as int), pos) filter (relevant and name = 'crawl-delay') as crawl_delay
    from (select *, max((name = 'user-agent' and value = '*')::int) over (partition by authority, part order by pos rows unbounded preceding) = 1 as relevant from (
        select *, sum((line = '')::int) over (partition by authority order by pos rows unbounded preceding) as part, lower(regexp_extract(line, '{robots.FIELD}', 1)) as name, trim(regexp_extract(line, '{robots.FIELD}', 2)) as value from {_LINES})) group by authority)"""


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = read(spark, sf_dir, "pages").select(F.col("url").alias("authority"), F.expr(_ROBOTS_OF_PAGES).alias("body")).union(fixture(spark, "robots"))
    return robots.parse(bodies.where("body is not null"))  # in SQL, too, a null has no lines


@query(f"select * from {_PARSED}")
def robots_parse(spark, sf_dir):
    return _robots(spark, sf_dir).select("authority", F.array_join("disallow", ",").alias("disallow"), F.array_join("sitemap", ",").alias("sitemap"), "crawl_delay")


@query(f"select p.authority, path, not coalesce(list_bool_or(list_transform(string_split(disallow, ','), lambda d: d <> '' and starts_with(path, d))), false) as allowed from {_PARSED} p, (values ('/a1/x'), ('/private'), ('/tmp'), ('/b2')) as t(path)")
def robots_filter(spark, sf_dir):
    paths = F.explode(F.array(*map(F.lit, ("/a1/x", "/private", "/tmp", "/b2"))))
    return _robots(spark, sf_dir).withColumn("path", paths).select("authority", "path", robots.allowed(F.col("path"), F.col("disallow")).alias("allowed"))


@query(f"select authority, '/robots.txt|/p1|/p2' as queued, '/p1|/p2' as removed from {rows_of('states')}")
def robots_queue(spark, sf_dir):
    paths = F.array(F.lit("/p1"), F.lit("/p2"))
    queued = robots.enqueue_robots(paths)
    return fixture(spark, "states").select("authority", F.array_join(queued, "|").alias("queued"), F.array_join(robots.remove_robots(queued), "|").alias("removed"))


# ---------------------------------------------------------------- scalars

@query("""select l_orderkey, l_linenumber, l_orderkey // 8 * 8 as multiple, l_orderkey // 1000 as seconds, lower(l_returnflag) = lower('r') as same,
    (l_orderkey * 2654435 % 4294967296 // 16777216) || '.' || (l_orderkey * 2654435 % 4294967296 // 65536 % 256) || '.' || (l_orderkey * 2654435 % 4294967296 // 256 % 256) || '.' || (l_orderkey * 2654435 % 4294967296 % 256) as ip from lineitem""")
def scalar_functions(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem")
    packed = (F.col("l_orderkey") * 2654435) % 4294967296
    return t.select("l_orderkey", "l_linenumber", scalars.multiple_of_8(F.col("l_orderkey")).alias("multiple"), scalars.epoch_seconds(F.col("l_orderkey")).alias("seconds"), scalars.equals_ignoring_case(F.col("l_returnflag"), F.lit("r")).alias("same"), scalars.ipv4_text(packed).alias("ip"))


def _duration(x: str) -> str:
    parts, rest = [], x
    for name, size in scalars.UNITS:
        parts.append(f"case when {rest} // {size} > 0 then ({rest} // {size}) || ' {name}' end")
        rest = f"({rest} % {size})"
    return f"coalesce(nullif(concat_ws(' ', {', '.join(parts)}), ''), '0 milliseconds')"


@query(f"select o_orderkey, {_duration('(o_orderkey * o_custkey * 7919)')} as duration from orders")
def duration_text(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.duration_text(F.col("o_orderkey") * F.col("o_custkey") * 7919).alias("duration"))


_POLICY = "(values " + ", ".join(f"('{n}', {w}::bigint, {m}, {str(k).lower()})" for n, w, m, k in scalars.EXCEPTIONS) + ") as policy(exception, wait, max_retries, host_killer)"


@query(f"select * from {_POLICY}")
def exception_policy(spark, sf_dir):
    return scalars.exception_policy(spark)


@query("select s_suppkey, least(case when s_suppkey % 5 * 1000 > 0 then 300000.0 / (s_suppkey % 5 * 1000) else 1e300 end, greatest(4, ceil(5368709 / (greatest(s_nationkey / greatest(1.0, (s_suppkey % 5 * 1000 + 1) / 2001), 1e-9) * 1000)))).floor()::bigint as most from supplier")
def path_query_limit(spark, sf_dir):
    delay = F.col("s_suppkey") % 5 * 1000
    return read(spark, sf_dir, "supplier").select("s_suppkey", scalars.path_query_limit(F.col("s_nationkey"), delay, F.lit(2000), F.lit(CrawlConfig().workbench_size), F.lit(1000)).alias("most"))


@query("select c_custkey, (length('n' || c_custkey) + length(c_name) + length(coalesce(c_mktsegment, '')) + 1)::int as size, c_custkey * 1000 // 100 as workbench, c_custkey * 1000 // 64 as cache from customer")
def size_functions(spark, sf_dir):
    cookie = F.struct(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_name").alias("value"), F.col("c_mktsegment").alias("domain"), F.lit("/").alias("path"))
    t = read(spark, sf_dir, "customer").withColumn("cookie", cookie)
    return t.select("c_custkey", scalars.cookie_size(F.col("cookie")).alias("size"), scalars.workbench_size(F.col("c_custkey") * 1000).alias("workbench"), scalars.cache_entries(F.col("c_custkey") * 1000).alias("cache"))


# ---------------------------------------------------------------- links, quotas, sieve, routing

_RESOLVED = f"(select l.page_id, pos, {_normalize('r')} as url from (select l.page_id, pos, {_resolve('p.url', 'trim(link)')} as r from {_LINKS.format('pages')} l join pages p on l.page_id = p.page_id) l)"
_NEW = f"(select page_id, url, min(pos) as pos from {_RESOLVED} where {_valid('url')} and {_scheme('url')} in ('http', 'https') group by page_id, url)"
_COUNTS = f"(select {_authority('url')} as authority, count(*) as n from pages group by 1)"
_WITHIN = f"(select x.* from (select *, {_authority('url')} as authority from {_NEW}) x left join {_COUNTS} c using (authority) where coalesce(n, 0) < {QUOTA})"
_FIRST = f"(select url, arg_min(page_id, page_id * 100000 + pos) as page_id, arg_min(pos, page_id * 100000 + pos) as pos, min(authority) as authority from {_WITHIN} group by url)"


def _within(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return frontier.within_quota(frontier.new_links(pages), frontier.authority_counts(pages), QUOTA)


@query(f"select page_id, pos, url from {_NEW}")
def page_new_links(spark, sf_dir):
    return frontier.new_links(read(spark, sf_dir, "pages")).select("page_id", "pos", "url")


@query(f"select * from {_COUNTS}")
def authority_counts(spark, sf_dir):
    return frontier.authority_counts(read(spark, sf_dir, "pages"))


@query("select count(*) as crawled from pages")
def total_crawled(spark, sf_dir):
    return frontier.total(frontier.authority_counts(read(spark, sf_dir, "pages")))


@query(f"select page_id, pos, url from {_WITHIN}")
def quota_presieve(spark, sf_dir):
    return _within(spark, sf_dir).select("page_id", "pos", "url")


@query(f"select page_id, pos, url from {_FIRST} x left join (select authority, 2 * n as m from {_COUNTS}) c using (authority) where coalesce(m, 0) < {QUOTA}")
def quota_postsieve(spark, sf_dir):
    """The second quota test, after counts have grown."""
    counts = frontier.authority_counts(read(spark, sf_dir, "pages")).select("authority", (F.col("n") * 2).alias("n"))
    found = sieve.first_arrivals(_within(spark, sf_dir).select("url", F.struct("page_id", "pos").alias("seq")))
    return frontier.within_quota(found, counts, QUOTA).select("seq.page_id", "seq.pos", "url")


@query(f"select url, page_id, pos, authority, row_number() over (partition by authority order by page_id, pos)::int as place from {_FIRST} where url not in (select url from pages)")
def frontier_new_urls(spark, sf_dir):
    """The flagship: what a crawl finds in all pages, less quota and history, in each authority's order."""
    pages = read(spark, sf_dir, "pages")
    return frontier.new_urls(pages, pages.select("url"), QUOTA)


@query(f"select url, page_id, pos from {_FIRST}")
def sieve_first_arrival(spark, sf_dir):
    found = sieve.first_arrivals(_within(spark, sf_dir).select("url", F.struct("page_id", "pos").alias("seq")))
    return found.select("url", "seq.page_id", "seq.pos")


@query(f"select url, page_id, pos from {_FIRST} where url not in (select url from {_NEW} where page_id % 2 = 0)")
def sieve_against_history(spark, sf_dir):
    """History: the links of pages with even ids."""
    history = frontier.new_links(read(spark, sf_dir, "pages")).where("page_id % 2 = 0").select("url")
    found = sieve.flush(_within(spark, sf_dir).select("url", F.struct("page_id", "pos").alias("seq")), history)
    return found.select("url", "seq.page_id", "seq.pos")


@query(f"select min_f as flush, seq, key from (select key, min(flush) as min_f, min(seq) as seq from {rows_of('flushes')} group by key)")
def sieve_two_flush(spark, sf_dir):
    return sieve.two_flushes(fixture(spark, "flushes"))


@query("select l_suppkey as key, min(l_orderkey * 10 + l_linenumber) as seq from lineitem group by 1")
def sieve_output(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return sieve.first_arrivals(t, "key", "seq")


@query("select l_partkey as key, l_orderkey * 10 + l_linenumber as seq from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey * 10 + l_linenumber) = 1")
def sorted_arrival(spark, sf_dir):
    """External sort of a batch by key, then arrival order: both are Spark's."""
    t = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return sieve.first_arrivals(t, "key", "seq").orderBy("seq")


@query("select count(*) as n, count(distinct url) as n_distinct, count(*) = count(distinct url) as consistent from (select url from pages union all select url from pages where page_id % 10 = 0)")
def sieve_history_check(spark, sf_dir):
    t = read(spark, sf_dir, "pages")
    return sieve.consistent(sieve.with_history(t.where("page_id % 10 = 0").select("url"), t.select("url")))


@query(f"select distinct url from (select {_normalize('url')} as url from pages union all select url from {_NEW})")
def seed_union(spark, sf_dir):
    t = read(spark, sf_dir, "pages")
    return t.select(urls.normalize(F.col("url")).alias("url")).unionByName(frontier.new_links(t).select("url")).distinct()


@query(f"select distinct {_authority('url')} as authority from pages where page_id % 3 <> 0 and {_authority('url')} not in (select {_authority('url')} from pages where page_id % 3 = 0)")
def authority_set(spark, sf_dir):
    """Authorities added, less those removed."""
    t = read(spark, sf_dir, "pages").withColumn("authority", urls.authority(F.col("url")))
    return frontier.membership(t.where("page_id % 3 != 0"), t.where("page_id % 3 = 0"))


@query(f"select seq, url, authority, case when authority = 'https://full.test' then 'drop' when authority = 'https://known.test' then 'spool' else 'new' end as route from (select *, {_authority('url')} as authority from {rows_of('ready_urls')})")
def route_ready_urls(spark, sf_dir):
    counts = spark.createDataFrame([("https://full.test", 3)], "authority string, n bigint")
    registered = spark.createDataFrame([("https://known.test",)], "authority string")
    return frontier.routed(fixture(spark, "ready_urls"), counts, registered, 3).select("seq", "url", "authority", "route")


@query(f"""select r.url, r.page_id, r.pos, r.authority, case when coalesce(n, 0) >= 3 then 'drop' when k.authority is not null then 'spool' else 'new' end as route
    from {_FIRST} r left join {_COUNTS} c using (authority) left join (select distinct {_authority('url')} as authority from pages where page_id % 2 = 0) k on r.authority = k.authority""")
def route_all(spark, sf_dir):
    t = read(spark, sf_dir, "pages")
    found = sieve.first_arrivals(_within(spark, sf_dir).select("url", F.struct("page_id", "pos").alias("seq")))
    registered = t.where("page_id % 2 = 0").select(urls.authority(F.col("url")).alias("authority"))
    return frontier.routed(found, frontier.authority_counts(t), registered, 3).select("url", "seq.page_id", "seq.pos", "authority", "route")


@query(f"select authority, count(*) as n_paths, string_agg({_path_query('url')}, '|' order by page_id, pos, {_path_query('url')}) as path_queries from {_FIRST} group by authority")
def visit_state_build(spark, sf_dir):
    found = sieve.first_arrivals(_within(spark, sf_dir).select("url", F.struct("page_id", "pos").alias("seq")))
    return frontier.visit_states(found, 1_000_000).select("authority", "n_paths", F.array_join("path_queries", "|").alias("path_queries"))


@query(f"select authority, coalesce(n, 0) as n from (select distinct {_authority('url')} as authority from pages union select 'http://nobody.test') left join {_COUNTS} using (authority)")
def count_lookup(spark, sf_dir):
    t = read(spark, sf_dir, "pages")
    keys = t.select(urls.authority(F.col("url")).alias("authority")).distinct().union(spark.range(1).select(F.lit("http://nobody.test")))
    return frontier.looked_up(keys, frontier.authority_counts(t))


@query(f"select page_id, {_authority('url')} in (select {_authority('url')} from pages where page_id % 2 = 0) as registered from pages")
def authority_split(spark, sf_dir):
    t = read(spark, sf_dir, "pages").select("page_id", urls.authority(F.col("url")).alias("authority"))
    split = frontier.split_by_membership(t.select("authority").distinct(), t.where("page_id % 2 = 0"))
    return t.join(split, "authority", "left").select("page_id", F.coalesce("registered", F.lit(False)).alias("registered"))


# ---------------------------------------------------------------- scheduling. Visit states: users of events; entries: 97 ips

_STATES = "(select 'http://h' || user_id || '.test' as authority, '10.0.0.' || (user_id % 97) as ip, min(event_id * 7919 % 100000) as next_fetch, count(*) as paths from events group by user_id)"
_ENTRIES = "(select distinct '10.0.0.' || (user_id % 97) as ip, user_id % 97 * 1000 % 50000 as next_fetch, user_id % 97 % 4 = 3 as busy from events)"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.col("event_id") * 7919 % 100000).alias("next_fetch"), F.count("*").alias("paths"))
    return t.select(F.concat(F.lit("http://h"), F.col("user_id").cast("string"), F.lit(".test")).alias("authority"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 97).cast("string")).alias("ip"), "next_fetch", "paths")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 97
    return read(spark, sf_dir, "events").select(F.concat(F.lit("10.0.0."), k.cast("string")).alias("ip"), (k * 1000 % 50000).alias("next_fetch"), (k % 4 == 3).alias("busy")).distinct()


_HEADS = f"(select s.ip, s.authority, greatest(s.next_fetch, e.next_fetch) as ready_at from (select * from {_STATES} qualify row_number() over (partition by ip order by next_fetch, authority) = 1) s join {_ENTRIES} e using (ip) where not e.busy)"


@query(f"select * from {_HEADS}")
def entry_head(spark, sf_dir):
    return scheduler.heads(_states(spark, sf_dir), _entries(spark, sf_dir))


@query(f"select ip, authority, ready_at from {_HEADS} where ready_at <= 20000")
def one_per_ip(spark, sf_dir):
    """A scheduling step: all that may start, one authority for each idle ip."""
    return scheduler.ready(_states(spark, sf_dir), _entries(spark, sf_dir), 20_000)


@query(f"select ip, authority, ready_at from {_HEADS} where ready_at <= 60000 order by ready_at, authority limit 1")
def ready_pick(spark, sf_dir):
    return scheduler.peek(_states(spark, sf_dir), _entries(spark, sf_dir), 60_000)


@query(f"select e.ip, e.next_fetch, e.busy or exists (select 1 from {_HEADS} h where h.ip = e.ip and ready_at <= 20000) as busy from {_ENTRIES} e")
def pop_visit_state(spark, sf_dir):
    states, entries = _states(spark, sf_dir), _entries(spark, sf_dir)
    return scheduler.popped(entries, scheduler.ready(states, entries, 20_000))


_ADDED = "(select 'http://h' || s_suppkey || '.test' as authority, '10.0.0.' || (s_suppkey % 101) as ip, s_suppkey * 10 as next_fetch, s_suppkey as paths, s_suppkey % 2 = 0 as locked from supplier)"


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("http://h"), k.cast("string"), F.lit(".test")).alias("authority"), F.concat(F.lit("10.0.0."), (k % 101).cast("string")).alias("ip"), (k * 10).alias("next_fetch"), k.alias("paths"), (k % 2 == 0).alias("locked"))


@query(f"select authority, ip, next_fetch, paths from {_STATES} where authority not in (select authority from {_ADDED}) union all select authority, ip, next_fetch, paths from {_ADDED}")
def add_visit_state(spark, sf_dir):
    return scheduler.added(_states(spark, sf_dir), _entries(spark, sf_dir), _added(spark, sf_dir))[0]


@query(f"select coalesce(e.ip, a.ip) as ip, coalesce(e.next_fetch, 0) as next_fetch, coalesce(busy, false) and not coalesce(locked, false) as busy from {_ENTRIES} e full join (select ip, bool_or(locked) as locked from {_ADDED} group by ip) a on e.ip = a.ip")
def add_releases_entry(spark, sf_dir):
    return scheduler.added(_states(spark, sf_dir), _entries(spark, sf_dir), _added(spark, sf_dir))[1]


_LEFT = f"(select * from {_STATES} where paths >= 12)"


@query(f"select e.ip, e.next_fetch, e.busy and g.ip is null as busy from {_ENTRIES} e left join (select distinct ip from {_STATES} where paths < 12) g on e.ip = g.ip where g.ip is null or e.ip in (select ip from {_LEFT})")
def purge_visit_state(spark, sf_dir):
    states = _states(spark, sf_dir)
    return scheduler.purged(states, _entries(spark, sf_dir), states.where("paths < 12"))[1]


@query(f"select e.ip, coalesce(a.at, e.next_fetch) as next_fetch, busy from {_ENTRIES} e left join (select ip, max(next_fetch) as at from {_ADDED} group by ip) a on e.ip = a.ip")
def set_next_fetch(spark, sf_dir):
    times = _added(spark, sf_dir).groupBy("ip").agg(F.max("next_fetch").alias("at"))
    return scheduler.delayed_entries(_entries(spark, sf_dir), times)


@query(f"select ip, authority, ready_at from (select *, row_number() over (order by ready_at, authority) as k from {_HEADS} where ready_at <= 60000) where k <= 10")
def todo_step(spark, sf_dir):
    """The first ten of a step, by time."""
    return scheduler.ready(_states(spark, sf_dir), _entries(spark, sf_dir), 60_000).orderBy("ready_at", "authority").limit(10)


@query(f"select s.authority, s.ip, s.next_fetch from {rows_of('states')} s where s.next_fetch <= 1200 order by next_fetch limit 1")
def workbench_pick(spark, sf_dir):
    """Four visit states on three ips, 200 ms on: the first to go."""
    states = fixture(spark, "states")
    entries = states.select("ip").distinct().select("ip", F.lit(0).alias("next_fetch"), F.lit(False).alias("busy"))
    return scheduler.peek(states, entries, 1200).select("authority", "ip", F.col("ready_at").alias("next_fetch"))


@query(f"select authority, case when purge then 'purge' when paths > 0 then 'add' when spooled > 0 then 'refill' else 'purge' end as route from {rows_of('done')}")
def done_routing(spark, sf_dir):
    return fixture(spark, "done").select("authority", scheduler.done_route(F.col("paths"), F.col("spooled"), F.col("purge")).alias("route"))


@query(f"select id, case when front >= required then 'wait' when ready_urls = 0 and {NOW} - last_flush >= 1000 then 'flush' when ready_urls > 0 then 'enlarge' else 'wait' end as step from {rows_of('fronts')}")
def distributor_routing(spark, sf_dir):
    step = scheduler.distributor_step(F.col("front"), F.col("required"), F.col("ready_urls"), F.lit(NOW), F.col("last_flush"))
    return fixture(spark, "fronts").select("id", step.alias("step"))


@query(f"select sum(paths)::bigint as path_queries, sum(paths) > 5000 as is_full from {_STATES}")
def workbench_full(spark, sf_dir):
    return scheduler.fullness(_states(spark, sf_dir), 5000)


@query("select count(*) filter (not busy) as idle, 1000 + 100 * count(*) filter (not busy) as required from " + _ENTRIES)
def adaptive_front(spark, sf_dir):
    """Each idle fetcher raises the required front by 100."""
    return scheduler.required_front(_entries(spark, sf_dir), CrawlConfig().required_front_size)


@query("select count(*) as ips, count(*) filter (busy) as busy, (select count(*) from events) as queued, (select count(distinct user_id) from events) as authorities from " + _ENTRIES)
def queue_gauges(spark, sf_dir):
    return scheduler.gauges(_entries(spark, sf_dir), read(spark, sf_dir, "events"), "user_id")


@query("select conv_id, count(*) as n, count(distinct role) as roles from conversations group by conv_id")
def distinct_sizes(spark, sf_dir):
    return frontier.spool_sizes(read(spark, sf_dir, "conversations"), "conv_id").join(read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("roles")), "conv_id")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn)::int as place from conversations qualify place <= 3")
def spool_fifo(spark, sf_dir):
    return frontier.spool_dequeue(read(spark, sf_dir, "conversations"), 3, "conv_id", "turn").select("conv_id", "turn", "place")


@query("select conv_id, turn from conversations where conv_id not in (select doc_id from labels where quality = 0)")
def spool_remove(spark, sf_dir):
    gone = read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("conv_id"))
    return frontier.spool_remove(read(spark, sf_dir, "conversations").select("conv_id", "turn"), gone, "conv_id")


@query("select o_custkey as authority, o_orderkey as seq, o_orderpriority as path_query from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) o join (select c_custkey, 1 + c_custkey % 4 as most from customer) c on o_custkey = c_custkey where k <= most")
def refill_limit(spark, sf_dir):
    spool = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("authority"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("path_query"))
    limits = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("authority"), (1 + F.col("c_custkey") % 4).alias("most"))
    return scheduler.refill(spool, limits)


@query("select event_id, event_id * 7919 % 100000 as available_at from events where event_id * 7919 % 100000 <= 30000")
def delay_ready(spark, sf_dir):
    return scheduler.due(read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 % 100000).alias("available_at")), 30_000)


@query("select o_orderkey from orders order by o_orderkey limit 100")
def ready_batch(spark, sf_dir):
    """The hundred ready URLs of one round."""
    return scheduler.ready_batch(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("select o_orderkey % 7 as prio, o_orderkey, part from (select o_orderkey, case when o_orderkey % 7 < 2 then 'below' when o_orderkey % 7 >= 5 then 'from' else 'between' end as part from orders)")
def priority_range(spark, sf_dir):
    """All orders as a priority queue, by three ranges of priorities that don't meet."""
    t = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("prio"), "o_orderkey")
    parts = {"below": scheduler.in_range(t, below=2), "between": scheduler.in_range(t, below=5, at_least=2), "from": scheduler.in_range(t, at_least=5)}
    made = [x.withColumn("part", F.lit(name)) for name, x in parts.items()]
    return made[0].union(made[1]).union(made[2])


@query("select count(*) as crawled, 100 < count(*) as stop from pages")
def stop_condition(spark, sf_dir):
    return frontier.total(frontier.authority_counts(read(spark, sf_dir, "pages"))).withColumn("stop", rounds.reached(F.col("crawled"), 100))


@query("select conv_id, turn, total::bigint as total from (select conv_id, turn, sum(length(role) + length(text)) over (partition by conv_id order by turn rows unbounded preceding) as total from conversations) where total < 2048")
def cookie_prefix(spark, sf_dir):
    """Turns as cookies: the longest prefix below the byte limit."""
    t = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("pos"), F.col("role").alias("name"), F.col("text").alias("value"), F.lit("").alias("domain"), F.lit("").alias("path"))
    return frontier.limited_cookies(t, CrawlConfig().cookies_max_byte_size).select(F.col("owner").alias("conv_id"), F.col("pos").alias("turn"), "total")


@query(f"select authority, ip, next_fetch, 3::int as size, '/' || paths as first_path, '/b|/c' as rest, next_fetch <= 50000 as fetchable from {_STATES}")
def visit_state_ops(spark, sf_dir):
    """Enqueue, first, dequeue, size and the test whether it is time, for every visit state."""
    start = F.array(F.concat(F.lit("/"), F.col("paths").cast("string")), F.lit("/b"))
    t = _states(spark, sf_dir).withColumn("queue", scheduler.enqueued(start, F.lit("/c")))
    return t.select(
        "authority", "ip", "next_fetch", F.size("queue").alias("size"), scheduler.first_path(F.col("queue")).alias("first_path"),
        F.array_join(scheduler.dequeued(F.col("queue")), "|").alias("rest"), scheduler.is_time(F.col("next_fetch"), 50_000).alias("fetchable"),
    )


# ---------------------------------------------------------------- DNS and fetching

_HOST_IP = "(select 'h' || s_suppkey || '.test' as host, '10.1.' || (s_suppkey // 256) || '.' || (s_suppkey % 256) as ip, s_suppkey * 100 as ts from supplier)"


def _host_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), k.cast("string"), F.lit(".test")).alias("host"), F.concat(F.lit("10.1."), F.floor(k / 256).cast("string"), F.lit("."), (k % 256).cast("string")).alias("ip"), (k * 100).alias("ts"))


_DNS = f"(select s.authority, {_host('s.authority')} as host, d.ip from {_STATES} s left join {_HOST_IP} d on d.host = {_host('s.authority')})"


@query(f"select * from {_DNS}")
def dns_lookup(spark, sf_dir):
    return fetching.resolved(_states(spark, sf_dir), _host_ip(spark, sf_dir))


@query(f"""select authority, ip, (case when ip is null and r < 2 then r + 1 else r end)::bigint as retries, case when ip is not null then 'add' when r < 2 then 'delay' else 'drop' end as outcome,
    case when ip is null and r < 2 then ({NOW} + 3600000 * 2 ** r)::bigint end as available_at from (select d.*, s.paths % 4 as r from {_DNS} d join {_STATES} s using (authority))""")
def dns_retry_step(spark, sf_dir):
    states = _states(spark, sf_dir)
    attempts = fetching.resolved(states, _host_ip(spark, sf_dir)).join(states.select("authority", (F.col("paths") % 4).alias("retries")), "authority")
    return fetching.dns_step(attempts.select("authority", "ip", "retries"), NOW)


@query(f"select * from {_HOST_IP} where ts >= 50000 - 49500")
def ip_ttl(spark, sf_dir):
    return fetching.fresh_ips(_host_ip(spark, sf_dir), 50_000, 49_500)


@query(f"select host, ip, (case when host in (select {_host('authority')} from {_STATES}) then {NOW} else ts end)::bigint as ts from {_HOST_IP}")
def ip_refresh(spark, sf_dir):
    used = _states(spark, sf_dir).select(urls.host(F.col("authority")).alias("host"))
    return fetching.used_ips(_host_ip(spark, sf_dir), used, NOW)


_NAMES = [n for n, *_ in scalars.EXCEPTIONS]
_RESULTS = f"""(select event_id as id, case when event_type in ('view', 'click') then null when event_type = 'signup' then 'Unexpected' else ({[*_NAMES, 'SomethingElse']})[(event_id % {len(_NAMES) + 1} + 1)::int] end as exception,
    event_type <> 'signup' as io, case when event_id % 3 = 0 then null else ({[*_NAMES, 'SomethingElse']})[((event_id + event_id // 100 % 2) % {len(_NAMES) + 1} + 1)::int] end as last_exception, (user_id % 7)::int as retries from events)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, [*_NAMES, "SomethingElse"]))
    pick = lambda k: F.get(names, (k % (len(_NAMES) + 1)).cast("int"))
    kind, i = F.col("event_type"), F.col("event_id")
    return read(spark, sf_dir, "events").select(
        i.alias("id"), F.when(kind.isin("view", "click"), F.lit(None)).when(kind == "signup", "Unexpected").otherwise(pick(i)).alias("exception"), (kind != "signup").alias("io"),
        F.when(i % 3 == 0, F.lit(None)).otherwise(pick(i + F.floor(i / 100) % 2)).alias("last_exception"), (F.col("user_id") % 7).cast("int").alias("retries"),
    )


@query(f"""select id, outcome, (case when exception is null then 0 when not io then retries else counter end)::int as retries,
    case when outcome in ('retry', 'purge') then exception when exception is null or io then null else last_exception end as last_exception, outcome in ('retry', 'purge') as keep_path, case when outcome <> 'purge' then {NOW + 2000}::bigint end as next_fetch
    from (select *, case when exception is null then 'success' when not io then 'skip' when counter < coalesce(max_retries, 5) then 'retry' when coalesce(host_killer, false) then 'purge' else 'skip' end as outcome
        from (select r.*, case when last_exception is null then 0 when last_exception = exception then retries + 1 else retries end as counter from {_RESULTS} r) left join {_POLICY} using (exception))""")
def fetch_outcome_step(spark, sf_dir):
    return fetching.fetch_step(_results(spark, sf_dir), scalars.exception_policy(spark), NOW, 2000)


@query(f"select q.url, (case when p.url is null then 404 else 200 end)::int as status, p.html as body from (select url from pages where page_id % 2 = 0 union select url from {_NEW}) q left join pages p using (url)")
def fetch_offline(spark, sf_dir):
    t = read(spark, sf_dir, "pages")
    return fetching.offline_fetch(t.where("page_id % 2 = 0").select("url").union(frontier.new_links(t).select("url")).distinct(), t)


_PATHS = f"(select {_authority('url')} as authority, list({_path_query('url')} order by page_id) as paths from pages group by 1)"


@query(f"select authority || paths[1] as url, 200::int as status, len(paths) - 1 as left_over, {NOW + 2000}::bigint as next_fetch from {_PATHS}")
def fetch_round(spark, sf_dir):
    """A round in which every authority is visited: one page each, the rest of the queue with its next time."""
    pages = read(spark, sf_dir, "pages")
    states = frontier.visit_states(pages.select("url", F.col("page_id").alias("seq")), 1_000_000).select("authority", "path_queries")
    picked = states.select("authority", F.lit("127.0.0.1").alias("ip"))
    responses, left, _ = fetching.fetch_round(picked, states, pages, NOW, 2000, 2000)
    own = left.select("authority", F.size("path_queries").cast("bigint").alias("left_over"), "next_fetch")
    return responses.withColumn("authority", urls.authority(F.col("url"))).join(own, "authority").select("url", "status", "left_over", "next_fetch")


# ---------------------------------------------------------------- storage, statistics, seeds

@query("select url, sha256(html) as digest, url <> first_value(url) over (partition by html order by url) as is_duplicate, lower(regexp_extract(html, '(?i)charset\\s*=\\s*[\"'']?([A-Za-z0-9_-]+)', 1)) as charset from pages")
def stored_duplicates(spark, sf_dir):
    t = read(spark, sf_dir, "pages").select("url", F.col("html").alias("body"))
    return store.with_digests(t).select("url", "digest", "is_duplicate", "charset")


@query("select event_type as name, sum(user_id)::bigint as total from events group by 1")
def stats_sum(spark, sf_dir):
    return store.summed(read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("value")))


@query("select event_type as name, arg_max(user_id, event_id) as value from events group by 1")
def stats_latest(spark, sf_dir):
    return store.latest(read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("value"), F.col("event_id").alias("ts")))


@query("select count(*) as urls, sum(octet_length(encode(html)))::bigint as bytes, sum(octet_length(encode(html))) / 60.0 as bytes_per_second from pages")
def crawl_throughput(spark, sf_dir):
    return store.throughput(read(spark, sf_dir, "pages").select("url", F.col("html").alias("body")), 60)


@query("select event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(j, '\"uri\"\\s*:\\s*\"(http[^\"]*)\"', 1))), ' ') as uris from (select event_id, '{\"children\": [{\"uri\": \"http://b/' || user_id || '\"}, {\"x\": {\"uri\" : \"https://a/\"}}, {\"uri\": \"place:1\"}, {\"uri\": \"https://a/\"}], \"p\": ' || coalesce(props, 'null') || '}' as j from events)")
def bookmark_uris(spark, sf_dir):
    j = F.concat(F.lit('{"children": [{"uri": "http://b/'), F.col("user_id").cast("string"), F.lit('"}, {"x": {"uri" : "https://a/"}}, {"uri": "place:1"}, {"uri": "https://a/"}], "p": '), F.coalesce("props", F.lit("null")), F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(seeds.bookmark_uris(j), " ").alias("uris"))


@query("""select i as seq, 'http://host' || (('0x' || substr(h, 1, 7))::bigint % 100) || '.test/' || substr(h, 9, 4) || '/' || substr(h, 13, 6) as url from (select i, md5('0:' || i) as h from range(1000) t(i))""")
def synthetic_urls(spark, sf_dir):
    return seeds.synthetic_urls(spark, 1000)


@query(f"select distinct {_normalize('url')} as url from {ALL_URLS} where url <> '' order by 1")
def sorted_seeds(spark, sf_dir):
    return all_urls(spark, sf_dir).where("url != ''").select(urls.normalize(F.col("url")).alias("url")).distinct().orderBy("url")


@query("select url, 200 as status, octet_length(encode(html))::int as size, 'text/html' as kind from pages")
def stored_responses(spark, sf_dir):
    """Responses written to a new store, more of them to the same, and all read back."""
    t = read(spark, sf_dir, "pages").select("page_id", "url", F.create_map(F.lit("Content-Type"), F.lit("text/html")).alias("headers"), F.lit(200).alias("status"), F.col("html").alias("body"))
    path = rounds.scratch(spark, "store")
    for k in range(2):
        store.write_responses(t.where(F.col("page_id") % 2 == k).drop("page_id"), path, is_new=k == 0)
    return store.read_responses(spark, path).select("url", "status", F.octet_length("body").alias("size"), F.col("headers")["Content-Type"].alias("kind"))


@query(f"select {_normalize('trim(url)')} as url from {ALL_URLS} where trim(url) <> ''")
def stored_seeds(spark, sf_dir):
    """Seeds written as lines and read back in normal form."""
    path = rounds.scratch(spark, "seeds")
    seeds.write_seeds(all_urls(spark, sf_dir), path)
    return seeds.read_seeds(spark, path)


@query("select event_id, event_type, value from events")
def stored_records(spark, sf_dir):
    """Records appended in two parts as JSON lines and read back under a schema."""
    t, path = read(spark, sf_dir, "events").select("event_id", "event_type", "value"), rounds.scratch(spark, "records")
    for k in range(2):
        seeds.append_records(t.where(F.col("event_id") % 2 == k), path)
    return seeds.read_records(spark, path, "event_id bigint, event_type string, value double")


# ---------------------------------------------------------------- whole crawls

_GRAPH = "(select p_partkey as src, p_partkey * 3 + 1 as dst from part union all select p_partkey, p_partkey // 2 from part)"


@query(f"""with recursive r(url, round) using key (url) as (select 5::bigint, 0::bigint union (select e.dst, min(r.round) + 1 from r join (select distinct * from {_GRAPH} where dst in (select p_partkey from part)) e on e.src = r.url
        where e.dst not in (select url from recurring.r) group by e.dst))
    select 'http://n.test/' || url as url, round::int as round from r""")
def crawl_rounds(spark, sf_dir):
    """A crawl of a closed graph from one seed: each URL in the round that first reaches it."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    both = p.select("k", (F.col("k") * 3 + 1).alias("dst")).union(p.select("k", F.floor(F.col("k") / 2)))
    edges = both.join(p.select(F.col("k").alias("dst")).hint("merge"), "dst", "left_semi")  # a table of parts is not to be broadcast
    name = lambda c: F.concat(F.lit("http://n.test/"), F.col(c).cast("string"))
    start = spark.range(1).select(F.lit("http://n.test/5").alias("url"))
    return rounds.crawl(edges.select(name("k").alias("src"), name("dst").alias("dst")), start, CrawlConfig(max_urls=None))
