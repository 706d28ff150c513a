import random

import pytest

from fathomweb.config import CrawlConfig
from fathomweb.functions import scalars
from fathomweb.operators import fetching, frontier, scheduler, sieve, store
from fathomweb.plans import rounds
from fathomweb.sources import seeds
from fathomweb.streaming import sieve as streaming


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_flushes(spark):
    keys = [(1, i, k) for i, k in enumerate("A0 A1 A0 A2".split())] + [(2, 10 + i, k) for i, k in enumerate("A5 A0 A6 A1 A6 A7".split())]
    got = sieve.two_flushes(spark.createDataFrame(keys, "flush int, seq int, key string")).orderBy("seq").collect()
    assert [r.key for r in got if r.flush == 1] == ["A0", "A1", "A2"] and [r.key for r in got if r.flush == 2] == ["A5", "A6", "A7"]


def test_sieve_is_a_set_difference_however_it_is_cut(spark):
    rng = random.Random(5)
    keys = [(i, f"A{rng.randrange(60)}") for i in range(300)]
    df = spark.createDataFrame(keys, "seq int, url string")
    seen = df.select("url").where("false")
    emitted = []
    for a, b in ((0, 120), (120, 121), (121, 300)):
        out = sieve.flush(df.where(f"seq >= {a} and seq < {b}"), seen)
        emitted += rows(out.select("url", "seq"))
        seen = sieve.with_history(out, seen)
    first = {}
    for i, k in keys:
        first.setdefault(k, i)
    assert sorted(emitted) == sorted(first.items())
    assert sieve.consistent(seen).first().consistent


def test_stream_sieve_as_batch(spark, tmp_path):
    urls = [(i, f"http://h{i * 7 % 20}/") for i in range(100)]
    spark.createDataFrame(urls, "seq int, url string").repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq int, url string").parquet(f"{tmp_path}/in")
    got = []
    q = streaming.run_available(streaming.unseen_stream(stream), lambda df, _: got.extend(r.url for r in df.collect()), f"{tmp_path}/check")
    q.awaitTermination(120)
    assert sorted(got) == sorted({u for _, u in urls})


def test_stream_retry_as_batch(spark, tmp_path):
    attempts = [("a", True), ("b", True), ("b", True), ("b", True), ("c", True), ("c", False)]
    df = spark.createDataFrame(attempts, "authority string, failed boolean")
    df.write.parquet(f"{tmp_path}/in")
    got = {}
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streaming.run_available(streaming.retry_stream(stream), lambda d, _: got.update({r.authority: r.outcome for r in d.collect()}), f"{tmp_path}/check", "complete")
    q.awaitTermination(120)
    assert got == {"a": "delay", "b": "drop", "c": "add"} == {r.authority: r.outcome for r in streaming.retry_stream(df).collect()}


def test_workbench_order(spark):
    """One visit per ip: after the three heads nothing is ready until an ip is free again."""
    now = 1000
    states = spark.createDataFrame([("a.test", "1", now + 300, 2), ("b.test", "2", now + 200, 2), ("c.test", "3", now + 400, 2), ("d.test", "2", now + 500, 2)], "authority string, ip string, next_fetch bigint, paths int")
    entries = spark.createDataFrame([(i, 0, False) for i in "123"], "ip string, next_fetch bigint, busy boolean")
    assert scheduler.peek(states, entries, now).count() == 0
    picked = []
    for at in (200, 300, 400):
        p = scheduler.peek(states, entries, now + at)
        picked.append(p.first().authority)
        entries = scheduler.popped(entries, p)
    assert picked == ["b.test", "a.test", "c.test"]
    assert scheduler.peek(states, entries, now + 10_000).count() == 0
    again = spark.createDataFrame([("b.test", "2", now + 700, 2, True)], "authority string, ip string, next_fetch bigint, paths int, locked boolean")
    s2, e2 = scheduler.added(states, entries, again)
    assert scheduler.peek(s2, e2, now + 500).first().authority == "d.test"
    s3, e3 = scheduler.purged(states, entries, again)
    assert scheduler.peek(s3, e3, now + 500).first().authority == "d.test" and s3.count() == 3
    s4, e4 = scheduler.purged(states.where("ip = '1'"), entries.where("ip = '1'"), states.where("ip = '1'"))
    assert s4.count() == 0 and e4.count() == 0


def test_routing(spark):
    ready = spark.createDataFrame([(1, "https://full.test/a/b/"), (2, "https://known.test/get"), (3, "https://new.test/"), (4, "https://new.test/about/")], "seq int, url string")
    counts = spark.createDataFrame([("https://full.test", 3)], "authority string, n bigint")
    registered = spark.createDataFrame([("https://known.test",)], "authority string")
    routed = frontier.routed(ready, counts, registered, 3)
    assert [r.route for r in routed.orderBy("seq").collect()] == ["drop", "spool", "new", "new"]
    state = frontier.visit_states(routed.where("route = 'new'")).collect()
    assert [(r.authority, r.path_queries) for r in state] == [("https://new.test", ["/", "/about/"])]


@pytest.mark.parametrize("exception, most, killer", [(n, m, k) for n, _, m, k in scalars.EXCEPTIONS] + [("Other", 5, False)])
def test_outcomes(spark, exception, most, killer):
    cases = [(i, exception, True, last, r) for i, (last, r) in enumerate((x, r) for x in (None, exception, "Another") for r in range(6))]
    df = spark.createDataFrame(cases, "id int, exception string, io boolean, last_exception string, retries int")
    for r in fetching.fetch_step(df, scalars.exception_policy(spark), 0, 2000).collect():
        _, _, _, last, before = cases[r.id]
        counter = 0 if last is None else before + 1 if last == exception else before
        assert r.retries == counter
        assert r.outcome == ("retry" if counter < most else "purge" if killer else "skip")


def test_resolving(spark):
    states = spark.createDataFrame([(f"http://{h}",) for h in ("a.test", "localhost:80", "10.0.0.1", "10.0.0.256", "cafe", "b.test")], "authority string")
    table = spark.createDataFrame([("a.test", "1.1.1.1"), ("localhost", "9.9.9.9")], "host string, ip string")
    got = {r.host: r.ip for r in fetching.resolved(states, table).collect()}
    assert got == {"a.test": "1.1.1.1", "localhost": "9.9.9.9", "10.0.0.1": "10.0.0.1", "10.0.0.256": None, "cafe": None, "b.test": None}
    assert fetching.resolved(states, table.where("false")).where("host = 'localhost'").first().ip == "127.0.0.1"


def test_cookies_below_the_limit(spark):
    df = spark.createDataFrame([("o", i, "n", "v" * n, None, "/") for i, n in enumerate((3, 3, 2, 1))], "owner string, pos int, name string, value string, domain string, path string")
    assert [r.pos for r in frontier.limited_cookies(df, 10).collect()] == [0]
    assert sorted(r.pos for r in frontier.limited_cookies(df, 11).collect()) == [0, 1]


def test_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    df = spark.createDataFrame([(f"u{i}", {"k": "v"}, 200, "<p>é") for i in range(200)], "url string, headers map<string,string>, status int, body string")
    with pytest.raises(FileNotFoundError):
        store.write_responses(df, path, is_new=False)
    store.write_responses(df, path, is_new=True)
    store.write_responses(df, path, is_new=False)
    assert store.read_responses(spark, path).count() == 400
    with pytest.raises(Exception, match="(?i)exist"):
        store.write_responses(df, path, is_new=True)
    assert store.throughput(df, 2).first().bytes_per_second == 200 * 5 / 2


def test_seeds(spark, tmp_path):
    df = spark.createDataFrame([("HTTP://A.test/x/../y",), ("https://b.test",)], "url string")
    seeds.write_seeds(df, f"{tmp_path}/seeds")
    assert rows(seeds.read_seeds(spark, f"{tmp_path}/seeds")) == [("http://a.test/y",), ("https://b.test",)]
    assert rows(seeds.synthetic_urls(spark, 50)) == rows(seeds.synthetic_urls(spark, 50).repartition(3))
    seeds.append_records(df, f"{tmp_path}/records")
    seeds.append_records(df, f"{tmp_path}/records")
    assert seeds.read_records(spark, f"{tmp_path}/records", "url string").count() == 4


def test_rounds_stop(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "src string, dst string")
    start = spark.createDataFrame([("0",)], "url string")
    assert rows(rounds.crawl(edges, start, CrawlConfig(max_urls=None))) == [(str(i), i) for i in range(10)]
    assert rounds.crawl(edges, start, CrawlConfig(max_urls=2)).count() == 3
    session = rounds.Crawl(spark, CrawlConfig())
    session.stop()
    assert session.run(edges, start).count() == 1


def test_crawl_goes_on_until_nothing_is_new(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(53)], "src string, dst string").coalesce(1)
    start = spark.createDataFrame([("0",)], "url string")
    assert rounds.Crawl(spark, CrawlConfig(max_urls=None)).run(edges, start).count() == 54


@pytest.mark.parametrize("sent", [0, 450, 1 << 20])
def test_crawl_broadcasts_what_is_small(spark, monkeypatch, sent):
    """Neither a front nor what has been visited is broadcast beyond ``SENT`` bytes, however small its files are; the result is the same."""
    pairs = [(i, j) for i in range(60) for j in (3 * i + 1, 3 * i + 2, i // 2) if j < 60]
    edges, start = spark.createDataFrame([(str(i), str(j)) for i, j in pairs], "src string, dst string").coalesce(1), spark.createDataFrame([("5",)], "url string")
    plans, written = [], rounds._written
    monkeypatch.setattr(rounds, "SENT", sent, raising=False)
    monkeypatch.setattr(rounds, "_written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    got = rows(rounds.crawl(edges, start, CrawlConfig(max_urls=None)))
    want, front = {5: 0}, {5}
    while front:
        front = {j for i, j in pairs if i in front} - set(want)
        want |= dict.fromkeys(front, max(want.values()) + 1)
    assert got == sorted((str(i), k) for i, k in want.items())
    assert any("BroadcastExchange" in plan for plan in plans) == (sent > 0)
