import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from fathomweb.llm import common, neardup
from fathomweb.llm.components import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_force(rows, k, percent=80):
    """doc_id -> (sizes, component), by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    where = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is not None:
            for x in s:
                where[x].append(i)
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    both = Counter(p for x in where.values() for p in combinations(x, 2))
    for (i, j), n in both.items():
        if 100 * n >= percent * (len(sets[i][1]) + len(sets[j][1]) - n):
            a, b = sorted((find(sets[i][0]), find(sets[j][0])))
            root[b] = a
    return sorted((d if d is not None else -1, len(s), find(d) if d is not None else -1, d is None or find(d) == d) for d, s in sets)


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1, r.kept) for r in df.collect())


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i + 1, i) for i in range(40)] + [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 60, (30, 2))] + [(7, 7), (3, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in root}
    assert components(df.where("false")).count() == 0


def test_signature_estimates_similarity():
    one = neardup.OnePermutation(5, 32)
    rng = np.random.default_rng(2)
    for n in (5, 40, 1000):
        same = []
        for _ in range(60):
            x = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            y = np.sort(np.concatenate((x[n // 5 :], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64) * np.uint64(2))))
            same.append((one.signature(x) == one.signature(y)).mean())
        assert abs(np.mean(same) - (n - n // 5) / (n + n // 5)) < 0.07


@pytest.mark.parametrize("k", [2, 5])
def test_chains_as_brute_force(spark, k):
    """Long chains of edits and mixed buckets: the links between neighbours must all be found."""
    rng = np.random.default_rng(k)
    rows, words = [], [f"w{i}" for i in range(400)]
    for chain in range(6):
        text = list(rng.choice(words, 60))
        for _ in range(25):
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
            text[rng.integers(0, 60)] = str(rng.choice(words))
            if rng.random() < 0.4:
                text.insert(int(rng.integers(0, 60)), str(rng.choice(words)))
                text = text[:60]
    rows += [(2000 + i, "same text of all these copies HERE") for i in range(30)] + [(3000, "Same TEXT of all these copies here"), (3001, "one"), (3002, "ONE"), (3003, "two words"), (3004, "two")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(neardup.near_duplicates(df, k)) == brute_force(rows, k)


def test_links_within_a_large_mixed_group(spark):
    """A passage shared by all, 0.75 among each other; a few pairs at 0.81 that meet in no bucket of their own."""
    rng = np.random.default_rng(5)
    template, rows = [f"t{i}" for i in range(87)], []
    for i in range(700):
        fill = [f"f{i}x{j}" for j in range(14)]
        rows.append((len(rows), " ".join(template + fill)))
        if i % 20 == 0:
            rows.append((len(rows), " ".join(template + fill[:5] + [f"g{i}x{j}" for j in range(9)])))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute_force(rows, 1)
    assert sum(not kept for *_, kept in want) == 35
    assert got(neardup.near_duplicates(df, 1, rows=1, bands=4)) == want


def test_odd_rows(spark):
    long = " ".join(f"x{i % 1700}y{i % 13}" for i in range(60_000))
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, long, 5), (5, long + " more", 5), (4, long, 5), (6, "a b c d e f g h i j", None), (None, "a b c d e f g h i j", 1), (7, "a b c d e f g h i j", 1), (8, "É b", 2), (9, "é b", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int")
    assert got(neardup.near_duplicates(df, 2)) == brute_force([r[:2] for r in rows], 2)
    assert neardup.near_duplicates(df.where("false"), 2).count() == 0


def test_repeated_ids(spark):
    rows = [(9, "a b c d e"), (9, "p q r s t"), (9, ""), (3, "P q r s t"), (5, "a b c d e"), (7, "u v w"), (7, "u v w"), (None, "u v w"), (None, "u v w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(neardup.near_duplicates(df, 2)) == brute_force(rows, 2)
    left = [(r.doc_id, r.text) for r in neardup.without_near_duplicates(df, 2).collect()]
    assert sorted(left, key=str) == sorted([(3, "P q r s t"), (7, "u v w"), (None, "u v w"), (None, "u v w")], key=str)


def test_query_as_brute_force(spark):
    where = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.table(spark, where, "documents").collect()]
    assert got(neardup.op9_minhash_near_dedup(spark, where)) == brute_force(rows, 2)


def test_pairs_within_a_large_group(spark):
    """3000 documents that share 76 % with each other; only 1500 pairs of them are linked, at 0.819."""
    common_part = [f"t{i}" for i in range(194)]
    rows = [(p * 2 + side, " ".join([*common_part, *(f"p{p}w{i}" for i in range(8)), *(f"p{p}s{side}w{i}" for i in range(22))])) for p in range(1500) for side in range(2)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got(found) == sorted((d, 220, d - d % 2, d % 2 == 0) for d, _ in rows)


def test_reads_keep_no_large_buffers(spark, tmp_path):
    """A row group's texts are 24 MB; none of the JVM's threads may keep them outside the heap when the work is done."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.bytes(6_000).hex()) for i in range(2000)]
    where = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.option("compression", "none").parquet(where)
    jvm = spark.sparkContext._jvm
    kind = jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")

    def direct():
        return sum(x.getMemoryUsed() for x in jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(kind) if x.getName() == "direct")

    before = direct()
    assert neardup.near_duplicates(spark.read.parquet(where)).where("kept").count() == len(rows)
    assert direct() - before < 12_000_000
