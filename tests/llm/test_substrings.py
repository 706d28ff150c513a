import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from fathomweb.llm import common, substrings


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_force(rows, window=35):
    docs = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, docs):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if doc_id is None else doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def fixture(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passages = [" ".join(rng.choice(vocabulary, size)) for size in (20, 34, 35, 36, 50, 90)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(3)]
        parts.insert(1, passages[int(rng.integers(0, len(passages)))])
        rows.append((i, "\n ".join(parts)))
    rows += [(900 + i, "the " * k) for i, k in enumerate((34, 35, 36, 100))] + [(910, "a b c " * 30), (911, "x " + "a b c " * 30)]
    rows += [(920, "A " * 40), (921, "a " * 20), (930, passages[4]), (930, passages[4]), (931, None), (932, ""), (None, passages[5]), (933, " \t")]
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_as_brute_force(spark, hot):
    rows = fixture(1, 80)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int").repartition(3)
    assert got(substrings.removed_digests(df, hot=hot)) == brute_force(rows)


def test_texts_without_repeats(spark):
    rows = fixture(2, 10)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string")
    out = substrings.without_repeats(df)
    assert out.columns == df.columns
    want = Counter((d, h) for d, _, n, h in brute_force(rows) if n)
    texts = Counter((-1 if r.doc_id is None else r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect())
    assert not want - texts and sum(texts.values()) == len(rows)
    assert sum(texts[(-1 if d is None else d, hashlib.sha256((t or "").encode()).hexdigest())] > 0 for d, t in rows) >= len(rows) - sum(want.values())


def test_query_and_empty_table(spark, tmp_path):
    where = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.table(spark, where, "documents").collect()]
    assert got(substrings.op10_substring_dedup(spark, where)) == brute_force(rows)
    assert substrings.removed_digests(common.table(spark, where, "documents").where("false")).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_clashing_names(spark, hot):
    rows = fixture(3, 12)
    names = ["a", "b", "ranges", "_own", "_id", "_hash", "_kept", "start", "end", "copies", "cold", "hot", "packed", "a.b", "n_chars"]
    df = spark.createDataFrame([(*r, *(f"{i}-{n}" for n in names[:-1]), len(r[1] or "")) for i, r in enumerate(rows)], ["doc_id", "text", *names])
    out = substrings.without_repeats(df, hot=hot)
    assert out.schema == df.schema
    got = {r["_own"]: r for r in out.collect()}
    want = {(d, h): n for d, _, n, h in brute_force(rows)}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        r = got[f"{i}-_own"]
        assert all(r[n] == f"{i}-{n}" for n in names[:-1]) and r.doc_id == d
        if r.text == t:
            assert r.n_chars == len(t or "")
        else:
            assert want[(-1 if d is None else d, hashlib.sha256(r.text.encode()).hexdigest())] and r.n_chars == len(r.text)
