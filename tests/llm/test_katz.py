import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathomweb.llm import katz


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), None]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class Model:
    """The definitions, one word at a time."""

    def __init__(self, texts):
        self.one, self.two, self.past = Counter(), Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.one.update(w)
            self.two.update(zip(["<begin>", *w], w))
            self.past.update(["<begin>", *w[:-1]])
        self.n = sum(self.one.values())
        self.d1, self.d2 = (katz.Discounts(self.counts(c)) for c in (self.one, self.two))
        self.left = 1 - sum(float(self.d1(c)) * c / self.n for c in self.one.values()) if self.n else 1.0
        self.followers = defaultdict(list)
        for (u, w), c in self.two.items():
            self.followers[u].append((w, c))

    @staticmethod
    def counts(counter):
        n = np.zeros(4096)
        for c, k in Counter(counter.values()).items():
            n[c] = k
        return n

    def p1(self, w):
        c = self.one[w]
        return float(self.d1(c)) * c / self.n if c else self.left

    def p(self, w, u):
        c = self.two[u, w]
        if c:
            return float(self.d2(c)) * c / self.past[u]
        if not self.past[u]:
            return self.p1(w)
        mass = sum(c * (1 - float(self.d2(c))) for _, c in self.followers[u]) / self.past[u]
        return mass / (1 - sum(self.p1(x) for x, _ in self.followers[u])) * self.p1(w)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(x, u)) for u, x in zip(["<begin>", *w], w))


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    return [(i, " ".join(rng.choice(words, int(rng.integers(0, 40)), p=p / p.sum())).replace("w1 ", "W1\t")) for i in range(n)]


def compared(got, rows):
    model = Model([t for d, t in rows if not held_out(d)])
    v = len(model.one)
    want = []
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10((model.one[x] + 1) / (model.n + v + 1)) for x in w)
        want.append((-1 if d is None else d, held_out(d), len(w), sum(model.one[x] > 0 for x in w), model.n, base, model.score(t)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_distributions_sum_to_one():
    model = Model([t for d, t in corpus(0, 60)])
    known = [*model.one, "never seen"]
    for u in ["<begin>", "w0", "w7", "w59", "never seen"]:
        assert sum(model.p(w, u) for w in known) == pytest.approx(1)


def test_scores_as_defined(spark, monkeypatch):
    rows = corpus(1, 150) + [(500, None), (501, ""), (None, "w1 w2"), (502, "w0 " * 3000), (502, "w0 w9"), (502, "w0 w9"), (503, "new words only here")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id bigint, text string, score double").repartition(5)
    compared(katz.score_documents(docs).collect(), rows)


def test_counts_beyond_4096_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(Model, "counts", staticmethod(lambda counter: np.bincount([*counter.values()])))
    rows = corpus(3, 60) + [(601, "w0 " * 5000), (602, "w1 w2 " * 3000)]
    assert not held_out(601) and not held_out(602)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    compared(katz.score_documents(docs).collect(), rows)


def test_small_chunks_and_spread_words(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 100)
    rows = corpus(2, 80)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    prepared = katz._prepared(docs, 7, 2)
    assert len(katz.unigrams(prepared, 4).spread) > 0
    compared(katz.score_documents(docs).collect(), rows)


def test_no_training_rows(spark):
    rows = [(d, "a b a") for d in range(200) if held_out(d)][:5]
    compared(katz.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), rows)
    assert katz.score_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_better_than_the_base(spark):
    got = katz.op1_katz_backoff(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_packing_of_arrays():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.empty(0, dtype=np.uint8), np.array([1.5, -2.5]), np.array([7], dtype=np.uint16)]
    for a, b in zip(arrays, katz._unpack(katz._pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()


def test_texts_counted_below_many_frequent_words(spark):
    rows = [(i, " ".join(f"w{j} w{j}" for j in range(300))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = sum(not held_out(i) for i in range(5))
    assert katz.unigrams(katz._prepared(docs, 7, 2), 1).texts == train
