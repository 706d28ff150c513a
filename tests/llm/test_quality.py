import zlib

import numpy as np
import pytest

from fathomweb.llm import common, quality


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(rng.normal(size=40), rng.normal(size=(40, 5)))
    index, value = rng.permutation(40)[:9], rng.normal(size=9)
    pairs = sum(m.v[index[a]] @ m.v[index[b]] * value[a] * value[b] for a in range(9) for b in range(a))
    assert m.raw(index, value) == pytest.approx(m.w[index] @ value + pairs)


def test_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 2))
    rows = [(np.array([0, 1 + a, 3 + b]), np.ones(3)) for a, b in x.tolist()]
    y = (x[:, 0] != x[:, 1]).astype(float)
    m = quality.Machine.new(5, 4)
    m.fit(rows, y, epochs=30)
    assert np.mean([(m.score(*r) >= 0.5) == t for r, t in zip(rows, y)]) == 1


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op6_quality_classifier(spark, where).collect()}
    labels = {r.doc_id: r.quality for r in common.table(spark, where, "labels").collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (d in held) for d in labels)
    assert np.mean([got[d].predicted == labels[d] for d in held]) > 0.95


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "some text"), (3, "word " * 50_000), (1, None)]
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id bigint, text string, score int, lang string")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality.score(docs.where("false"), quality.train(docs.where("false"), labels)).count() == 0


def test_bound_of_the_sample(spark, monkeypatch):
    """The driver gets at most ``sample`` rows, however many rows share an id; columns may have any names."""
    docs = spark.createDataFrame([(i if i < 300 else 7, f"word{i} text", "x", "y") for i in range(1500)], ["doc_id", "text", "quality", "a.b"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    got, features_of = [], quality._features_of
    monkeypatch.setattr(quality, "_features_of", lambda texts, slots: got.append(texts.count()) or features_of(texts, slots))
    quality.train(docs, labels, sample=100)
    assert got == [100]
    kept = quality.accepted(docs, labels, threshold=0.0)
    assert kept.schema == docs.schema and kept.count() == 1500
