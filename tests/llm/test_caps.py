import duckdb
import numpy as np
import pytest

from fathomweb.llm import caps


def test_list_decoding_finds_all_that_exceed():
    rng = np.random.default_rng(0)
    code = caps.ProductCode(12, 9, blocks=3)
    every = np.array([np.concatenate([code.code[0][a], code.code[1][b], code.code[2][c]]) for a in range(9) for b in range(9) for c in range(9)])
    assert np.allclose(np.linalg.norm(every, axis=1), 1)
    x = rng.normal(size=(20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for v, few, got in zip(x, code.decode(x, 0.99, 4), code.decode(x, 0.4, 1)):
        values = every @ v
        assert set(np.flatnonzero(values > 0.4)) == set(got.tolist()) or len(got) == 1
        assert set(few.tolist()) == set(np.argsort(-values)[:4].tolist())


def brute_force(rows, cosine=0.98):
    seen = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            seen[i] = (np.array(v, dtype=np.float32).astype(float), label)
    ids = sorted(seen)
    root, links = {i: i for i, *_ in rows if i is not None}, dict.fromkeys(root_ids := [i for i, *_ in rows if i is not None], 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        x, lx = seen[a]
        for b in ids[:k]:
            y, ly = seen[b]
            if lx == ly and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    del root_ids
    return sorted((-1, 0, -1, True) if i is None else (i, links[i], find(i), find(i) == i) for i, *_ in rows)


def got(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("block", [512, 16])
def test_odd_rows_and_large_groups(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 1, 2, 3, 90, 150):
        centre = rng.normal(size=24)
        for _ in range(size):
            x = centre + rng.normal(size=24) * 0.11 * rng.random()
            rows.append((len(rows) * 11 % 499, x.astype(np.float32).tolist(), int(len(rows) % 40 == 0)))
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [None, 1.0], 1), (2004, rows[5][1], None), (None, rows[5][1], 0), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1), rows[4]]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id bigint, embedding array<float>, label int, n_links int")
    assert got(caps.linked_vectors(df, block=block)) == brute_force(rows)
    assert caps.linked_vectors(df.where("false")).count() == 0


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    near = [(base + rng.normal(size=16) * 0.02).astype(np.float32).tolist() for _ in range(4)]
    rows = [(i * 7 % 401, near[min(3, i % 9)], 1) for i in range(300)] + [(900 + i, near[0], 2) for i in range(5)] + [(950, near[1], None), (951, near[1], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert got(caps.linked_vectors(df, block=16)) == brute_force(rows)
    one = [(1, near[0], 1), (1, near[1], 1), (2, near[0], 1), (3, near[0], 1)]  # an id with two vectors: its links add up
    out = {r.vec_id: (r.n_links, r.component_id) for r in caps.linked_vectors(spark.createDataFrame(one, df.schema)).collect()}
    assert out == {1: (6, 1), 2: (3, 1), 3: (3, 1)}


def test_query_as_sql(spark):
    where = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{where}/embeddings.parquet'")
    want = con.execute(caps.ORACLE_SQL["op7_spherical_caps"]).fetchall()
    assert got(caps.op7_spherical_caps(spark, where)) == sorted(want)
