import duckdb
import numpy as np
import pytest

from fathomweb.llm import mtree


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(3000, 2)) * 100
    tree = mtree.MTree(points, page=32)
    computed = []
    for q in rng.normal(size=(20, 2)) * 100:
        d = np.sqrt(((points - q) ** 2).sum(axis=1))
        exact = lambda rows, far, d=d: [((-float(d[r]), -int(r)), float(d[r])) for r in rows]
        got = sorted((-i for _, i in tree.search(q, 5, exact, 1e-9)), key=lambda r: d[r])
        assert got == np.argsort(d)[:5].tolist()
        computed.append(tree.computed)
    assert np.mean(computed) < 700  # of 3000 and the routing objects


def brute_force(rows, k=10, every=100):
    seen = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            seen[i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)] = 1
    out = []
    for q, x in seen:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in seen if i != q and len(y) == len(x))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 40])
def test_odd_rows(spark, shard):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(310)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(400, None), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [float("nan")] * 6), (700, []), (None, [1.0] * 6), (800, [0.5] * 4), (900, [0.0] * 6), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int")
    got = sorted(tuple(r) for r in mtree.top_k(df, shard=shard, block=2, page=16).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_force(rows)
    assert mtree.top_k(df.where("false")).count() == 0


def test_small_batches_split_shards_and_queries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(900)] + [(2000 + i, [3.0] * 4) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r) for r in mtree.top_k(df, every=50, shard=150, page=16).select("query_id", "rank", "vec_id", "score").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_force(rows, every=50)


def test_query_as_sql(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(mtree.ORACLE_SQL["op4_mtree_top_k"]).fetchall()
    got = mtree.op4_mtree_top_k(spark, "/root/testdata/sf0.001").select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 50
