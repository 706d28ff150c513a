"""Exact top-k search by inner product with M-trees and best-first search.

Inner products become distances: with R^2 the greatest squared norm, a vector x gets one more
component sqrt(R^2 - |x|^2) and a query gets 0 there, so |q - x|^2 = |q|^2 + R^2 - 2 q.x, and nearest is best.

The vectors are dealt to shards of bounded size. Each shard is an M-tree (Ciaccia, Patella and
Zezula, M-tree, 1997), loaded in bulk: leaf pages of vectors, inner pages of routing objects, with
the covering radius of each subtree and each entry's distance from its page's routing object. A
search takes pages from a queue by the least distance their content can have. In a page, an
entry's distance is computed only if the stored distance to the parent does not rule it out:
|d(q, parent) - d(o, parent)| <= limit + radius. Scores of what is left are exact integers, and a
candidate is dropped only if its bound is worse than the limit by more than rounding can explain.

Queries come in blocks, each block against each shard: a shard's vectors come first, its tree is built once, and
the block's queries stream past it, so a task holds one shard and one Arrow batch of queries. The shards' best k
are merged by query. A shard travels once for 32,768 queries, so up to 3 million rows every vector travels once.

Defined results: a vector that is null, empty or holds a null or a component that isn't finite takes no
part; nor does a row without id; rows with one id and one vector count once, rows with one id and
different vectors are candidates of their own, and never for a query of that id; ties go to the smaller id;
vectors of different lengths don't meet; with fewer candidates all are returned; other columns are ignored.
Components must be below 2^20 in size, so that scores of up to 2^20 components fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Vectors of a shard, entries of a page, queries of a block.
SHARD, PAGE, BLOCK = 8192, 128, 32_768


class MTree:
    """An M-tree over the rows of ``points``, loaded in bulk from the top: each split deals the points to their nearest routing object."""

    def __init__(self, points: np.ndarray, page: int = PAGE, seed: int = 0):
        self.points, self.page = points, page
        self.rng = np.random.default_rng(seed)
        #: Pages: (is leaf, entries, distance of each entry to the routing object, covering radius of each entry).
        #: A leaf's entries are points; an inner page's are (child page, routing point).
        self.pages: list[tuple] = []
        rows = np.arange(len(points))
        self.root_point = 0
        self.root = self._load(rows, 0) if len(points) else -1

    def _far(self, rows: np.ndarray, point: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[point]) ** 2).sum(axis=1))

    def _load(self, rows: np.ndarray, routing: int) -> int:
        if len(rows) <= self.page:
            self.pages.append((True, rows, self._far(rows, routing), None, None))
            return len(self.pages) - 1
        n = min(self.page, max(2, -(-len(rows) // self.page)))
        centres = rows[self.rng.choice(len(rows), n, replace=False)]
        x, c = self.points[rows], self.points[centres]
        far = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
        owner = far.argmin(axis=1)
        children, points, radii = [], [], []
        if np.bincount(owner, minlength=n).max() == len(rows):  # all alike: cut evenly
            owner = np.arange(len(rows)) % n
        for k in np.unique(owner).tolist():
            own = rows[owner == k]
            children.append(self._load(own, int(centres[k])))
            points.append(int(centres[k]))
            radii.append(float(self._far(own, int(centres[k])).max()))
        points = np.array(points)
        self.pages.append((False, points, self._far(points, routing), np.array(radii), children))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, k: int, exact, slack: float) -> list[tuple[int, int]]:
        """The k best rows as (-score, row's rank value) by ``exact``(rows) -> list of such pairs; see the module for the bounds."""
        best: list[tuple[int, int]] = []  # heap of the worst on top: (score, -id)
        limit = np.inf
        d0 = float(np.sqrt(((q - self.points[self.root_point]) ** 2).sum())) if self.root >= 0 else 0.0
        queue = [(0.0, self.root, d0)] if self.root >= 0 else []
        self.computed = 0
        while queue:
            least, page, d_parent = heapq.heappop(queue)
            if least > limit + slack:
                break
            leaf, entries, to_parent, radii, children = self.pages[page]
            reach = limit + slack + (0 if leaf else radii)
            some = np.flatnonzero(np.abs(d_parent - to_parent) <= reach)
            if not len(some):
                continue
            self.computed += len(some)
            d = np.sqrt(((self.points[entries[some]] - q) ** 2).sum(axis=1))
            if not leaf:
                bound = np.maximum(d - radii[some], 0)
                for i, far, low in zip(some.tolist(), d.tolist(), bound.tolist()):
                    if low <= limit + slack:
                        heapq.heappush(queue, (low, children[i], far))
                continue
            near = d <= limit + slack
            for item, far in exact(entries[some[near]], d[near]):
                if len(best) < k:
                    heapq.heappush(best, (*item, far))
                elif item > best[0][:2]:
                    heapq.heapreplace(best, (*item, far))
            if len(best) == k:
                limit = max(b[2] for b in best)
        return [b[:2] for b in best]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col).cast(T.ArrayType(T.DoubleType()))
    ok = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    scaled = F.transform(x, lambda v: F.floor(v * 1024))
    return vectors.where(F.col(id_col).isNotNull()).where(ok).select(F.col(id_col).cast("bigint").alias("id"), scaled.alias("x"))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the k rows of other ids with the greatest integer inner products."""
    table = common.written(_usable(vectors, id_col, vector_col).distinct().withColumn("size", F.size("x")), "vectors")
    facts = table.groupBy("size").agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + v * v)).alias("norm"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asked"))
    facts = facts.withColumn("shards", F.ceil(F.col("n") / shard).cast("int")).withColumn("blocks", F.ceil(F.col("asked") / block).cast("int")).where("asked > 0")
    facts = common.written(facts, "facts")
    trees = facts.agg(F.sum(F.col("shards").cast("bigint") * F.col("blocks"))).first()[0] or 1
    mixed = F.xxhash64("id", "x")
    # each shard once for each block of queries, each query once for each shard
    data = table.join(facts, "size").select("size", "norm", F.pmod(mixed, F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "id", "x")
    asks = table.where(F.col("id") % every == 0).join(facts, "size").select("size", "norm", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(mixed, F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("asks"), "id", "x")

    def matrix(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        lists = rows.column("x")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows.num_rows, -1)

    def answers(tree: MTree, own: np.ndarray, own_ids: np.ndarray, asked: pa.RecordBatch) -> pa.RecordBatch:
        slack = 1e-7 * (1 + float(asked.column("norm")[0].as_py()) ** 0.5)
        out: list[tuple[int, int, int]] = []
        for q, q_id in zip(matrix(asked), asked.column("id").to_pylist()):

            def exact(found: np.ndarray, far: np.ndarray, q: np.ndarray = q, q_id: int = q_id) -> Iterator[tuple[tuple[int, int], float]]:
                scores = own[found] @ q
                for s, i, d in zip(scores.tolist(), own_ids[found].tolist(), far.tolist()):
                    if i != q_id:
                        yield (s, -i), d

            out += [(q_id, s, -i) for s, i in tree.search(np.append(q.astype(np.float64), 0.0), k, exact, slack)]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 2, 1)], names=["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard and block, a shard's vectors before its queries: the first query builds the tree, and the others pass by it."""
        key, held, tree, own, own_ids = None, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "shard", "block", "asks")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if tuple(keys[a, :3].tolist()) != key:
                    key, held, tree = tuple(keys[a, :3].tolist()), [], None
                if not keys[a, 3]:
                    held.append(part)
                    continue
                if tree is None and held:
                    rows, norm = pa.Table.from_batches(held), part.column("norm")[0].as_py()
                    own, own_ids, held = matrix(rows), rows.column("id").to_numpy(), []
                    floats = own.astype(np.float64)
                    tree = MTree(np.hstack((floats, np.sqrt(np.maximum(0.0, norm - (floats * floats).sum(axis=1)))[:, None])), page)
                if tree is not None:
                    yield answers(tree, own, own_ids, part)

    together = ("size", "shard", "block")
    # a number given by hand stays as it is: adaptive execution would merge tasks of few bytes and much work
    tasks = min(trees, max(common.shuffle_width(table.sparkSession), trees // 16))
    dealt = data.union(asks).repartition(tasks, *together).sortWithinPartitions(*together, "asks")
    found = dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of ``embeddings`` for each hundredth of its rows."""
    return top_k(common.table(spark, sf_dir, "embeddings"))


_ORACLE = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, x as y from v where vec_id % 100 = 0),
s as (select query_id, vec_id, list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2]))::bigint as score from q join v on q.query_id <> v.vec_id and len(x) = len(y)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

QUERIES = {"op4_mtree_top_k": op4_mtree_top_k}
ORACLE_SQL = {"op4_mtree_top_k": _ORACLE}
