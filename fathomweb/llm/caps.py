"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a direction and the cap of vectors whose inner product with it exceeds a threshold
(Becker, Ducas, Gama and Laarhoven, New directions in nearest neighbor searching, 2016). Directions
are concatenations of one code word per block of coordinates, so all filters that a vector exceeds
are found block by block, without trying every direction: a partial sum goes on only if the best of
the blocks left can still lift it above the threshold. The threshold is set from the number of rows, so that a
cap holds a fixed number of unrelated vectors; a vector that exceeds few filters takes its best ones.

Equal vectors of a label are one class, counted before anything is compared: its members are linked with
each other, and with all members of a class that theirs is linked with, so copies cost nothing but their rows.

Classes of one label that share a filter meet in a bucket. Large buckets are cut into blocks, and
every pair of blocks is a task of its own, so no group is collected whole. In a block, cosines are
computed as one matrix product in double precision, and a pair counts in the first filter that
both of its vectors have. A bucket gives the number of links of each class and a spanning forest of its
links, never its pairs; the forests are merged to components.

Defined results: vectors that are null, empty or zero, or hold a null or a component that isn't finite,
have no links; nor have vectors with a null label; vectors of different lengths don't meet; rows without
id have no links and component null, and are kept; equal rows count once, and other rows that share an id are one vector, linked if any of them is,
whose n_links adds up; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

#: Unrelated vectors that a cap should hold; filters that a vector should exceed, and the fewest it takes; rows of a block.
OCCUPANCY, LISTED, LEAST, BLOCK = 6, 28, 14, 512


class ProductCode:
    """``words`` unit code words in each of ``blocks`` blocks; a direction is one of each, scaled to length 1."""

    def __init__(self, dimension: int, words: int, blocks: int = 2, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.cuts = np.linspace(0, dimension, min(blocks, dimension) + 1).astype(int)
        self.blocks = len(self.cuts) - 1
        self.words = words
        made = [rng.normal(size=(words, b - a)) for a, b in zip(self.cuts, self.cuts[1:])]
        self.code = [c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(self.blocks) for c in made]

    def decode(self, unit: np.ndarray, threshold: float, least: int) -> list[np.ndarray]:
        """For each unit vector the sorted filters it exceeds, or its ``least`` best ones."""
        sums = [unit[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.code)]
        out = []
        for row in range(len(unit)):
            own = [s[row] for s in sums]
            limit = threshold
            found = self._exceeding(own, limit)
            while len(found) < least and limit > -1.0:  # lower the threshold until enough exceed it
                limit -= 0.04
                found = self._exceeding(own, limit)
                if len(found) >= least:
                    value = sum(s[(found // self.words ** (self.blocks - 1 - j)) % self.words] for j, s in enumerate(own))
                    found = found[np.argsort(-value, kind="stable")[:least]]
            out.append(np.sort(found))
        return out

    def _exceeding(self, own: list[np.ndarray], limit: float) -> np.ndarray:
        rest = np.append(np.cumsum([s.max() for s in own][::-1])[::-1][1:], 0.0)
        value, name = np.zeros(1), np.zeros(1, dtype=np.int64)
        for s, more in zip(own, rest):
            grid = value[:, None] + s[None, :]
            at, word = np.nonzero(grid + more > limit)
            value, name = grid[at, word], name[at] * self.words + word
        return name


def _usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    if not isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType):
        x = x.cast(T.ArrayType(T.DoubleType()))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(x) > 0) & fine, F.lit(False))
    return vectors.where(ok).select("vec_id", F.col("label").cast("string").alias("label"), x.alias("x"))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; no square overflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _listed(table: DataFrame, plans: dict[int, tuple[int, float]], least: int) -> DataFrame:
    """(row, filters) of each usable row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {n: ProductCode(n, words) for n, (words, _) in plans.items()}
        for batch in rows:
            if not batch.num_rows:
                continue
            x = batch.column(1)
            sizes = np.diff(x.offsets.to_numpy())
            flat = x.flatten().to_numpy()
            begin = np.cumsum(sizes) - sizes
            filters: list = [None] * len(sizes)
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                for i, f in zip(at.tolist(), codes[n].decode(_unit(flat[begin[at][:, None] + np.arange(n)]), plans[n][1], least)):
                    filters[i] = f
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(filters, pa.list_(pa.int64()))], names=["row", "filters"])

    return table.select("row", "x").mapInArrow(run, "row bigint, filters array<bigint>")


def _bucket_links(members: DataFrame, cosine: float) -> DataFrame:
    """(row, other, n): n links of a row found in a bucket (other null), counted by the ``weight`` of what it links with, or a link (n null) of the bucket's spanning forest."""

    def one(x: np.ndarray, rows: np.ndarray, weight: np.ndarray, filters: list[np.ndarray], side: np.ndarray, blocks: tuple[int, int]) -> list[tuple]:
        left = np.flatnonzero(side == blocks[0])
        right = np.flatnonzero(side == blocks[1])
        linked = x[left] @ x[right].T >= cosine
        if blocks[0] == blocks[1]:
            linked = np.triu(linked, 1)
        a, b = np.nonzero(linked)
        if not len(a):
            return []
        used = np.unique(np.concatenate((left[a], right[b])))
        place = np.full(len(rows), -1)
        place[used] = np.arange(len(used))
        earlier = [filters[i] for i in used.tolist()]
        names, inverse = np.unique(np.concatenate(earlier), return_inverse=True)
        has = np.zeros((len(used), max(1, len(names))), dtype=np.float32)
        has[np.repeat(np.arange(len(used)), [len(e) for e in earlier]), inverse] = 1
        pl, pr = place[left[a]], place[right[b]]
        if len(a) > 4 * len(used):
            new = (has @ has.T)[pl, pr] == 0
        else:
            new = np.einsum("ij,ij->i", has[pl], has[pr]) == 0
        counts = np.zeros(len(used), dtype=np.int64)
        np.add.at(counts, pl[new], weight[right[b]][new])
        np.add.at(counts, pr[new], weight[left[a]][new])
        out = [(int(rows[used[i]]), None, int(counts[i])) for i in np.flatnonzero(counts).tolist()]
        # a spanning forest: each vector points to the least it is linked to, until nothing changes
        root = np.arange(len(used))
        pl, pr = pl[new], pr[new]
        while len(pl):
            low = np.minimum(root[pl], root[pr])
            before = root.copy()
            np.minimum.at(root, root[pl], low)
            np.minimum.at(root, root[pr], low)
            root = root[root]
            if (root == before).all():
                break
        out += [(int(rows[used[i]]), int(rows[used[r]]), None) for i, r in enumerate(root.tolist()) if i != r]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def worked(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "first", "second")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            cuts = [0, *change.tolist(), table.num_rows]
            out: list[tuple] = []
            rows, weight, side = table.column("row").to_numpy(), table.column("weight").to_numpy(), table.column("side").to_numpy()
            xs, fs = table.column("x").combine_chunks(), table.column("filters").combine_chunks()
            flat, start = xs.flatten().to_numpy(), xs.offsets.to_numpy() - xs.offsets.to_numpy()[0]
            names, name_start = fs.flatten().to_numpy(), fs.offsets.to_numpy() - fs.offsets.to_numpy()[0]
            for a, b in zip(cuts, cuts[1:]):
                if b - a < 2:
                    continue
                x = _unit(flat[start[a] : start[b]].reshape(b - a, -1))
                filters = [names[name_start[i] : name_start[i + 1]] for i in range(a, b)]
                out += one(x, rows[a:b], weight[a:b], filters, side[a:b], (int(keys[1][a]), int(keys[2][a])))
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["row", "other", "n"])

        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else ()), batch])
            if held.num_rows < 8000:
                continue
            keys = [held.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "first", "second")]
            other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            if len(other):
                whole = int(other[-1]) + 1
                yield worked(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield worked(held)

    return members.select("bucket", "first", "second", "side", "row", "weight", "x", "filters").mapInArrow(run, "row bigint, other bigint, n bigint")


def linked_vectors(vectors: DataFrame, cosine: float = 0.98, occupancy: int = OCCUPANCY, listed: int = LISTED, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    usable = common.written(_usable(vectors).distinct(), "vectors")
    classes = usable.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    table = common.written(classes.withColumn("row", F.monotonically_increasing_id()), "classes")
    # by dimension: code words so that a label's caps hold ``occupancy`` rows, and the threshold that this share of directions exceeds
    plans = {}
    for r in table.groupBy(F.size("x").alias("size"), "label").agg(F.count("*").alias("n")).groupBy("size").agg(F.max("n").alias("n")).collect():
        share = min(0.02, max(1e-9, occupancy / max(1, r.n)))
        words = max(4, round((listed / share) ** 0.5))
        plans[r["size"]] = (words, -NormalDist().inv_cdf(share) / r["size"] ** 0.5)
    filters = common.written(_listed(table, plans, least), "filters")
    own = table.select("row", F.xxhash64("label", F.size("x")).alias("own"))
    one = filters.join(own, "row").select("row", "own", F.posexplode("filters").alias("earlier", "filter")).withColumn("bucket", F.xxhash64("own", "filter"))
    sizes = one.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    dealt = one.join(sizes, "bucket").withColumn("side", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("row", "bucket", F.least("side", "with").alias("first"), F.greatest("side", "with").alias("second"), "side", "filter", "earlier")
    # a class's vector and those of its filters that come before this one travel once for each filter and pair of blocks
    dealt = dealt.join(table.select("row", "weight", "x").join(filters, "row"), "row").withColumn("filters", F.slice("filters", F.lit(1), F.col("earlier")))
    tasks = dealt.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    found = common.written(_bucket_links(tasks, cosine), "found")
    counts = found.where("n is not null").groupBy("row").agg(F.sum("n").alias("n_links"))
    # two written tables, so adaptive execution can split the join where a class has many members
    members = common.written(usable.join(table, ["label", "x"]).select("vec_id", "row", "least", "weight"), "members")
    least = table.select("row", "least")
    between = (
        found.where("other is not null").select("row", "other").distinct().join(least, "row").select("other", F.col("least").alias("u"))
        .join(least.withColumnRenamed("row", "other"), "other").select("u", F.col("least").alias("v"))
    )
    within = members.where("vec_id != least").select(F.col("vec_id").alias("u"), F.col("least").alias("v"))
    of = components(between.union(within)).select(F.col("node").alias("vec_id"), "component")
    own_links = F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1
    links = members.join(common.written(counts, "counts"), "row", "left").groupBy("vec_id").agg(F.sum(own_links).alias("n_links"))
    kind = dict(vectors.dtypes)["vec_id"]
    out = vectors.select("vec_id").join(links, "vec_id", "left").join(of, "vec_id", "left")
    component = F.coalesce("component", "vec_id").cast(kind)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, linked within labels at a cosine of 0.98."""
    return linked_vectors(common.table(spark, sf_dir, "embeddings"))


_ORACLE = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings
    where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (select a.vec_id as u, b.vec_id as w from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.98),
n as (select u, count(*) as n_links from e group by u),
r as (select vec_id as u, vec_id as c from embeddings union select e.w, r.c from r join e on e.u = r.u),
m as (select u, min(c) as c from r group by u)
select vec_id, coalesce(n_links, 0)::bigint as n_links, c as component_id, vec_id = c as kept
from embeddings left join n on vec_id = n.u join m on vec_id = m.u
"""

QUERIES = {"op7_spherical_caps": op7_spherical_caps}
ORACLE_SQL = {"op7_spherical_caps": _ORACLE}
