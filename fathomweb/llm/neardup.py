"""Near-duplicate documents by one-permutation MinHash with optimal densification.

1. One pass over the texts hashes each document's set of word shingles. A set's hashes fall into
   bins; a bin's value is its least hash; an empty bin takes the value of a full one that a hash of
   the bin and the attempt points to (Shrivastava, Optimal Densification, 2017). Rows of bins make bands.
2. Documents with equal sets are one class, found by aggregation; only classes go on.
3. Classes that share a band's value form a bucket. A bucket's edges are a star: one centre, the member that meets
   the most others in all its buckets, against the rest. Their number is at most classes times bands, whatever the
   sizes of buckets; as buckets of one group share a centre, it is far less.
4. Every star edge is confirmed on the full sets; links are merged to components.
5. The classes of buckets that then still hold several components are the rest. It is compared exactly, by
   prefixes of the full sets (Xiao et al., Efficient Similarity Joins for Near Duplicate Detection, 2008): sets are
   ordered by how common a shingle is, rare ones first, and two sets that are linked share one of the first few. What
   sets share with many others comes last, so passages of a large group bring no pairs. A link is lost only if
   its two classes share no band. With 32 bands of 5 rows, two sets of similarity 0.8 share none with probability 3e-6.

Sets are sets of 64-bit shingle hashes; two different shingles of a corpus pair are taken for
equal with probability 2^-64 each.

Defined results: a null or empty text has an empty set and no links; a text with fewer words than a
shingle is one shingle; rows that share a doc_id are one document, linked if any of them is; a row
whose doc_id is null has no links, component null, and is kept; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

ROWS, BANDS = 5, 32
#: How common shingles are is counted in so many cells of hashes, sent in so many slices.
CELLS, SLICES = 1 << 20, 16
#: Bits of the filter that picks the documents whose sets are wanted.
BITS = 1 << 25
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ATTEMPTS = 256


def shingle_sets(texts: list[bytes], words_in_shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    hashes, out = common.word_hashes(), []
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z, and ASCII white space
        if not words:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        h = hashes.of(words)
        k = min(words_in_shingle, len(h))
        made = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            made = common.mixed((made + h[j : len(h) - k + 1 + j]) * _ODD)
        made.sort()
        out.append(made[np.concatenate(([True], made[1:] != made[:-1]))])
    return out


class OnePermutation:
    """Signatures of ``rows * bands`` bins."""

    def __init__(self, rows: int, bands: int):
        self.rows, self.bands = rows, bands
        self.bins = bins = rows * bands
        self.edges = np.array([-(-(i << 64) // bins) for i in range(bins)], dtype=np.uint64)
        places = np.arange(_ATTEMPTS * bins, dtype=np.uint64).reshape(_ATTEMPTS, bins)
        self.donors = (common.mixed(places * _ODD + np.uint64(7)) % np.uint64(bins)).astype(np.int64)
        self.columns = np.arange(bins)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The values of all bins, from sorted distinct hashes (one at least)."""
        first = np.searchsorted(hashes, self.edges)
        full = np.append(first[1:], len(hashes)) > first
        if full.all():
            return hashes[first]
        source = self.columns.copy()
        empty = np.flatnonzero(~full)
        begin = 0
        while len(empty) and begin < _ATTEMPTS:
            end = min(_ATTEMPTS, max(8, begin * 4))
            donors = self.donors[begin:end, empty]
            hit = full[donors]
            got = hit.any(axis=0)
            source[empty[got]] = donors[hit.argmax(axis=0)[got], np.flatnonzero(got)]
            empty, begin = empty[~got], end
        if len(empty):  # few bins are full: the rest is dealt to them by hash
            there = np.flatnonzero(full)
            source[empty] = there[self.donors[0, empty] % len(there)]
        return hashes[first[source]]

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        grid = self.signature(hashes).reshape(self.bands, self.rows)
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            keys = common.mixed((keys + grid[:, j]) * _ODD)
        return keys


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def signatures(docs: DataFrame, words_in_shingle: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys): the set's size, its 128-bit fingerprint and its bands' keys (null if empty)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = OnePermutation(rows, bands)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets([x.encode() for x in common.texts_of(batch)], words_in_shingle)
            prints = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], dtype=np.uint64).reshape(-1, 2)
            keys = [common.signed(one.band_keys(s)) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(common.signed(prints[:, 0].copy())), pa.array(common.signed(prints[:, 1].copy())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
            )

        return common.batches(batches, work)

    return _ids(docs).mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, keys array<bigint>")


def _marked(ids: DataFrame) -> np.ndarray:
    """One bit for each hash of ``ids`` (doc_id) modulo BITS: a filter of fixed size, which lets others through too."""

    def mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, dtype=bool)
        for batch in rows:
            bits[batch.column(0).to_numpy() % BITS] = True
        some = [(i, zstandard.compress(np.packbits(x).tobytes(), 1)) for i, x in enumerate(bits.reshape(SLICES, -1)) if x.any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["slice", "packed"])

    def either(rows: pa.Table) -> pa.Table:
        found = np.bitwise_or.reduce([np.frombuffer(zstandard.decompress(x), dtype=np.uint8) for x in rows.column("packed").to_pylist()])
        return pa.table({"slice": rows.column("slice")[:1], "packed": pa.array([zstandard.compress(found.tobytes(), 1)], pa.binary())})

    out = np.zeros((SLICES, BITS // SLICES // 8), dtype=np.uint8)
    hashes = ids.select(F.xxhash64("doc_id").alias("h"))
    for r in hashes.mapInArrow(mark, "slice int, packed binary").groupBy("slice").applyInArrow(either, "slice int, packed binary").collect():  # SLICES rows
        out[r.slice] = np.frombuffer(zstandard.decompress(bytes(r.packed)), dtype=np.uint8)
    return out.reshape(-1)


def _sets(docs: DataFrame, wanted: DataFrame, words_in_shingle: int) -> DataFrame:
    """(id, shingles): the hashes of the sets of ``wanted`` (doc_id). Of the texts no more than their sets is shuffled, and of most others nothing."""
    kind = dict(docs.dtypes)["doc_id"]
    wanted = common.written(wanted, "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(_marked(wanted))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column(2).to_numpy() % BITS
        batch = batch.filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
        sets = shingle_sets([x.encode() for x in common.texts_of(batch)], words_in_shingle)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([common.signed(s) for s in sets], pa.list_(pa.int64()))], names=["id", "shingles"])

    made = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(lambda rows: common.batches(rows, work), f"id {kind}, shingles array<bigint>")
    return made.join(wanted.withColumnRenamed("doc_id", "id"), "id", "left_semi")


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with the buckets' sizes. A hot bucket is summed before it meets, and a join with a written table can be split."""
    keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("peers")).where("lo != hi").select("key", "peers")
    return members.join(common.written(keys, "keys"), "key")


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of each bucket's centre and its other members, as far as their sizes allow a link: at most one per row of ``members``.

    A bucket's centre is the member that meets the most others in all its buckets, which is near the middle of its group;
    buckets with much the same members have the same centre and bring the same pairs.
    """
    met = common.written(members.groupBy("rep").agg(F.sum("peers").alias("met")), "met")
    turn = F.struct(-F.col("met"), F.xxhash64("rep"), "rep", "n")
    centres = members.join(met, "rep").groupBy("key").agg(F.min(turn).alias("first")).select("key", F.col("first.rep").alias("centre"), F.col("first.n").alias("centre_n"))
    return (
        members.join(common.written(centres, "centres"), "key")
        .where("rep != centre")
        .where(F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * percent)
        .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        .distinct()
    )


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that the full sets confirm."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
        .where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent)
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all sets of a batch, and where each set begins and ends."""
    lists = batch.column(batch.schema.get_field_index("shingles"))
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(CELLS)).astype(np.int64)


def _loads(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each cell. Any numbers give right links; these keep common shingles last."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(CELLS, dtype=np.int64)
        for batch in common.slices(rows, "shingles", 500_000):
            found += np.bincount(_cells(_flat(batch)[0]), minlength=CELLS)
        some = [(i, zstandard.compress(x.tobytes(), 1)) for i, x in enumerate(found.reshape(SLICES, -1)) if x.any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["slice", "packed"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(x), dtype=np.int64) for x in rows.column("packed").to_pylist())
        return pa.table({"slice": rows.column("slice")[:1], "packed": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    kind = "slice int, packed binary"
    loads = np.zeros((SLICES, CELLS // SLICES), dtype=np.int64)
    for r in sets.select("shingles").mapInArrow(count, kind).groupBy("slice").applyInArrow(add, kind).collect():  # SLICES rows
        loads[r.slice] = np.frombuffer(zstandard.decompress(bytes(r.packed)), dtype=np.int64)
    return loads.reshape(-1)


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, at, least, id, component, n): of each set the shingles one of which it shares with each linked set, by place.

    ``least``: whether it is also among those that it shares with linked sets which are not smaller.
    """
    loads = sets.sparkSession.sparkContext.broadcast(_loads(sets))
    kinds = dict(sets.dtypes)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(rows, "shingles", 500_000):
            flat, ends = _flat(batch)
            tokens, sizes = [], []
            for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                s = flat[begin:end]
                s = s[np.lexsort((s, loads.value[_cells(s)]))]
                tokens.append(s[: max(0, len(s) + (-percent * len(s) // 100) + 1)])
                sizes.append(len(tokens[-1]))
            if not sum(sizes):
                continue
            sizes = np.array(sizes)
            row, n = np.repeat(np.arange(len(sizes)), sizes), np.diff(ends)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            least = at < (n + (-2 * percent * n // (100 + percent)) + 1)[row]
            taken = batch.select(["id", "component"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(common.signed(np.concatenate(tokens))), pa.array(at, pa.int32()), pa.array(least), taken.column(0), taken.column(1), pa.array(n[row], pa.int32())],
                names=["token", "at", "least", "id", "component", "n"],
            )

    return sets.select("id", "component", "shingles").mapInArrow(run, f"token bigint, at int, least boolean, id {kinds['id']}, component {kinds['component']}, n int")


def _rest_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of different components of ``sets`` (id, component, shingles): all that can be linked.

    The first shingle that two linked sets share is in both prefixes, and what follows it in either is enough for the link.
    """
    found = common.written(_prefixes(sets, percent), "prefixes")
    # a token of one component alone brings no pairs
    tokens = found.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("least").alias("any")).where("lo != hi and any").select("token")
    every, found = found, common.written(found.join(common.written(tokens, "tokens"), "token", "left_semi"), "prefixes")
    common.discard(every)
    x, y = (found.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("at", "least", "id", "component", "n"))) for side in "xy")
    return (
        x.join(y.where("least_y"), "token")
        .where("component_x != component_y")
        .where("n_y < n_x or (n_y = n_x and id_y < id_x)")
        .where(F.col("n_y") * 100 >= F.col("n_x") * percent)
        .where(F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) * (100 + percent) >= (F.col("n_x") + F.col("n_y")).cast("bigint") * percent)
        .select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, words_in_shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Linked are documents with 100 * intersection >= percent * union of their shingle sets.
    """
    spark = docs.sparkSession
    common.small_reads(spark)
    signed = common.written(signatures(docs, words_in_shingle, rows, bands), "signatures")
    classes = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    )
    classes = common.written(classes, "classes")
    buckets = classes.select(F.posexplode("keys").alias("band", "key"), "rep", "n", F.col("rep").alias("component"))
    members = common.written(_mixed(buckets), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = common.written(_sets(docs, wanted, words_in_shingle), "sets")
    common.release_shuffles(spark)
    links = common.written(_links(_star_pairs(members, percent), sets, percent), "links")
    # an id with several texts ties their classes together
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("lo"), F.max(F.struct("set_a", "set_b")).alias("hi")).where("lo != hi").select("doc_id")
    own = signed.where("n_shingles > 0").join(several, "doc_id", "left_semi").join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"])
    links = links.union(common.written(own.where("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct(), "same"))
    found = components(links)
    label = found.select(F.col("node").alias("rep"), F.col("component").alias("own"))
    labelled = members.drop("component", "peers").join(label, "rep", "left").withColumn("component", F.coalesce("own", "rep")).drop("own")
    rest = common.written(_mixed(labelled).select(F.col("rep").alias("id"), "component").distinct(), "rest")
    common.discard(members)
    common.release_shuffles(spark)
    late = common.written(_links(_rest_pairs(sets.join(rest, "id"), percent), sets, percent), "links")
    common.discard(sets, rest)
    if late.take(1):
        found = components(links.union(late))
    of_rep = found.select(F.col("node").alias("rep"), "component")
    of_class = classes.select("set_a", "set_b", "rep").join(of_rep, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    full = signed.where("doc_id is not null and n_shingles > 0").join(of_class, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", "component")
    # an empty text goes with its id's other texts
    empty = signed.where("doc_id is not null and n_shingles = 0").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", "component")
    done = full.union(empty).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    none = signed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("component_id"))
    return done.union(none).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, words_in_shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with its columns, without the documents that aren't their component's first, and one row of each (doc_id, text). Rows without id stay."""
    found = near_duplicates(docs, words_in_shingle, percent).where("doc_id is not null")
    own, kept, times = common.fresh(docs, "own", "kept", "times")
    marks = found.groupBy("doc_id").agg(F.min("kept").alias(kept), F.count("*").alias(times)).where(~F.col(kept) | (F.col(times) > 1)).withColumnRenamed("doc_id", own)
    joined = docs.join(common.written(marks, "marks"), F.col("doc_id") == F.col(own), "left").where(F.coalesce(F.col(kept), F.lit(True)))
    columns, again = common.quoted(docs.columns), F.coalesce(F.col(times), F.lit(1)) > 1
    return joined.where(~again).select(*columns).union(joined.where(again).select(*columns).dropDuplicates(["doc_id", "text"]))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under similarity 0.8 of their two-word shingle sets."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), words_in_shingle=2)


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
