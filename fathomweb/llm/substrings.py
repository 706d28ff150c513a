"""Exact removal of word windows that occur more than once, by super-k-mer partitioning.

1. Rows with one text are one class, found by aggregation. A class of several rows repeats as a whole; one of its
   rows goes on for it, with weight 2.
2. One pass over the texts finds each window's minimiser: the least hash of the short word runs
   (m-mers) inside it. A window that occurs twice has the same minimiser both times, so only
   minimisers that occur at two places of the corpus can hold repeats; they are counted exactly, by aggregation.
3. Texts that hold such minimisers are cut into super-k-mers: consecutive windows with one
   minimiser travel as one packed string of words to that minimiser's bucket. There the windows are
   hashed and sorted, and those whose sequence starts at another place too are marked.
4. A minimiser that occurs in more than ``hot`` places would make too large a bucket. Of its super-k-mers equal ones
   are combined before they travel, and mark each other as wholes. Each different one is then unpacked once, and its
   windows are counted, again with map-side combination, under hashes of their own. What has been found returns to the
   places by joins of written tables, which adaptive execution can split.
5. Marks are gathered by class, and each row keeps the words that no marked window covers.

Texts, packed strings and windows are compared by 128 bits of hashes.

Defined results: null and empty texts have no words, and kept text ''; texts shorter than a window keep
all words; equal rows, also with equal doc_id, count as documents of their own, so all their
windows repeat; null ids are allowed; an empty table gives an empty table; other columns are ignored,
or passed on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 35
MMER = 8
#: Places of a minimiser up to which its super-k-mers may meet in one task.
HOT = 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def mmers(h: np.ndarray, m: int) -> np.ndarray:
    """A hash for each run of m words."""
    n = len(h) - m + 1
    made = h[:n].copy()
    for j in range(1, m):
        made = common.mixed(made) + h[j : n + j]
    return common.mixed(made * _ODD)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done, out = 1, v
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def minimisers(h: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document with ``window`` words at least: its runs' first windows, their minimisers, all m-mer hashes."""
    v = mmers(h, m)
    least = sliding_min(v, window - m + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return first, least[first], v


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(base, -1, 1 << 64))
    up, down = np.full(n, np.uint64(base)), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window of word hashes, by prefix sums of a polynomial modulo 2^64."""
    out, size = [], 1 << max(12, int(len(h)).bit_length())
    for base in _BASES:
        up, down = _powers(int(base), size)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(common.mixed(h + base) * up[: len(h)], dtype=np.uint64)))
        n = len(h) - window + 1
        out.append(common.mixed((total[window:] - total[:n]) * down[:n]))
    return out[0], out[1]


def _text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _keyed(docs: DataFrame) -> DataFrame:
    """(a, b, text) of the texts that may hold a window."""
    a, b = _text_key(F.col("text"))
    return docs.select(a.alias("a"), b.alias("b"), "text").where(F.length("text") > 0)


def _profile(docs: DataFrame, window: int, m: int) -> DataFrame:
    """(a, b, minimisers, places): of each row with a window its minimisers, and in how many places each is."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, values, places = [], [], []
        for row, text in enumerate(common.texts_of(batch)):
            words = text.encode().split()
            if len(words) < window:
                continue
            _, least, v = minimisers(common.word_hashes().of(words), window, m)
            least = np.unique(least)
            v = np.sort(v)
            rows.append(row)
            values.append(common.signed(least))
            places.append((np.searchsorted(v, least, side="right") - np.searchsorted(v, least)).astype(np.int32))
        take = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(values, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
            names=["a", "b", "minimisers", "places"],
        )

    return _keyed(docs).mapInArrow(lambda rows: common.batches(rows, work), "a bigint, b bigint, minimisers array<bigint>, places array<int>")


def _super_kmers(flagged: DataFrame, window: int, m: int) -> DataFrame:
    """(hot, bucket, x, y, a, b, start, size, weight, packed): the super-k-mers of each text's repeated minimisers.

    x and y are hashes of a hot one's string; ``start`` is null where nothing has to return, as the text repeats as a whole.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, hot, bucket, start, size, packed, x, y = [], [], [], [], [], [], [], []
        copies, cold_of, hot_of = (batch.column(i).to_pylist() for i in (3, 4, 5))
        for i, text in enumerate(common.texts_of(batch)):
            words = text.encode().split()
            first, least, _ = minimisers(common.word_hashes().of(words), window, m)
            end = np.append(first[1:], len(words) - window + 1) + window - 1
            least = common.signed(least)
            is_hot = np.isin(least, hot_of[i]) if hot_of[i] else np.zeros(len(least), dtype=bool)
            take = np.flatnonzero(is_hot | np.isin(least, cold_of[i])) if cold_of[i] else np.flatnonzero(is_hot)
            strings = [b" ".join(words[p:q]) for p, q in zip(first[take].tolist(), end[take].tolist())]
            for k, s in zip(take.tolist(), strings):
                h = xxhash.xxh3_128_intdigest(s) if is_hot[k] else None
                x.append(None if h is None else (h >> 64) - (1 << 63))
                y.append(None if h is None else (h & ((1 << 64) - 1)) - (1 << 63))
            row += [i] * len(take)
            hot += is_hot[take].tolist()
            bucket += least[take].tolist()
            start += [None] * len(take) if copies[i] > 1 else first[take].tolist()
            size += (end - first)[take].tolist()
            packed += strings
        taken = pa.array(row, pa.int64())
        weight = np.minimum(np.array(copies, dtype=np.int64), 2)[np.array(row, dtype=np.int64)] if row else []
        return pa.RecordBatch.from_arrays(
            [pa.array(hot, pa.bool_()), pa.array(bucket, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(weight, pa.int64()), pa.array(packed, pa.binary())],
            names=["hot", "bucket", "x", "y", "a", "b", "start", "size", "weight", "packed"],
        )

    return flagged.select("a", "b", "text", "copies", "cold", "hot").mapInArrow(
        lambda rows: common.batches(rows, work, chars=1_000_000), "hot boolean, bucket bigint, x bigint, y bigint, a bigint, b bigint, start int, size int, weight bigint, packed binary"
    )


def _windows_of(packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of packed strings: two hashes, the string's number, the place in it, and how many windows the string has."""
    words = [p.split(b" ") for p in packed]
    sizes = np.array([len(w) for w in words])
    left, right = window_hashes(common.word_hashes().of([x for w in words for x in w]), window)
    n = sizes - window + 1
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(sizes) - sizes)[row] + offset
    return left[at], right[at], row, offset, n


def _ranges(marked: np.ndarray, row: np.ndarray, offset: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string's number, first word, end) of each run of marked windows."""
    first = np.flatnonzero(marked & ((offset == 0) | ~np.concatenate(([False], marked[:-1]))))
    last = np.flatnonzero(marked & ((offset == n[row] - 1) | ~np.concatenate((marked[1:], [False]))))
    return row[first], offset[first], offset[last] + window


def _count_buckets(kmers: DataFrame, window: int) -> DataFrame:
    """(a, b, start, end): word ranges of repeated windows. Rows come sorted by bucket; a bucket is bounded."""

    def counted(block: pa.Table) -> pa.RecordBatch | None:
        left, right, row, offset, n = _windows_of(block.column("packed").to_pylist(), window)
        bucket = block.column("bucket").to_numpy().astype(np.int64).view(np.uint64)[row]
        left = left + bucket * _ODD
        order = np.lexsort((right, left))
        same = (left[order][1:] == left[order][:-1]) & (right[order][1:] == right[order][:-1])
        group = np.cumsum(np.concatenate(([0], ~same)))
        weight = block.column("weight").to_numpy()[row]
        repeated = np.empty(len(order), dtype=bool)
        repeated[order] = (np.bincount(group, weights=weight[order]) > 1)[group]
        start = block.column("start").to_numpy(zero_copy_only=False).astype(np.float64)
        which, begin, end = _ranges(repeated & ~np.isnan(start)[row], row, offset, n, window)
        if not len(which):
            return None
        where, base = block.select(["a", "b"]).take(pa.array(which)).combine_chunks(), start[which].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [where.column("a").chunk(0), where.column("b").chunk(0), pa.array((base + begin).astype(np.int32)), pa.array((base + end).astype(np.int32))], names=["a", "b", "start", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(5).nbytes
            if size < 1_000_000:
                continue
            block = pa.Table.from_batches(held)
            buckets = block.column("bucket").to_numpy()
            other = np.flatnonzero(buckets != buckets[-1])
            whole = int(other[-1]) + 1 if len(other) else 0
            found = counted(block.slice(0, whole)) if whole else None
            if found is not None:
                yield found
            held = block.slice(whole).to_batches()
            size = sum(x.column(5).nbytes for x in held)
        found = counted(pa.Table.from_batches(held)) if sum(x.num_rows for x in held) else None
        if found is not None:
            yield found

    return kmers.select("bucket", "a", "b", "start", "weight", "packed").mapInArrow(run, "a bigint, b bigint, start int, end int")


def _unpacked(kmers: DataFrame, window: int) -> DataFrame:
    """(left, right, weight, a, b, start, end) of different strings (packed, n, a, b, start), each with its number of places.

    A window for each hash and string, to be counted; one that needs an answer has a place. Ranges that are known to repeat have no hashes.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right, row, offset, n = _windows_of(batch.column(0).to_pylist(), window)
        places, start = batch.column(1).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
        order = np.lexsort((right, left, row))
        new = np.concatenate(([True], (left[order][1:] != left[order][:-1]) | (right[order][1:] != right[order][:-1]) | (row[order][1:] != row[order][:-1])))
        group = np.cumsum(new) - 1
        inside = np.bincount(group)
        several = np.empty(len(row), dtype=bool)
        several[order] = (inside > 1)[group]
        single = (places == 1) & ~np.isnan(start)  # strings of one place, which is told what repeats
        which, begin, end = _ranges(several & single[row], row, offset, n, window)
        one = order[new]  # a window of each hash and string
        asks = single[row[one]] & ~several[one]
        owner = np.concatenate((row[one], which))
        from_word = np.concatenate((offset[one], begin)) + np.nan_to_num(start)[owner].astype(np.int64)
        size = np.concatenate((np.full(len(one), window), end - begin))
        silent = np.concatenate((~asks, np.zeros(len(which), dtype=bool)))
        known = np.concatenate((np.zeros(len(one), dtype=bool), np.ones(len(which), dtype=bool)))
        weight = np.concatenate((np.where((places[row[one]] > 1) | several[one], 2, 1), np.full(len(which), 2)))
        padding = np.zeros(len(which), dtype=np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(common.signed(np.concatenate((left[one], padding))), mask=known), pa.array(common.signed(np.concatenate((right[one], padding))), mask=known), pa.array(weight.astype(np.int64)),
                batch.column(2).take(pa.array(owner)), batch.column(3).take(pa.array(owner)),
                pa.array(from_word.astype(np.int32), mask=silent), pa.array((from_word + size).astype(np.int32), mask=silent),
            ],
            names=["left", "right", "weight", "a", "b", "start", "end"],
        )

    return kmers.select("packed", "n", "a", "b", "start").mapInArrow(
        lambda rows: common.batches(rows, work, text="packed", chars=1_000_000), "left bigint, right bigint, weight bigint, a bigint, b bigint, start int, end int"
    )


def _hot_marks(hot: DataFrame, window: int) -> DataFrame:
    """(a, b, start, end): word ranges of repeated windows of the super-k-mers of hot minimisers."""
    place = F.struct("a", "b", "start")
    kmers = hot.groupBy("x", "y").agg(F.sum("weight").alias("n"), F.first("packed").alias("packed"), F.min(place).alias("place"))
    kmers = common.written(kmers.select("x", "y", "n", "packed", "place.*"), "kmers")
    again = kmers.where("n > 1").select("x", "y")
    whole = hot.where("start is not null").join(again, ["x", "y"]).select("a", "b", "start", (F.col("start") + F.col("size")).alias("end"))
    windows = common.written(_unpacked(kmers, window), "windows")
    twice = windows.where("left is not null").groupBy("left", "right").agg(F.sum("weight").alias("n")).where("n > 1").select("left", "right")
    asked = windows.where("left is not null and start is not null").join(common.written(twice, "twice"), ["left", "right"])
    known = windows.where("left is null")
    return whole.union(asked.select("a", "b", "start", "end")).union(known.select("a", "b", "start", "end"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, m: int = MMER, hot: int = HOT) -> DataFrame:
    """(a, b, ranges): by the texts' hashes, the ranges of words (start, end) that repeated windows cover; ends may lie beyond the text's."""
    spark = docs.sparkSession
    classes = _profile(docs, window, m).groupBy("a", "b").agg(F.count("*").alias("copies"), F.first("minimisers").alias("minimisers"), F.first("places").alias("places"))
    classes = common.written(classes, "classes")
    places = classes.select("a", "b", "copies", F.explode(F.arrays_zip("minimisers", "places")).alias("x")).select("a", "b", "copies", F.col("x.minimisers").alias("minimiser"), F.col("x.places").alias("places"))
    counts = common.written(places.groupBy("minimiser").agg(F.sum("places").alias("total")).where("total > 1"), "counts")
    total = F.col("total")
    chosen = (
        places.join(counts, "minimiser").groupBy("a", "b")
        .agg(F.first("copies").alias("copies"), F.collect_list(F.when(total <= hot, F.col("minimiser"))).alias("cold"), F.collect_list(F.when(total > hot, F.col("minimiser"))).alias("hot"))
    )
    chosen = common.written(chosen, "chosen")
    common.discard(counts)
    common.release_shuffles(spark)
    texts = _keyed(docs).groupBy("a", "b").agg(F.first("text").alias("text"))  # copies meet map-side
    kmers = common.written(_super_kmers(texts.join(chosen, ["a", "b"]), window, m), "super-k-mers", by="hot")
    common.discard(chosen)
    common.release_shuffles(spark)
    marks = _count_buckets(kmers.where("not hot").repartition("bucket").sortWithinPartitions("bucket"), window)
    if not (some := kmers.where("hot")).isEmpty():
        marks = marks.union(_hot_marks(some, window))
    copied = classes.where("copies > 1").select("a", "b", F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("end"))
    ranges = marks.union(copied).groupBy("a", "b").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    ranges = common.written(ranges, "ranges")
    common.discard(classes, kmers)
    common.release_shuffles(spark)
    return ranges


def _kept_words(words: list[bytes], ranges: pa.StructScalar | None) -> list[bytes]:
    edge, n = np.zeros(len(words) + 1, dtype=np.int64), len(words)
    np.add.at(edge, np.minimum(ranges.field("start").to_numpy(), n), 1)
    np.add.at(edge, np.minimum(ranges.field("end").to_numpy(), n), -1)
    return [w for w, covered in zip(words, np.cumsum(edge[:-1]).tolist()) if not covered]


def _with_ranges(docs: DataFrame, ranges: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the ranges of each row's text, and the name of their column."""
    a, b, name = common.fresh(docs, "a", "b", "ranges")
    first, second = _text_key(F.col("text"))
    columns = common.quoted(docs.columns)
    return docs.select(*columns, first.alias(a), second.alias(b)).join(ranges.toDF(a, b, name), [a, b], "left").select(*columns, name), name


def removed_digests(docs: DataFrame, window: int = WINDOW, m: int = MMER, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    joined, _ = _with_ranges(docs, repeated_ranges(docs, window, m, hot))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, digests, ranges = [], [], [], batch.column(2)
        for row, text in enumerate(common.texts_of(batch)):
            words = text.encode().split()
            kept = _kept_words(words, ranges[row].values) if ranges[row].is_valid else words
            n.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(lambda rows: common.batches(rows, work), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, m: int = MMER, hot: int = HOT) -> DataFrame:
    """``docs`` with all its columns; texts that hold repeats are replaced by their kept words, joined by a space. n_chars follows. Other texts stay as they are."""
    joined, _ = _with_ranges(docs, repeated_ranges(docs, window, m, hot))
    names = docs.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranges, columns = batch.column(len(names)), dict(zip(names, batch.columns))  # by place
        hit = ranges.is_valid().to_pylist()
        if any(hit):
            texts = columns["text"].to_pylist()
            kept = [b" ".join(_kept_words(t.encode().split(), ranges[row].values)).decode() if hit[row] else t for row, t in enumerate(texts)]
            columns["text"] = pa.array(kept, columns["text"].type)
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                sizes = pa.array([len(t) if t is not None else None for t in kept], pa.int64()).cast(kind)
                columns["n_chars"] = pc.if_else(pa.array(hit), sizes, columns["n_chars"])
        return pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return common.numbered(joined).mapInArrow(lambda rows: common.batches(rows, work, text=f"c{names.index('text')}"), docs.schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, less the words of 35-word windows that also start elsewhere."""
    return removed_digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
