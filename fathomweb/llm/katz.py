"""Katz backoff scores of texts under a bigram model of the corpus.

    P(w | u) = d(c(u, w)) c(u, w) / c(u)   if c(u, w) > 0,   else   alpha(u) P(w)
    P(w)     = d1(c(w)) c(w) / N           if c(w) > 0,      else   the mass left over, for one unknown word
    alpha(u) = (sum over followers of c (1 - d)) / c(u) / (1 - sum over followers of P(w))

d are Good-Turing discounts: Turing's for counts up to 5 where they fall in (0, 1), and for all others those of a
log-linear fit of the counts of counts (Gale and Sampson, Good-Turing Frequency Estimation Without
Tears, 1995). They are below 1 for every count, so every history keeps mass for words not yet
seen behind it, and each distribution sums to 1 exactly. A history never seen has alpha 1. A text
begins behind a begin mark, and its last token is an end mark.

How it runs. Words are 64-bit hashes.
1. Unigrams: one pass; each task sends its distinct words with counts, as packed arrays by hash range.
   Their partitions give N, V, counts of counts, and the words with more than a fixed share of all tokens.
2. Bigrams: one pass; each chunk of texts sends the histories and text numbers of its tokens, ordered by
   word and packed, to the partition of the word. There c(w), P(w) and c(u, w) are all local, so the
   counts of counts and then every token's seen or backed-off term are found without a further lookup.
   -log c(u) is added where u itself is the token. Words of step 1's share are spread by their histories.
3. Backoff: each partition sends what it has of each history's sums, and the texts that backed off from it, to
   the history's partition, where log alpha(u) + log c(u) is found and sent to those texts.
4. The texts' parts are added up.
The tables of steps 2 and 3 are the model: partitioned, packed, counted over all training texts.

Defined results: null and empty texts are one end mark; a null id counts as the empty text in the
fold; equal rows are texts of their own; without training texts every score is 0; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 7, 2
TURING = 5
#: Tokens that a task packs together.
CHUNK = 2_000_000
#: Tokens that one partition should hold.
PARTITION = 3_000_000
END, BEGIN = np.uint64(1), np.uint64(2)  # hashes of the marks

_U64, _I64, _F64 = np.uint64, np.int64, np.float64


# ---------------------------------------------------------------- packed arrays

def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; integers lose their leading zero bytes, bytes of one weight stand together."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        parts.append(np.array([len(raw), raw.dtype.itemsize], dtype="<u4").tobytes() + raw.dtype.str.encode().ljust(4))
        parts.append(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T).tobytes() if len(raw) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, size = np.frombuffer(raw, dtype="<u4", count=2, offset=at).tolist()
        kind = raw[at + 8 : at + 12].decode().strip()
        body = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at + 12)
        out.append(np.ascontiguousarray(body.reshape(size, n).T).reshape(-1).view(kind) if n else np.empty(0, dtype=kind))
        at += 12 + n * size
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the least width that holds them."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _range(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash range of each hash, from its upper 32 bits."""
    return ((h >> _U64(32)) * _U64(parts) >> _U64(32)).astype(_I64)


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array of part numbers."""
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        yield p, slice(int(cuts[p]), int(cuts[p + 1]))


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with their values added up."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, dtype=_I64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


# ---------------------------------------------------------------- tokens

def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, end marks included, and each text's number of tokens."""
    table, parts, sizes = common.word_hashes(), [], []
    for text in texts:
        words = text.encode().lower().split()
        parts += [table.of(words), np.array([END])]
        sizes.append(len(words) + 1)
    return (np.concatenate(parts) if parts else np.empty(0, dtype=_U64)), np.array(sizes, dtype=_I64)


def _prepared(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (common.remainder("doc_id", folds) == held_out).alias("held_out"))


# ---------------------------------------------------------------- discounts

class Discounts:
    """d(c) from counts of counts: n[1..], or n[i] for the count of[i], ascending; see the module."""

    def __init__(self, n: np.ndarray, k: int = TURING, of: np.ndarray | None = None):
        n = np.asarray(n, dtype=_F64)
        of = np.arange(len(n)) if of is None else np.asarray(of, dtype=_I64)
        seen, n = of[(of > 0) & (n > 0)], n[(of > 0) & (n > 0)]
        slope = -1.5
        if len(seen) >= 2:
            gap = np.diff(np.concatenate(([0], seen, [2 * seen[-1] - seen[-2]])))
            z = n / (0.5 * (gap[:-1] + gap[1:]))
            slope = float(np.polyfit(np.log(seen), np.log(z), 1)[0])
        self.power = min(-0.1, max(-3.0, slope + 1))  # d(c) = (1 + 1/c)^power < 1
        self.few = np.array([0.0] + [(1 + 1 / r) ** self.power for r in range(1, k + 1)])
        few = dict(zip(seen[: k + 1].tolist(), n[: k + 1].tolist()))
        for r in range(1, k + 1):
            if r in few and 0 < (d := (r + 1) * few.get(r + 1, 0) / (r * few[r])) < 1:
                self.few[r] = d

    def fit(self) -> list[float]:
        """All there is to know, as a few numbers."""
        return [self.power, *self.few.tolist()]

    @classmethod
    def of_fit(cls, fit: np.ndarray) -> Discounts:
        made = cls.__new__(cls)
        made.power, made.few = float(fit[0]), np.asarray(fit[1:], dtype=_F64)
        return made

    def __call__(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c)
        return np.where(c < len(self.few), self.few[np.minimum(c, len(self.few) - 1)], (1 + 1 / np.maximum(c, 1)) ** self.power)


class Unigrams:
    """What the model's lowest order needs to know of the whole corpus."""

    def __init__(self, tokens: int, distinct: int, of_counts: tuple[np.ndarray, np.ndarray], texts: int, spread: np.ndarray, spread_counts: np.ndarray, left: float = 1.0):
        self.tokens, self.distinct, self.texts, self.of_counts = tokens, distinct, texts, of_counts
        self.spread, self.spread_counts = spread, spread_counts  # frequent words, sorted by hash
        self.discounts = Discounts(of_counts[1], of=of_counts[0])
        self.left = left

    def seen(self, c: np.ndarray) -> np.ndarray:
        return self.discounts(c) * c / max(1, self.tokens)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.seen(c), self.left)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + self.distinct + 1.0))


def unigrams(prepared: DataFrame, parts: int, share: int = 8) -> Unigrams:
    """N, V, counts of counts, the mass left over, and the words with more than 1/(share parts) of all tokens: at most share * parts of them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = [0]

        def merged() -> None:
            held[:] = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))] if held else []
            size[0] = 0

        for batch in common.slices(rows):
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            h, _ = _tokens([x for x, t in zip(common.texts_of(batch), train) if t])
            held.append(_summed(h, np.ones(len(h), dtype=_I64)))
            size[0] += len(held[-1][0])
            if size[0] > 3_000_000:
                merged()
        merged()
        for keys, counts in held:
            for p, s in _by_part(_range(keys, parts), parts):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([_pack(keys[s], _small(counts[s]))], pa.binary())], names=["part", "packed"])

    def reduce(rows: pa.Table) -> pa.Table:
        got = [_unpack(x) for x in rows.column("packed").to_pylist()]
        keys, counts = _summed(np.concatenate([g[0] for g in got]), np.concatenate([g[1].astype(_I64) for g in got]))
        values, times = np.unique(counts, return_counts=True)
        top = np.flatnonzero(counts * share * parts > counts.sum())  # more than those with a share of all tokens
        return pa.table({"counts": pa.array([values], pa.list_(pa.int64())), "times": pa.array([times], pa.list_(pa.int64())), "top": pa.array([common.signed(keys[top])], pa.list_(pa.int64())), "top_counts": pa.array([counts[top]], pa.list_(pa.int64())), "texts": pa.array([counts[keys == END].sum()], pa.int64())})

    found = prepared.mapInArrow(run, "part int, packed binary").groupBy("part").applyInArrow(reduce, "counts array<bigint>, times array<bigint>, top array<bigint>, top_counts array<bigint>, texts bigint")
    # what a partition sends is small: distinct counts grow as the root of its tokens, and its words above the share are few
    rows = found.collect()
    if not rows:
        return Unigrams(0, 0, (np.empty(0, dtype=_I64), np.empty(0)), 0, np.empty(0, dtype=_U64), np.empty(0, dtype=_I64))
    values, times = _summed(np.concatenate([r.counts for r in rows]).astype(_I64), np.concatenate([r.times for r in rows]).astype(_I64))
    tokens, distinct = int((values * times).sum()), int(times.sum())
    top, counts = np.concatenate([r.top for r in rows]).astype(_I64).view(_U64), np.concatenate([r.top_counts for r in rows]).astype(_I64)
    texts = sum(r.texts for r in rows)
    often = counts * share * parts > tokens
    order = np.argsort(top[often])
    made = Unigrams(tokens, distinct, (values, times), texts, top[often][order], counts[often][order])
    made.left = float(1 - (made.seen(values) * times).sum())
    return made


# ---------------------------------------------------------------- bigrams

def _place(w: np.ndarray, u: np.ndarray, known: Unigrams, parts: int) -> np.ndarray:
    """The partition of each token: its word's hash range; that of its history's for words with a share of their own."""
    part = _range(w, parts)
    if len(known.spread):
        at = np.minimum(np.searchsorted(known.spread, w), len(known.spread) - 1)
        often = known.spread[at] == w
        part[often] = _range(common.mixed(u[often]), parts)
    return part


def _bigram_chunks(prepared: DataFrame, known: Unigrams, parts: int) -> DataFrame:
    """The tokens of each chunk of texts, as one row for each partition, and the chunk's list of texts (doc_ids).

    A partition gets each distinct (word, history, text) once, with the number of its tokens.
    """
    model = prepared.sparkSession.sparkContext.broadcast(known)
    kind = dict(prepared.dtypes)["doc_id"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0
        for batch in common.slices(rows):
            h, n = _tokens(common.texts_of(batch))
            held.append((h, n, batch.column(2).to_numpy(zero_copy_only=False), batch.column(0)))
            size += len(h)
            if size >= CHUNK:
                yield done(held, name)
                held, size, name = [], 0, name + 1
        if held:
            yield done(held, name)

    def done(held: list[tuple], name: int) -> pa.RecordBatch:
        w, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        held_out = np.concatenate([x[2] for x in held]).astype(np.uint8)
        ids = pa.concat_arrays([x[3] for x in held])
        u = np.concatenate(([BEGIN], w[:-1]))
        u[np.cumsum(n) - n] = BEGIN
        text = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((u, w))  # stable: texts stay in order
        w, u, text = w[order], u[order], text[order]
        first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (u[1:] != u[:-1]) | (text[1:] != text[:-1]))))
        times = np.diff(np.append(first, len(w)))
        w, u, text = w[first], u[first], text[first]
        part = _place(w, u, model.value, parts).astype(np.uint32)
        order = np.argsort(part, kind="stable")
        w, u, text, times, part = w[order], u[order], text[order], times[order], part[order]
        where, packed = [], []
        for p, s in _by_part(part, parts):
            begin = np.flatnonzero(np.concatenate(([True], w[s][1:] != w[s][:-1])))
            pasts, which = np.unique(u[s], return_inverse=True)
            where.append(p)
            packed.append(_pack(w[s][begin], _small(np.diff(np.append(begin, s.stop - s.start))), pasts, _small(which), _small(text[s]), _small(times[s]), held_out))
        where.append(int(_range(common.mixed(np.array([name], dtype=_U64)), parts)[0]))
        packed.append(_pack(_small(n), held_out))
        lists = pa.ListArray.from_arrays(pa.array([0] * len(packed) + [len(ids)], pa.int32()), ids, mask=pa.array([True] * (len(packed) - 1) + [False]))
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([name] * len(packed), pa.int64()), pa.array(packed, pa.binary()), lists], names=["part", "chunk", "packed", "doc_ids"])

    return prepared.mapInArrow(run, f"part int, chunk bigint, packed binary, doc_ids array<{kind}>")


class _Partition:
    """All tokens of one partition, by bigram."""

    def __init__(self, packed: list[bytes], known: Unigrams):
        got = [_unpack(x) for x in packed]
        self.sizes = [len(g[3]) for g in got]
        cat = lambda xs, kind: np.concatenate([np.empty(0, dtype=kind), *xs])
        self.w = cat([np.repeat(g[0], g[1].astype(_I64)) for g in got], _U64)
        self.u = cat([g[2][g[3].astype(_I64)] for g in got], _U64)
        self.text = cat([g[4] for g in got], np.uint8)  # in the least width that any chunk needs
        self.times = cat([g[5] for g in got], np.uint8)
        self.train = cat([g[6][g[4].astype(_I64)] == 0 for g in got], bool)
        del got
        order = np.lexsort((self.u, self.w))
        w, u = self.w[order], self.u[order]
        new_word = np.concatenate(([True], w[1:] != w[:-1])) if len(w) else np.empty(0, dtype=bool)
        new = new_word | np.concatenate(([True], u[1:] != u[:-1])) if len(w) else new_word
        first, first_word = np.flatnonzero(new), np.flatnonzero(new_word)
        counted = np.where(self.train, self.times, 0)[order]
        total = lambda at: np.add.reduceat(counted, at, dtype=_I64) if len(at) else np.empty(0, dtype=_I64)
        words, of_word = w[first_word], total(first_word)
        if len(known.spread) and len(words):
            at = np.minimum(np.searchsorted(known.spread, words), len(known.spread) - 1)
            of_word = np.where(known.spread[at] == words, known.spread_counts[at], of_word)
        self.type_w, self.type_u, self.type_c = w[first], u[first], total(first)  # distinct bigrams and c(u, w)
        self.type_cw = of_word[np.cumsum(new_word)[first] - 1]  # c(w)
        del self.w, counted, u
        self.type_of = np.empty(len(w), dtype=_I64)
        self.type_of[order] = np.cumsum(new) - 1


def _split(rows: pa.Table) -> tuple[list[int], list[bytes], pa.Table]:
    """Chunk and tokens of the packed rows; the rows that list texts."""
    lists = pa.compute.is_valid(rows.column("doc_ids"))
    tokens = rows.filter(pa.compute.invert(lists))
    return tokens.column("chunk").to_pylist(), tokens.column("packed").to_pylist(), rows.filter(lists)


def _bigram_fit(chunks: DataFrame, known: Unigrams) -> DataFrame:
    """One row: the discounts fitted to the counts of counts of all bigrams. Different counts grow as the root of the tokens; the fit is a few numbers."""
    model = chunks.sparkSession.sparkContext.broadcast(known)

    def count(rows: pa.Table) -> pa.Table:
        _, packed, _ = _split(rows)
        c = _Partition(packed, model.value).type_c
        at, n = np.unique(c[c > 0], return_counts=True)
        return pa.table({"c": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64())})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs in batch.column(0):
                made = Discounts(pairs.values.field("n").to_numpy(), of=pairs.values.field("c").to_numpy()) if len(pairs) else Discounts(np.zeros(1))
                yield pa.RecordBatch.from_arrays([pa.array([made.fit()], pa.list_(pa.float64()))], names=["fit"])

    counts = chunks.groupBy("part").applyInArrow(count, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return counts.agg(F.sort_array(F.collect_list(F.struct("c", "n"))).alias("of_counts")).mapInArrow(fit, "fit array<double>")


DOCS, SUMS, STATS, ASKED, OFTEN_STATS, OFTEN_ASKED = range(6)


def _scored(chunks: DataFrame, known: Unigrams, parts: int) -> DataFrame:
    """(kind, part, chunk, packed, doc_ids): see the kinds' uses below. ``chunks`` has the discounts' fit in each row."""
    model = chunks.sparkSession.sparkContext.broadcast(known)
    kind = dict(chunks.dtypes)["doc_ids"]

    def score(rows: pa.Table) -> pa.Table:
        own: Unigrams = model.value
        names, packed, lists = _split(rows)
        discounts = Discounts.of_fit(rows.column("fit")[0].values.to_numpy())
        x = _Partition(packed, own)
        del packed
        seen = x.type_c > 0
        discounted = discounts(x.type_c) * x.type_c
        with np.errstate(divide="ignore"):
            term = np.where(seen, np.log10(np.where(seen, discounted, 1)), np.log10(own.p(x.type_cw)))
            past = np.where((x.type_cw > 0) & (x.type_w != END), -np.log10(np.maximum(x.type_cw, 1)), 0.0)
        base, score_of, known_of = own.base(x.type_cw)[x.type_of] * x.times, (term + past)[x.type_of] * x.times, np.where(x.type_cw[x.type_of] > 0, x.times, 0)
        out: list[tuple] = []
        ask = ~seen[x.type_of]
        begin = 0
        source = np.empty(len(x.text), dtype=_I64)
        for k, (name, size) in enumerate(zip(names, x.sizes)):
            s = slice(begin, begin + size)
            source[s] = k
            t = x.text[s]
            at = np.flatnonzero(np.bincount(t))
            add = lambda v, t=t, s=s, at=at: np.bincount(t, weights=v[s])[at]
            out.append((SUMS, -1, name, _pack(_small(at), add(score_of), add(base), _small(add(known_of).round().astype(_I64)))))
            begin += size
        u, mass, follow = _summed(x.type_u[seen], (x.type_c - discounted)[seen], own.p(x.type_cw)[seen])
        asked_u, asked_text, asked_times, asked_from = x.u[ask], x.text[ask], x.times[ask], source[ask]
        often = lambda u: np.isin(u, own.spread) | (u == BEGIN)
        chunk_names = np.array(names, dtype=_I64)
        for flag, stats, asked in ((False, STATS, ASKED), (True, OFTEN_STATS, OFTEN_ASKED)):
            some = often(u) == flag
            part = _range(u[some], parts)
            for p, s in _by_part(part, parts):
                out.append((stats, p, -1, _pack(u[some][s], mass[some][s], follow[some][s])))
            some = np.flatnonzero(often(asked_u) == flag)
            some = some[np.argsort(_range(asked_u[some], parts), kind="stable")]
            for p, s in _by_part(_range(asked_u[some], parts), parts):
                pasts, which = np.unique(asked_u[some][s], return_inverse=True)
                out.append((asked, p, -1, _pack(pasts, _small(which), _small(asked_text[some][s]), _small(asked_times[some][s]), _small(asked_from[some][s]), chunk_names)))
        n_out = len(out)
        made = pa.table({
            "kind": pa.array([o[0] for o in out] + [DOCS] * lists.num_rows, pa.int32()),
            "part": pa.array([o[1] for o in out] + [-1] * lists.num_rows, pa.int32()),
            "chunk": pa.concat_arrays([pa.array([o[2] for o in out], pa.int64()), *lists.column("chunk").chunks]),
            "packed": pa.concat_arrays([pa.array([o[3] for o in out], pa.binary()), *(c.cast(pa.binary()) for c in lists.column("packed").chunks)]),
            "doc_ids": pa.concat_arrays([pa.nulls(n_out, rows.schema.field("doc_ids").type), *lists.column("doc_ids").chunks]),
        })
        return made

    return chunks.groupBy("part").applyInArrow(score, f"kind int, part int, chunk bigint, packed binary, doc_ids {kind}")


# ---------------------------------------------------------------- backoff

def _log_backoff(mass: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """log10 (alpha(u) c(u))."""
    return np.log10(mass) - np.log10(np.maximum(1 - follow, 1e-300))


def _answers(packed: bytes, u: np.ndarray, value: np.ndarray) -> list[tuple[int, bytes]]:
    """What to add to the texts of each chunk for the histories they asked for."""
    pasts, which, text, times, source, names = _unpack(packed)
    at = np.minimum(np.searchsorted(u, pasts), max(0, len(u) - 1))
    found = np.where(u[at] == pasts, value[at], 0.0) if len(u) else np.zeros(len(pasts))
    add = found[which.astype(_I64)] * times
    out = []
    order = np.argsort(source, kind="stable")
    for k, s in _by_part(source[order], len(names)):
        t = text[order][s].astype(_I64)
        there = np.flatnonzero(np.bincount(t))
        out.append((int(names[k]), _pack(_small(there), np.bincount(t, weights=add[order][s])[there])))
    return out


def _backed_off(table: DataFrame) -> DataFrame:
    """(chunk, packed): what the partitions of histories add to texts."""

    def answer(rows: pa.Table) -> pa.Table:
        kinds, packed = rows.column("kind").to_pylist(), rows.column("packed").to_pylist()
        stats = [_unpack(x) for k, x in zip(kinds, packed) if k == STATS]
        u, mass, follow = _summed(*(np.concatenate([np.empty(0, dtype=d), *(s[i] for s in stats)]) for i, d in enumerate((_U64, _F64, _F64))))
        value = _log_backoff(mass, follow)
        out = [y for k, x in zip(kinds, packed) if k == ASKED for y in _answers(x, u, value)]
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int64()), "packed": pa.array([o[1] for o in out], pa.binary())})

    rare = table.where(F.col("kind").isin(STATS, ASKED)).groupBy("part").applyInArrow(answer, "chunk bigint, packed binary")

    # the few frequent histories: their sums come to the driver, so that nobody has to meet at them
    def listed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for x in batch.column(0).to_pylist():
                u, mass, follow = _unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(u)), pa.array(mass), pa.array(follow)], names=["u", "mass", "follow"])

    sums = table.where(F.col("kind") == OFTEN_STATS).select("packed").mapInArrow(listed, "u bigint, mass double, follow double").groupBy("u").agg(F.sum("mass").alias("mass"), F.sum("follow").alias("follow")).collect()
    u = np.array([r.u for r in sums], dtype=_I64).view(_U64)
    order = np.argsort(u)
    value = _log_backoff(np.array([r.mass for r in sums]), np.array([r.follow for r in sums]))[order] if sums else np.empty(0)
    model = table.sparkSession.sparkContext.broadcast((u[order], value))

    def often(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for x in batch.column(0).to_pylist():
                out = _answers(x, *model.value)
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["chunk", "packed"])

    return rare.union(table.where(F.col("kind") == OFTEN_ASKED).select("packed").mapInArrow(often, "chunk bigint, packed binary"))


def score_documents(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    The model learns from the rows whose crc32(doc_id as text) modulo ``folds`` is not ``held_out``.
    """
    spark = docs.sparkSession
    prepared = _prepared(docs, folds, held_out)
    known = unigrams(prepared, common.shuffle_width(spark))
    common.release_shuffles(spark)
    parts = max(6, -(-(known.tokens * folds) // ((folds - 1) * PARTITION)))
    chunks = _bigram_chunks(prepared, known, parts).repartition(parts, "part")
    fitted = chunks.withColumn("fit", _bigram_fit(chunks, known).scalar())  # a scalar subquery over the same shuffle
    table = common.written(_scored(fitted, known, parts), "bigrams", by="kind")
    common.release_shuffles(spark)
    added = common.written(_backed_off(table), "backoff")
    kind, texts, tokens = dict(prepared.dtypes)["doc_id"], known.texts, known.tokens
    parted = table.where(F.col("kind").isin(DOCS, SUMS)).select("chunk", "packed", "doc_ids").union(added.select("chunk", "packed", F.lit(None).cast(dict(table.dtypes)["doc_ids"])))

    def total(rows: pa.Table) -> pa.Table:
        lists = pa.compute.is_valid(rows.column("doc_ids")).to_pylist()
        packed = rows.column("packed").to_pylist()
        where = lists.index(True)
        n, held = _unpack(packed[where])
        score, base, familiar = np.full(len(n), -np.log10(texts) if texts else 0.0), np.zeros(len(n)), np.zeros(len(n), dtype=_I64)
        for k, x in enumerate(packed):
            if k == where:
                continue
            at, add, *more = _unpack(x)
            at = at.astype(_I64)
            score[at] += add
            if more:
                base[at] += more[0]
                familiar[at] += more[1].astype(_I64)
        return pa.table({
            "doc_id": rows.column("doc_ids")[where].values, "held_out": pa.array(held == 1), "n_tokens": pa.array(n.astype(_I64)), "n_known": pa.array(familiar),
            "train_tokens": pa.array(np.full(len(n), tokens, dtype=_I64)), "base_score": pa.array(base), "score": pa.array(score),
        })

    return parted.groupBy("chunk").applyInArrow(total, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, scored by the model of those outside fold 2 of 7."""
    return score_documents(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_katz_backoff": op1_katz_backoff}
ORACLE_SQL: dict[str, str] = {}
