"""Byte-level BPE with vectorised pre-tokenisation, and its inverse.

Texts of a batch are laid out as one array of code points. Each code point is mapped to a class,
each class to a function between the states of a small automaton, and an associative scan over the
(finite) monoid of such functions gives the state behind every code point. A table over three
neighbouring states then tells where a slice begins; no regular expression looks at the text.
Slices feed a bounded cache of finished merges; only unseen slices are merged, pair by pair.

Defined results: null and empty texts have no ids; equal rows have equal results; columns that
the operator doesn't name are left alone; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

# ---------------------------------------------------------------- the automaton

#: Classes of code points. Some letters are classes of their own, as an apostrophe and they may be one slice.
LETTER, S_T_M_D, R_V, ELL, EE, NUMBER, OTHER, QUOTE, BLANK, SPACE, END = range(11)
#: States: what the last code point belongs to. Q: an apostrophe that begins a slice; KR, KL: one or
#: the other beginning of a two-letter contraction behind it; KD: a complete contraction.
START, L, N, O, P, W, Q, KR, KL, KD = range(10)
_STATES = 10


def _step(state: int, kind: int) -> int:
    if kind == END:
        return START
    if kind == S_T_M_D:
        return KD if state == Q else L
    if kind == R_V:
        return KR if state == Q else L
    if kind == ELL:
        return KL if state == Q else KD if state == KL else L
    if kind == EE:
        return KD if state == KR else L
    if kind == QUOTE:
        return O if state in (O, P, Q) else Q
    return {LETTER: L, NUMBER: N, OTHER: O, BLANK: P, SPACE: W}[kind]


def _begins(before: int, state: int, behind: int) -> bool:
    """Whether a slice begins at a code point, from the states before, at and behind it."""
    if state == START:
        return False
    if state in (P, W):  # a run of white space gives its last code point to what follows
        return before not in (P, W) or behind not in (P, W, START)
    if state == L:
        return before not in (L, P, KR, KL)
    if state in (KR, KL):
        return behind != KD
    if state == N:
        return before not in (N, P)
    if state == O:
        return before not in (O, P, Q)
    return state == Q


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each class; the product table (first, then second); each function's values; the begin table."""
    found: dict[tuple[int, ...], int] = {}
    todo = [tuple(_step(s, k) for s in range(_STATES)) for k in range(11)]
    gens = list(todo)
    while todo:
        f = todo.pop()
        if f not in found:
            found[f] = len(found)
            todo += [tuple(g[s] for s in f) for g in gens]
    size = len(found)
    product = np.empty((size, size), dtype=np.uint8)
    for f, i in found.items():
        for g, j in found.items():
            product[i, j] = found[tuple(g[s] for s in f)]
    assert size < 256
    values = np.array(list(found), dtype=np.uint8)
    begins = np.array([[[_begins(a, b, c) for c in range(_STATES)] for b in range(_STATES)] for a in range(_STATES)])
    return np.array([found[g] for g in gens], dtype=np.uint8), product.ravel(), values.ravel(), begins.ravel()


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point (and of 0x110000, the end of a text).

    Letters, numbers and white space are read off the tokenizer library's own Unicode tables, by
    asking it once for all code points, so its version of Unicode is the one that counts.
    """
    import tiktoken

    table = np.full(0x110001, OTHER, dtype=np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    every = points.tobytes().decode("utf-32-le")
    single = {bytes([i]): i for i in range(256)}
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        encoding = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        there = bytes(encoding.encode_ordinary(every)).decode()
        table[np.frombuffer(there.encode("utf-32-le"), dtype="<u4")] = kind
    for letters, kind in (("stmd", S_T_M_D), ("rv", R_V), ("l", ELL), ("e", EE), ("'", QUOTE), (" ", BLANK)):
        for x in letters:
            table[ord(x)] = kind
    table[0x110000] = END
    return table


def _scan(functions: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive products of the monoid elements, blockwise and then over the blocks."""
    _, product, _, _ = _monoid()
    size = int(len(product) ** 0.5)
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = product[int(out[i - 1]) * size + int(out[i])]
        return out
    rows = -(-n // width)
    padded = np.full(rows * width, functions[-1], dtype=np.uint8)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)
    for j in range(1, width):
        grid[j] = product[grid[j - 1].astype(np.intp) * size + grid[j]]
    carried = _scan(grid[-1], width)
    grid[:, 1:] = product[carried[:-1].astype(np.intp)[None, :] * size + grid[:, 1:]]
    return grid.T.ravel()[:n]


def slice_starts(points: np.ndarray) -> np.ndarray:
    """Where slices begin in an array of code points, in which 0x110000 ends each text (and the array)."""
    generators, _, values, begins = _monoid()
    if not len(points):
        return np.empty(0, dtype=np.int64)
    states = values[_scan(generators[class_table()[points]]).astype(np.intp) * _STATES + START]
    code = states.astype(np.intp) * _STATES
    code[1:] += states[:-1].astype(np.intp) * (_STATES * _STATES)
    code[:-1] += states[1:]
    return np.flatnonzero(begins[code])


# ---------------------------------------------------------------- merges

def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of least rank, leftmost first, is joined until none has a rank.

    A heap of pairs with lazy deletion: n log n steps, also for very long slices.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        rank, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] == n or ends[ends[i]] != end:
            continue
        j = ends[i]
        alive[j] = False
        ends[i] = end
        if end < n:
            before[end] = i
            found = ranks.get(piece[i : ends[end]])
            if found is not None:
                heapq.heappush(heap, (found, i, ends[end]))
        h = before[i]
        if h >= 0:
            found = ranks.get(piece[h:end])
            if found is not None:
                heapq.heappush(heap, (found, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Encoder(dict):
    """Slices of texts to packed ids (little-endian unsigned 32-bit); a cache of at most ``most`` slices."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.most = most
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece

    def __missing__(self, piece: str) -> bytes:
        found = np.array(merged(piece.encode(), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= 200:
            if len(self) >= self.most:
                self.clear()
            self[piece] = found
        return found

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """For each text its packed ids and its slices' first code points."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        starts = slice_starts(np.insert(points, ends, 0x110000)) if texts else np.empty(0, dtype=np.int64)
        at = np.searchsorted(ends + np.arange(len(texts)), starts)  # the text of each slice
        starts = starts - at
        cuts = np.append(starts, len(whole)).tolist()
        ids = [self[whole[a:b]] for a, b in zip(cuts, cuts[1:])]
        bounds = np.searchsorted(at, np.arange(len(texts) + 1)).tolist()
        begin = np.concatenate(([0], ends[:-1])) if texts else ends
        return [(b"".join(ids[a:b]), starts[a:b] - begin[k]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]

    def decode(self, packed: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


@lru_cache(2)
def encoder(path: str = RANKS) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


# ---------------------------------------------------------------- operators

def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, ids array<int>, slice_starts array<int>): the ids of each text and the code points where its slices begin."""
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = encoder(ranks).encode(common.texts_of(batch, "text"))
        ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x, _ in done]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([s.astype(np.int32) for _, s in done], pa.list_(pa.int32()))],
            names=["id", "ids", "slice_starts"],
        )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.batches(rows, work)

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, slice_starts array<int>")
    return got.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """(id, decoded binary): the bytes that the ids stand for."""
    kind = dict(encoded.dtypes)[id_col]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            back = [encoder(ranks).decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=["id", "decoded"])

    got = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded binary")
    return got.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids again, and digests both.

    One pass without a shuffle; the id arrays never leave the Python worker.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(ranks)
        done = [x for x, _ in enc.encode(common.texts_of(batch, "text"))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(x) // 4 for x in done], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in done], pa.string()),
                pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in done], pa.string()),
            ],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.batches(rows, work)

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
    return got.withColumnRenamed("id", id_col)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, encoded and decoded."""
    return round_trip(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
