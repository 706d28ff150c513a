"""Packing of tokenised documents into sequences of bounded length by the sum-of-squares rule.

A document's pieces are dealt to groups of bounded size by a salt, so no key, source or group of
copies can make one task large. In a group the pieces are placed from the longest to the
shortest. With N(g) the number of open bins that have room for g more tokens, a piece goes to the
bin that makes the sum of N(g)^2 smallest; a bin is opened only if no open one has room. Rows of
one document never meet anywhere but in their group.

Defined results: null and empty texts are one piece, the end token; equal rows are packed
each for itself; null ids are kept; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs. The bins that a group leaves half full are all that grouping costs.
GROUP = 20_000
#: Words whose ids a Python worker keeps for reuse, up to twice as many. Results don't depend on it: more cost memory, fewer time.
KEPT = 200_000
#: Words of more bytes are not kept for reuse.
LONG = 200


class WordIds(dict):
    """Packed ids of words (bytes without ASCII white space), ``most`` to twice as many of the last ones.

    The tokenizer drops white space and never looks across it, so a text's ids are its words' ids
    one after the other, and the library encodes each distinct word once. Letters and the ASCII
    punctuation behind them are separate for it too; so many unseen words of letters alone are
    encoded as one text and told apart by the ids that end a word. When ``most`` words are
    kept they become the older ones, and those of them that come up again are taken over.
    """

    def __init__(self, path: str, most: int = KEPT):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most, self.older = Tokenizer.from_file(path), most, {}
        self.ends = np.zeros(self.library.get_vocab_size() + 1, dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.tails = {"": b""}

    def _one(self, text: str) -> bytes:
        return self._packed(text).tobytes()

    def _packed(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _letters(self, words: list[str]) -> list[bytes]:
        """Packed ids of words of letters."""
        got = self._packed(" ".join(words))
        cuts = (4 * (np.flatnonzero(self.ends[got]) + 1)).tolist()
        if len(cuts) != len(words):
            return [self._one(w) for w in words]
        packed = got.tobytes()
        return [packed[a:b] for a, b in zip([0, *cuts], cuts)]

    def _known(self, word: bytes) -> bool:
        """Whether the word is kept; an older one is taken over."""
        if word in self:
            return True
        found = self.older.get(word)
        if found is not None:
            self[word] = found
        return found is not None

    def _learn(self, unseen: list[bytes]) -> None:
        cores, tailed = [], []
        for word, text in zip(unseen, b" ".join(unseen).decode().split(" ") if unseen else ()):
            if text.isalpha():
                cores.append(text)
                continue
            core = text.rstrip(string.punctuation)
            if core.isalpha() and len(core) <= LONG:
                tailed.append((word, core.encode(), text[len(core) :]))
            else:
                self[word] = self._one(text)
        there = set(cores)
        cores += [x for x in {c.decode() for _, c, _ in tailed if not self._known(c)} if x not in there]
        for begin in range(0, len(cores), 1000):
            part = cores[begin : begin + 1000]
            self.update(zip(map(str.encode, part), self._letters(part)))
        for word, core, tail in tailed:
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails = {"": b""}
                self.tails[tail] = self._one(tail)
            self[word] = self[core] + self.tails[tail]

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Packed ids of each text; null counts as empty. Arrow numbers the words, so Python sees a slice's distinct ones."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), ""))
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        unseen = [w for w in words if not self._known(w)]
        self._learn(unseen)
        own = list(map(self.__getitem__, words))
        for word in unseen:
            if len(word) > LONG:
                del self[word]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        begins = np.cumsum(sizes) - sizes
        n = sizes[place]
        ends = np.concatenate(([0], np.cumsum(n)))
        where = np.repeat(begins[place] - ends[:-1], n) + np.arange(ends[-1])
        packed = np.frombuffer(b"".join(own), dtype="<u4")[where].tobytes()
        cuts = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]


def word_ids(path: str = TOKENIZER, most: int = KEPT) -> WordIds:
    return common.held(f"{most} words of {path}", lambda: WordIds(path, most))


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, kept: int = KEPT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end token, cut after every ``capacity`` ids."""
    kind = dict(docs.dtypes)["doc_id"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, piece, start, length, crc = [], [], [], [], []
        for row, packed in enumerate(word_ids(tokenizer, kept).ids(batch.column(1))):
            packed += end
            for k, begin in enumerate(range(0, len(packed), 4 * capacity)):
                part = packed[begin : begin + 4 * capacity]
                rows.append(row)
                piece.append(k)
                start.append(begin // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return common.batches(rows, work, chars=1_000_000)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by the sum-of-squares rule from the longest to the shortest.

    Moving a bin from gap g to gap g - s changes the sum of squares by 2 (N(g - s) - N(g)) + 2, or by
    1 - 2 N(g) if it fills the bin. Among equal changes the smallest gap is taken.
    """
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros(capacity + 1, dtype=np.int64)  # N; index 0 stays 0, as full bins aren't open
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    far = np.iinfo(np.int64).max
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        there = counts[size:]
        change = 2 * (counts[: capacity + 1 - size] - there) + 2
        change[0] -= 1
        change[there == 0] = far
        gap = int(change.argmin()) + size
        if counts[gap]:
            where = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            where, gap, n_bins = n_bins, capacity, n_bins + 1
        bins[item], offsets[item] = where, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            open_bins[gap - size].append(where)
    return bins, offsets


def packed(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of at most ``capacity``.

    ``cut`` should be a written table: the salt is a row's place in it.
    """
    groups = max(1, -(-cut.count() // group))
    names = cut.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id bigint, offset bigint"

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        bins, offsets = pack(rows.column("length").to_numpy().astype(np.int64), capacity)
        ids = bins + (int(key[0].as_py()) << 32)
        return rows.select(names).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    salted = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return salted.groupBy("_group").applyInArrow(one, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_ID, group: int = GROUP, kept: int = KEPT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    return packed(common.written(pieces(docs, capacity, tokenizer, end_id, kept), "pieces"), capacity, group)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, packed into sequences of 4096 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
