"""Document quality by a factorisation machine (Rendle, Factorization Machines, 2010).

Features are hashed words with damped counts, statistics of the text's structure, and its length as
metadata; labels, language, source and id are never among them. The score is the logistic of
    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
so pairwise interactions cost time linear in the features of a document.

The machine is trained here, by Adagrad on the driver, on a bounded sample: the ``sample`` labelled
rows whose hash comes first. Executors send their hashed features, never texts. Scoring is one pass
over the documents without a shuffle; the broadcast model has a fixed size.

Defined results: null and empty texts are scored from their (empty) features; a null id counts as the
empty text in the fold; equal rows have equal results; without usable labels the score is 0.5;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hashed word slots, rank of the interactions, folds, labelled rows to learn from, decision threshold.
SLOTS, RANK, FOLDS, SAMPLE, THRESHOLD = 1 << 15, 8, 5, 3000, 0.3

STATISTICS = (
    "bias", "log_words", "log_chars", "distinct_words", "top_word", "repeated_neighbours", "mean_word", "long_words", "upper_letters", "upper_words", "title_words",
    "digits", "white_space", "punctuation", "word_ends_odd", "sentence_ends", "distinct_lines", "short_lines", "line_ends_plain", "bars", "not_ascii",
)
_PLAIN = frozenset(b".,;:!?")


def features(text: str, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: the statistics come first, then the words' slots."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    stats = np.zeros(len(STATISTICS))
    stats[0] = 1
    if not n:
        return np.arange(len(STATISTICS)), stats
    counts = Counter(words)
    kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    digits, blank = int(kinds[48:58].sum()), int(kinds[9:14].sum() + kinds[32])
    odd = sum(c for w, c in counts.items() if w[-1] < 128 and not w[-1:].isalnum() and w[-1] not in _PLAIN)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stats[1:] = (
        np.log1p(n) / 8, np.log1p(size) / 10, len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, (size - blank) / n / 10,
        sum(c for w, c in counts.items() if len(w) > 24) / n, upper / max(1, upper + lower), sum(c for w, c in counts.items() if w.isupper()) / n, sum(c for w, c in counts.items() if w[:1].isupper()) / n,
        digits / size, blank / size, (int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())) / size, odd / n,
        sum(c for w, c in counts.items() if w[-1] == 46) / n, len(set(lines)) / max(1, len(lines)), sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        sum(x[-1] in _PLAIN for x in lines) / max(1, len(lines)), int(kinds[124]) / n, int(kinds[128:].sum()) / size,
    )
    table: dict[int, int] = {}
    for word, c in counts.items():
        slot = zlib.crc32(word.lower()) % slots
        table[slot] = table.get(slot, 0) + c
    value = np.log1p(np.fromiter(table.values(), dtype=np.float64, count=len(table)))
    value /= np.sqrt((value * value).sum())
    index = np.fromiter(table.keys(), dtype=np.int64, count=len(table)) + len(STATISTICS)
    return np.concatenate((np.arange(len(STATISTICS)), index)), np.concatenate((stats, value))


class Machine:
    """Linear weights w (n) and factors v (n, rank); the bias is feature 0."""

    def __init__(self, w: np.ndarray, v: np.ndarray):
        self.w, self.v = w, v

    @classmethod
    def new(cls, size: int, rank: int, seed: int = 0) -> Machine:
        return cls(np.zeros(size), np.random.default_rng(seed).normal(0, 0.02, (size, rank)))

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        xv = self.v[index] * value[:, None]
        total = xv.sum(axis=0)
        return float(self.w[index] @ value + 0.5 * ((total * total).sum() - (xv * xv).sum()))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(index, value), -35, 35))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, rate: float = 0.1, decay: float = 1e-5, seed: int = 0) -> None:
        """Adagrad, one row at a time, on the logistic loss with both classes weighted alike."""
        rng = np.random.default_rng(seed)
        gw, gv = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2)
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
        for _ in range(epochs):
            for k in rng.permutation(len(rows)).tolist():
                index, value = rows[k]
                xv = self.v[index] * value[:, None]
                total = xv.sum(axis=0)
                z = self.w[index] @ value + 0.5 * ((total * total).sum() - (xv * xv).sum())
                slope = weight[k] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[k])
                dw = slope * value + decay * self.w[index]
                dv = slope * value[:, None] * (total - xv) + decay * self.v[index]
                gw[index] += dw * dw
                gv[index] += dv * dv
                self.w[index] -= rate * dw / np.sqrt(gw[index])
                self.v[index] -= rate * dv / np.sqrt(gv[index])


def _features_of(docs: DataFrame, slots: int) -> DataFrame:
    """(quality, index, value) of labelled documents."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(x, slots) for x in common.texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
            names=["quality", "index", "value"],
        )

    return docs.select("quality", "text").mapInArrow(lambda rows: common.batches(rows, work), "quality int, index array<int>, value array<float>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, slots: int = SLOTS, rank: int = RANK, folds: int = FOLDS) -> Machine:
    """A machine fitted to at most ``sample`` labelled documents outside fold 0, those whose id's hash comes first."""
    machine = Machine.new(len(STATISTICS) + slots, rank)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (common.remainder("doc_id", folds) != 0))
    chosen = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    # an id may be on many rows: its least text stands for it, and the driver gets ``sample`` rows at most
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    got = _features_of(texts, slots).toArrow()
    y = got.column("quality").to_numpy().astype(np.float64)
    rows = [(i.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(np.float64)) for i, v in zip(got.column("index"), got.column("value"))]
    order = sorted(range(len(rows)), key=lambda k: (y[k], rows[k][1].tobytes()))  # whatever order they came in
    if len(set(y.tolist())) == 2:
        machine.fit([rows[k] for k in order], y[order])
    else:
        machine.v[:] = 0
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, slots: int = SLOTS) -> DataFrame:
    """``docs``' rows as (doc_id, row_hash, score, predicted); row_hash is the text's."""
    kind = dict(docs.dtypes)["doc_id"]
    model = docs.sparkSession.sparkContext.broadcast((machine.w.astype(np.float32), machine.v.astype(np.float32)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("machine")  # lets go of what other operators left
        w, v = model.value
        own = Machine(w.astype(np.float64), v.astype(np.float64))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [own.score(*features(x, slots)) for x in common.texts_of(batch)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "row_hash", "score", "predicted"],
            )

        return common.batches(rows, work)

    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"))
    return keyed.mapInArrow(run, f"doc_id {kind}, row_hash bigint, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, slots: int = SLOTS) -> DataFrame:
    """``docs`` with its columns, without the documents that the machine rejects. Scored in the pass that filters: no join, no shuffle."""
    machine = train(docs, labels, slots=slots)
    model = docs.sparkSession.sparkContext.broadcast((machine.w.astype(np.float32), machine.v.astype(np.float32)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("machine")  # lets go of what other operators left
        w, v = model.value
        own = Machine(w.astype(np.float64), v.astype(np.float64))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([own.score(*features(x, slots)) >= threshold for x in common.texts_of(batch, text)], pa.bool_()))

        return common.batches(rows, work, text)

    text = f"c{docs.columns.index('text')}"
    return common.numbered(docs).mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from ``labels`` outside fold 0."""
    docs = common.table(spark, sf_dir, "documents")
    machine = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", (common.remainder("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
