"""What the operators of this subpackage share: tables, scratch space, text batches and hashes."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


#: Bytes of rows that Spark hands to Python at once, whatever the length of texts; several copies of them are in memory.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what each Arrow batch of this session holds. Results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: Rows that a scan of Parquet decodes at once: of long texts the default of 4096 is tens of MB for each task.
READ_ROWS = 512


def small_reads(spark: SparkSession) -> None:
    """Bounds what each scan of Parquet in this session holds. Results don't depend on it.

    Vectored reads are off, as threads that outlive the tasks keep, outside the heap, a buffer as large as the largest column of a row group.
    """
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name``; any path that Spark's readers open will do."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and all runs in one process (tests) a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fathomweb-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        pass


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there.

    The files outlive any executor, and go when the driver's Python ends, or earlier by ``discard``. ``by``: a column of few values that gets folders.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{_shared_folder(spark)}/fathomweb-{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    atexit.register(_delete, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` made and nothing reads any longer."""
    for made in tables:
        _delete(made.sparkSession, made._written_to)


def release_shuffles(spark: SparkSession) -> None:
    """Asks the driver's JVM to let go of shuffle files no plan refers to any longer."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(rows: Iterable[pa.RecordBatch], text: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about ``chars`` bytes of text (or entries of lists) at most, one row at least."""
    for batch in rows:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + chars, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def batches(
    rows: Iterable[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", chars: int = 4_000_000
) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` on each of the slices. A Python worker that waits for its next task then holds no free memory."""
    for part in slices(rows, text, chars):
        made = work(part)
        if made is not None and made.num_rows:
            yield made
    release_memory()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for reuse; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 150_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word, self.seed)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def release_memory() -> None:
    """Gives what is free in this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object] | None = None) -> object:
    """What a Python worker keeps from batch to batch and task to task under ``name``. It keeps one thing: another name lets go of the earlier."""
    if name not in _held:
        _held.clear()
        release_memory()
        _held[name] = make() if make else None
    return _held[name]


def word_hashes() -> WordHashes:
    """One for a Python worker, whichever operators it works for."""
    return held("word hashes", WordHashes)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has columns of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their names, whatever characters those hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: Arrow functions don't take all the names that tables do."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def remainder(doc_id: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))
