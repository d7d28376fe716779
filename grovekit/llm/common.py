"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in every contract: space and \t \n \v \f \r.
WORD_BREAKS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session on a single machine without one (as in tests) gets a temporary folder; a cluster without one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return tempfile.mkdtemp(prefix="checkpoints")


def checkpointed(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    With ``free`` the shuffle files it came from go at once: Spark deletes them when the driver's garbage
    collector finds them unused, which may otherwise take long.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    written = df.checkpoint(eager=True)
    if free:
        context._jvm.System.gc()
    return written


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python ``rows`` at a time, unless the session says otherwise: Spark's 10,000 texts, held by executor and worker at once, are too many."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back: workers wait for later tasks beside others that need it."""

    def trimmed(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return trimmed


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets a name of an operator's own columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def rows_kept(docs: DataFrame, keep: Callable[[Iterator[pa.Array]], Iterator[list[bool]]]) -> DataFrame:
    """The rows of ``docs(text, ...)`` whose text ``keep`` says stays, with all their columns, in one pass and without a shuffle.

    ``keep`` gets arrays of texts and gives a truth value for each. Only the texts go to Python; equal rows are rows of their own.
    """

    small_batches(docs.sparkSession)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for stays in keep(parts):
            yield pa.array(stays, pa.bool_())

    return docs.where(F.arrow_udf(run, "boolean")(F.col("text").cast("string")))


def salted(df: DataFrame, salts: int, by: Column | None = None, hot: Column | None = None) -> DataFrame:
    """``df`` with a column ``salt``: of a large side, ``by`` modulo ``salts``; without ``by``, of a small side, one copy of each row per salt.

    With ``hot``, which must say the same of a key on both sides, only keys for which it is true are dealt out.
    """
    hot = F.lit(True) if hot is None else hot
    if by is None:
        return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, salts - 1).otherwise(0))))
    return df.withColumn("salt", F.when(hot, F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs that end inside delete their shuffle files at once, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ascii_lower(column):
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(column="text"):
    """With doc_id it names a row: rows equal in both give equal results."""
    return F.xxhash64(F.col(column))


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased: bytes.split() breaks at exactly WORD_BREAKS."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: A-Z lower-cased, and all of WORD_BREAKS as spaces.
_PLAIN = bytes.maketrans(b"\t\n\v\f\r" + bytes(range(65, 91)), b" " * 5 + bytes(range(97, 123)))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``words_of`` for all texts (null: none) at once: where each text's words begin and the last one's end, and all words."""
    texts = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    held = bytes(texts.buffers()[2][bounds[0] : bounds[-1]]) if bounds[-1] > bounds[0] else b""
    bounds = bounds - bounds[0]
    data = np.frombuffer(held.translate(_PLAIN), np.uint8)
    inside = data != 32
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = ~inside[:-1]
    first[bounds] = True  # a word ends with its text
    starts = np.flatnonzero(first[:-1] & inside)
    last = first[1:]
    last[:-1] = ~inside[1:]
    last[-1:] = True
    last[bounds[bounds > 0] - 1] = True
    sizes = np.flatnonzero(last & inside) + 1 - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    return np.searchsorted(starts, bounds), words


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in text order; fewer words make one shingle of them all."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[j : n - width + 1 + j]
    return mixed(total)
