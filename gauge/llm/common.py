"""Helpers that the corpus operators share: the cluster's shared folder and numpy word hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where checkpoints go when the session names no folder (tests, a single machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/gauge"

WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []

#: Bytes of texts whose words are looked for at once, or of one longer text; bytes that are hashed at once.
RUN_BYTES, HASHED_BYTES = 1 << 20, 1 << 18

#: A byte's value in a hash, ASCII capitals folded; never 0.
FOLD = np.arange(1, 257, dtype=np.uint64)
FOLD[0x41:0x5B] = FOLD[0x61:0x7B]
#: Bytes of words: everything but the six ASCII white-space characters.
NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[list(WHITE_SPACE)] = False


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a local one, if this machine is all there is."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = LOCAL_CHECKPOINTS
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a checkpoint in the shared folder, which outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of the batches that Python gets while a table is written: a batch of whole texts, on both sides, must stay small.
BATCH_ROWS = 2000
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, Arrow batches of actions that start here have at most so many rows; the session's setting comes back."""
    before = spark.conf.get(BATCHES)
    spark.conf.set(BATCHES, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


class Tables:
    """Named Parquet tables in a folder of their own below the shared one; they outlive any executor.

    A table is removed when nothing reads it any more: a name that is kept again, or dropped, loses its old rows.
    Few rows in many files are read in few partitions.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        with small_batches(self.spark):
            df.write.option("compression", "none").parquet(path)  # numbers and hashes, which do not compress
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove(self.spark, self.paths.pop(name))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> F.Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


#: Caches that outlive a task in its Python worker; tasks that read bytes, which need none, empty them.
worker_caches: list[dict] = []


def binary_column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow array, one after another, and the offsets of its values."""
    for cache in worker_caches:
        cache.clear()
    pa.default_memory_pool().release_unused()
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(array) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system; without it a worker that idles holds its largest task's."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function, after whose last batch the worker gives its freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values with at most ``most`` bytes together, or one longer value."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, HASHED_BYTES)
        steps, back = np.full(size, _P, dtype=np.uint64), np.full(size, _P_INVERSE, dtype=np.uint64)
        steps[0] = back[0] = 1
        _powers[:] = [np.multiply.accumulate(steps), np.multiply.accumulate(back)]
    return _powers[0], _powers[1]


class Words:
    """Words of some texts: for each its text's position, its place in the bytes, and on demand hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_WHITE):
        inside = is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        first[full] = inside[full]
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self._data = data

    def hashes(self, *longest: int, piece: int = HASHED_BYTES) -> list[np.ndarray]:
        """64-bit hashes of whole words, and of their first k bytes for each k in ``longest``."""
        out = [np.empty(len(self.start), dtype=np.uint64) for _ in range(1 + len(longest))]
        at = 0
        while at < len(self.start):  # slices bound the memory for very long texts
            end = max(at + 1, int(np.searchsorted(self.end, self.start[at] + piece, side="right")))
            base = self.start[at]
            data = FOLD[self._data[base : self.end[end - 1]]]
            power, inverse = _power_tables(len(data) + 1)
            total = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(data * power[: len(data)], out=total[1:])
            start, stop = self.start[at:end] - base, self.end[at:end] - base
            back, before = inverse[start], total[start]
            out[0][at:end] = mix((total[stop] - before) * back)
            for i, k in enumerate(longest, 1):
                out[i][at:end] = mix((total[np.minimum(stop, start + k)] - before) * back)
            at = end
        return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit hashes of k words in a row (fewer words: of all; none: empty)."""
    for lo, hi in runs(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        words = Words(data[offsets[lo] : offsets[hi]], own)
        h = words.hashes()[0]
        bound = np.searchsorted(words.text, np.arange(hi - lo + 1))
        n = max(0, len(h) - k + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            rolled += h[j : j + n] * np.uint64((0xC2B2AE3D27D4EB4F * (2 * j + 1) + 2 * j) & (2**64 - 1) | 1)
        rolled = mix(rolled)
        for i in range(hi - lo):
            a, b = bound[i], bound[i + 1]
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                whole = np.array([b - a], dtype=np.uint64)
                for i_word in range(a, b):
                    whole = mix(whole * np.uint64(31) ^ h[i_word : i_word + 1])
                yield whole
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that stand for a set of hashes."""
    a, b = mix(hashes ^ np.uint64(0x51ED270B9F1B5E5D)).sum(dtype=np.uint64), mix(hashes + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
