"""Vectorised text blocks shared by the training-data operators.

A *word* is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``. All helpers work on the raw
UTF-8 buffer of an Arrow string column, so the cost per word is a few NumPy passes and no Python
object is made for it. Identity of words and word windows is identity of 64-bit hashes; a false
match needs two different byte strings with one hash, which for 10^12 words stays below 10^-7 per
document.

Memory is bounded by slicing: :func:`slices` cuts an Arrow batch into runs of at most
``SLICE_BYTES`` of text (one longer document makes a run by itself), and :meth:`Words.hashes` works in
segments of that size even inside one document. Python workers are reused by later stages, so what a
task leaves behind would add up: functions handed to Spark are wrapped by :func:`released`, which
gives caches and freed memory back when the task's input ends.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: As many ids (16 MB of longs) may be broadcast; more are joined by a shuffle of both sides.
BROADCAST_IDS = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64; as many as a slice needs are kept."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = np.full(n, _BASE, np.uint64)
            inverse = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
            base[0] = inverse[0] = 1
            np.multiply.accumulate(base, out=base)
            np.multiply.accumulate(inverse, out=inverse)
            if n > 2 * SLICE_BYTES:
                return base, inverse
            self.up, self.down = base, inverse
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns freed memory to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory of this process back, and the powers of the hash base."""
    _POWERS.__init__()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def released(work: Callable[[Iterator], Iterator], *also: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that ends with :func:`release` (after what else is to be called)."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            for call in also:
                call()
            release()

    return run


class Words:
    """Words of an Arrow string column.

    ``first[i]:first[i + 1]`` are the words of row i; ``start`` and ``end`` are byte positions in
    ``data``; ``offset`` are the byte bounds of the rows. Null rows have no words.
    """

    def __init__(self, column: pa.Array) -> None:
        column = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(column)
        bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        raw = column.buffers()[2] if n else None
        self.offset = bounds - bounds[0]
        size = int(self.offset[-1])
        self.data = np.frombuffer(raw, np.uint8, size, int(bounds[0])) if size else np.zeros(0, np.uint8)
        word = ~_SPACE[self.data]
        before = np.zeros(size, bool)
        after = np.zeros(size, bool)
        if size:
            before[1:] = word[:-1]
            before[self.offset[:-1][self.offset[:-1] < size]] = False
            after[:-1] = word[1:]
            after[self.offset[1:][self.offset[1:] > 0] - 1] = False
        self.word_byte = word
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.offset)

    def __len__(self) -> int:
        return len(self.offset) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def count_bytes(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each row for which mask holds."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.offset[1:]] - total[self.offset[:-1]]

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased if asked."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + SLICE_BYTES, "right")))
            part = self.data[base : self.end[to - 1]]
            part = (_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
            up, down = _POWERS.upto(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=total[1:])
            s, e = self.start[at:to] - base, self.end[at:to] - base
            out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _MULT[0])
            at = to
        return out

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each window of so many words within one row."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h += hashes[k : k + n] * _MULT[k]
        rows = self.rows()
        at = np.flatnonzero(rows[:n] == rows[width - 1 :])
        return mix(h[at]), at


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the one set by ``setCheckpointDir``.

    Where neither is set and all of Spark is one local process (tests), it is a temporary folder of this
    machine, removed at exit; on a cluster that would lose rows, so there it is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, folder[7:], True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def persisted(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors.

    The table goes when the application ends, or with :func:`discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    where, system = _path(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`persisted` wrote and that nothing reads any more."""
    for df in tables:
        where, system = _path(df.sparkSession, df.written)
        system.delete(where, True)


def by_ids(rows: DataFrame, ids: DataFrame, how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join of rows with ids (distinct values of one column that rows have too), which are written and counted first.

    Texts needn't move where the ids are few: at most ``most`` are broadcast. Beyond that both sides are shuffled."""
    ids = persisted(ids, "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, ids.columns, how)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % parts, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
