"""Vectorised text primitives shared by the corpus operators.

All of them work on the flat byte buffer of an Arrow string column, one bounded slice of rows at a
time, so that the cost of a document is a few numpy passes over its bytes and memory stays flat
however large an Arrow batch is. A null text is treated as an empty one here; operators decide what
a null means for their result.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BASE = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def _table(members) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(members)] = True
    return t


#: bytes that separate words for span operators: ASCII white space
SPACE = _table([9, 10, 11, 12, 13, 32])
#: bytes that make up folded words: ASCII letters and digits, and every byte of a non-ASCII character
WORDCHAR = _table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
#: ASCII upper case to lower case, all other bytes unchanged
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2^64, grown on demand."""
    global _powers
    if len(_powers) < n:
        m = 1 << (n - 1).bit_length()
        out = np.full(m, _BASE, dtype=np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    """``mix`` for one Python integer."""
    x &= _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def text_array(column) -> pa.Array:
    """One contiguous array with int64 offsets from 0 and no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.large_string())


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a large_string array; the offsets index the returned bytes."""
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
    return raw[lo:hi], (off - lo if len(off) else np.zeros(1, np.int64))


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold at most ``limit`` bytes, or a single row above that."""
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, len(arr))
        lo = hi


class Words:
    """Words of consecutive rows: ``start`` and ``end`` byte offsets, ``first`` word index of each row."""

    __slots__ = ("data", "row_off", "start", "end", "first")

    def __init__(self, data: np.ndarray, row_off: np.ndarray, member: np.ndarray):
        inside = member[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[0], edge[-1] = True, True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        edge[row_off] = True
        cuts = np.flatnonzero(edge)
        keep = inside[cuts[:-1]] if len(data) else np.zeros(0, bool)
        self.data, self.row_off = data, row_off
        self.start, self.end = cuts[:-1][keep] if len(data) else cuts[:0], cuts[1:][keep] if len(data) else cuts[:0]
        self.first = np.searchsorted(self.start, row_off)

    def __len__(self) -> int:
        return len(self.start)

    def lengths(self) -> np.ndarray:
        return self.end - self.start

    def rows(self) -> np.ndarray:
        """Row index of each word."""
        return np.repeat(np.arange(len(self.row_off) - 1), np.diff(self.first))

    def hashes(self, fold: bool = False) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = self.lengths()
        if not len(n):
            return np.zeros(0, np.uint64)
        total = int(n.sum())
        rel_start = np.cumsum(n) - n
        rel = np.arange(total) - np.repeat(rel_start, n)
        b = self.data[rel + np.repeat(self.start, n)]
        if fold:
            b = FOLD[b]
        v = powers(int(n.max()) + 1)[rel] * (b.astype(np.uint64) + np.uint64(1))
        return mix(np.add.reduceat(v, rel_start) + n.astype(np.uint64))

    def strings(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


def words_of(arr: pa.Array, member: np.ndarray) -> Words:
    return Words(*flat(arr), member)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values of ``h``; rows must be told apart by the caller."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += h[j : len(h) - k + 1 + j]
    return mix(out)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker that is used again holds what its largest task took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 seen as int64, for Spark's LONG."""
    return x.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir`` of the session).

    Where the session names none, a local master gets a temporary folder as its checkpoint directory; a
    cluster must name one, since executors don't share a machine's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millstone-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one run in the shared folder: they cut lineage, survive lost executors, and can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_dir(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a Parquet table. Shuffle files go as soon as it is written."""
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of a run of its own."""
    return Scratch(df.sparkSession, name).keep(df, "rows")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` with its batches mapped to batches of the same columns, whatever the names of these."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        named = (pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches)
        for out in fn(named):
            yield pa.RecordBatch.from_arrays(out.columns, names=[f"c{i}" for i in range(len(names))])

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
