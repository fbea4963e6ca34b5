"""What several operators share: scratch tables, Arrow text buffers, rolling hashes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Characters that separate words in most contracts: space, \t \n \v \f \r.
SPACES = " \t\n\x0b\f\r"
#: Stands for a null key wherever keys are ordered.
NULL_ID = -(2**63)


#: Rows of an Arrow batch. Texts have a few KB and some several MB, so Spark's default of 10 000 rows is too many.
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, unless the session has a size of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, ARROW_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session that sets none (as in tests) gets a local folder; on a
    cluster other machines could not read it, so there the setting is asked for.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints", "pixelmill")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        pass


class Table:
    """A DataFrame written as Parquet in the shared folder, so that lineage ends here.

    Losing an executor costs only the tasks it ran; the rows survive it.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.path = f"{scratch_dir(self.spark)}/t-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(_remove_quietly, self.spark, self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def shared(spark: SparkSession, value):
    """A broadcast of bytes, opened by ``pickle.loads``: with the classes of this package by value, so workers need no copy of it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, end to end, and the len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def blocks(offsets: np.ndarray, limit: int):
    """Ranges of rows with about ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (multiply, xor-shift)."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Random words for each byte value, so that no byte structure reaches the polynomials; two independent sets.
BYTE_WORDS = [_RNG.integers(0, 2**64, 256, np.uint64), _RNG.integers(0, 2**64, 256, np.uint64)]
BASE = [0x9E3779B97F4A7C15 | 1, int(_RNG.integers(0, 2**63)) * 2 + 1]
INVERSE = [pow(b, -1, 2**64) for b in BASE]
#: Powers of the bases found so far, kept up to this many.
_POWERS: dict[int, np.ndarray] = {}
KEPT_POWERS = 1_100_000


def powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= KEPT_POWERS:
            _POWERS[base] = known
    return known[:n]


class Rolling:
    """Hashes of any byte ranges of one buffer, from one prefix sum modulo 2**64; ``which`` of two polynomials."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        self.inverse = powers(INVERSE[which], n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_WORDS[which][data] * powers(BASE[which], n), out=self.prefix[1:])

    def fixed(self, k: int) -> np.ndarray:
        """Mixed hashes of all windows of k bytes."""
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, np.uint64)
        return mix64((self.prefix[k:] - self.prefix[: n - k + 1]) * self.inverse[: n - k + 1])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start] + mix64((end - start).astype(np.uint64)))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = True
_IN_WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts (runs of ASCII letters, digits and bytes over 127;
    A-Z read as a-z) in order, and the len + 1 offsets of each text's words."""
    inside = _IN_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashed = Rolling(_LOWER[data]).spans(start, end) if len(start) else np.zeros(0, np.uint64)
    return hashed, np.searchsorted(start, offsets)
