"""What the operators of this subpackage share: staging, batches of bytes and rolling hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time; bounds a worker's memory.
BATCH_BYTES = 2 << 20
#: Odd multiplier of the polynomial hashes, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: BASE * INVERSE = 1 modulo 2**64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a new one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="tapeline-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tapeline/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(release)
    _staged.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder through Spark's own file system layer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def release() -> None:
    """Remove every staged path; results that still read them are lost."""
    while _staged:
        spark, path = _staged.pop()
        try:
            delete(spark, path)
        except Exception:  # the session has ended before Python has
            return


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that stage() returned; nothing may read them any more."""
    for df in frames:
        delete(df.sparkSession, df.staged_path)
        _staged.remove((df.sparkSession, df.staged_path))


def staged_so_far() -> int:
    return len(_staged)


def sweep(since: int, *keep: DataFrame) -> None:
    """Delete what was staged after staged_so_far() gave `since`, but for the frames to keep.

    The list is the process's own, so operators that stage tables must not run in several threads of one driver.
    """
    kept = {df.staged_path for df in keep}
    for spark, path in _staged[since:]:
        if path not in kept:
            delete(spark, path)
    _staged[since:] = [x for x in _staged[since:] if x[1] in kept]


def free(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now; it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def rows_in(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that text operators read, as doc_id and text, without rows that have no id."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return a worker's free memory to the system, which allocators otherwise keep for the worker's next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task, which gives memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of the column; a longer value stands alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = utf8(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < n:
            high = int(np.searchsorted(at, at[low] + most, "right")) - 1
            high = min(n, max(low + 1, high))
            yield batch.slice(low, high - low)
            low = high


_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps for each base.
KEPT_POWERS = 1 << 22


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; not to be written to."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        kept = np.full(max(n, 1024), base, np.uint64)
        kept[0] = 1
        kept = np.multiply.accumulate(kept)
        if n <= KEPT_POWERS:
            _powers[int(base)] = kept
    return kept[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of bytes follows: the value plus one of each byte times BASE to its place."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=total[1:])
    return total


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of k values, built by doubling: h(a+b) = h(a) * BASE**b + h(b)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, step, size = None, 0, values.astype(np.uint64) + np.uint64(1), 1
    factor = BASE
    left = k
    while True:
        if left & 1:
            if out is None:
                out, done = step, size
            else:
                m = len(values) - (done + size) + 1
                shifted = np.uint64(pow(int(BASE), size, 1 << 64))
                out = out[:m] * shifted + step[done : done + m]
                done += size
        left >>= 1
        if not left:
            return out[:n]
        m = len(values) - 2 * size + 1
        step = step[:m] * factor + step[size : size + m]
        factor = np.uint64(int(factor) * int(factor) % (1 << 64))
        size *= 2


def lane_concat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of every lane, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
