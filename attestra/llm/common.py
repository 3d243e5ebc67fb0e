"""Shared plumbing: shared scratch space, table reads, Arrow text blocks, word and rolling hashes.

Scratch tables live under ``spark.checkpoint.dir``, the one folder that the driver and all
executors share.  They are plain Parquet written through Spark's commit protocol, so a lost
executor costs a task retry and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LIBC = ctypes.CDLL(None)

#: Text is processed in blocks of about this many bytes, so numpy temporaries stay in cache.
BLOCK_BYTES = (1 << 20) - 1
#: Bytes of an Arrow batch that passes between the JVM and a Python worker, a long row aside.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="attestra-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    bound_batches(spark)
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` to shared scratch, in ``parts`` files at most, and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df = df if parts is None else df.coalesce(parts)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES``: both sides keep whole batches, 64 MB each by default."""
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now: they go when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Return memory that the driver's JVM has freed outside its heap to the system; False where it can't.

    Hundreds of threads handle the broadcasts and stages of many rounds, and the C library keeps
    what each has freed.
    """
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    try:
        kinds = array(jvm.java.lang.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(name)
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        values = array(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except (Py4JError, TypeError):  # another system or an older JVM
        return False
    return True


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the scratch files behind a materialized frame that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


# --------------------------------------------------------------------------- Arrow text blocks


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and row offsets of a string or binary array; null rows come out empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yield ``(first_row, bytes, offsets)`` for runs of rows of at most ``limit`` bytes, or one long row."""
    data, offsets = raw_bytes(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and would keep each pass's peak."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_LIBC, "malloc_trim", None)) is not None:
        trim(0)


# --------------------------------------------------------------------------- hashing

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    forth, back = _powers(size)
    return forth[:n], back[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the splitmix step)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash mod 2**64; see ``span_hash``."""
    forth, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * forth[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span ``[start, end)``; equal bytes hash equally wherever they stand."""
    _, back = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ``[^\\x20\\x09-\\x0D]+`` and, per row, the index of its first word (n + 1 values)."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of a block, and each row's first word index."""
    starts, ends, first = word_spans(data, offsets)
    return span_hash(prefix_hash(data), starts, ends), first


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (rows are not told apart here)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 0xD6E8FEB86659FD93
    for j in range(width):
        out += words[j : j + n] * np.uint64(pow(factor, j + 1, 1 << 64))
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
