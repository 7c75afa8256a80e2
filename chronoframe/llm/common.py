"""Shared plumbing: scratch tables on shared storage, Arrow text buffers and packed columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BARE = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local one serves a driver that runs
    its own tasks; on a cluster other executors could not read it, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chronoframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables that cut lineage. They live in the shared folder, so a lost executor
    costs only the tasks it ran; leftovers are removed when the driver ends."""

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        """``lean``: shuffle files go as soon as the table that needed them is written, not when the driver's
        garbage collection finds their plan; tables get no marker file."""
        self.spark = spark
        self.lean = lean
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _made[self.root] = spark
        self._n = 0
        self._paths: dict[int, str] = {}
        #: Files to a table at most; None: one for each task.
        self.files: int | None = None

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the written table."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        few = self.files and self.files < int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        was = self.spark.conf.get(_CLEAN, None)
        if self.lean:
            self.spark.conf.set(_CLEAN, "true")
        try:
            (df.coalesce(self.files) if few else df).write.options(**_BARE if self.lean else {}).parquet(path)
        finally:
            if self.lean:
                self.spark.conf.unset(_CLEAN) if was is None else self.spark.conf.set(_CLEAN, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def sized(self, size: int, each: int | None = None) -> None:
        """Later tables follow ``size`` bytes of data, not the shuffle partitions: a file for each ``each`` (``AT_ONCE``) and
        two for each core. A local file without Hadoop's native library costs forks of the executor, too."""
        self.files = max(2 * self.spark.sparkContext.defaultParallelism, -(-size // (each or AT_ONCE)))

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table of this scratch that no later plan reads."""
        if path := self._paths.pop(id(df), None):
            _drop(self.spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more. Spark removes them when the
    driver collects its garbage; a driver with little to do would keep them until the end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Let the executors' JVMs collect their garbage and return the heap and classes that it took. They
    would keep what earlier steps filled beside the Python workers of the next. One short task for each core."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def release(spark: SparkSession) -> None:
    """Remove the scratch tables of this session. For long sessions, once the results that read them
    are written; a result that was not is lost with them."""
    for path in [p for p, s in _made.items() if s is spark]:
        _drop(spark, path)
        del _made[path]


@atexit.register
def _sweep() -> None:
    for path, spark in _made.items():
        try:
            _drop(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


def id_hash(col: Column | str) -> Column:
    """crc32 of the id written as text; a null id hashes like the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")))


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets into them; null reads as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    if array.null_count:
        array = array.fill_null(b"")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1 + array.offset)[array.offset :]
    first, last = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8, last)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return body, offsets - first


def tidy(run):
    """``run`` over Arrow batches, after which a task's worker gives back what it holds: idle workers count too."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return out


def spans(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``target`` bytes (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def small(batches, k: int, target: int | None = None):
    """The batches cut into runs of about ``target`` bytes (``AT_ONCE``) of column ``k``, so that a task holds little at once."""
    for b in batches:
        for i, j in spans(text_buffer(b.column(k).cast(pa.large_string()))[1], target or AT_ONCE):
            yield b.slice(i, j - i)


# Columns of many small rows travel as packed binaries, one or more for each bucket.
DEALT = "kind int, part int, blob binary"
#: Buckets up to which rows are dealt at once; more are dealt by groups of buckets first.
FAN = 1024
#: Bytes of texts that a task works on at once, where its batches are cut.
AT_ONCE = 4 << 20
#: Bytes that a task of the second dealing gathers before it deals them on.
GATHERED = 96 << 20


def pack(*cols: np.ndarray) -> bytes:
    return np.int64(len(cols[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in cols)


def unpack(blobs, kinds: list) -> list[np.ndarray]:
    """The columns of packed binaries, one after another; ``kinds`` are (type, width)."""
    parts: list[list] = [[] for _ in kinds]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for k, (t, width) in enumerate(kinds):
            x = np.frombuffer(blob, t, n * width, at)
            parts[k].append(x.reshape(n, width) if width > 1 else x)
            at += x.nbytes
    return [np.concatenate(p) if p else np.zeros((0, w) if w > 1 else 0, t) for p, (t, w) in zip(parts, kinds)]


def deal(kind: int, part: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """Rows (kind, part, blob) of the parts that occur."""
    order = np.argsort(part, kind="stable")
    sorted_part = part[order]
    edge = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    blobs = [pack(*[c[order[a:z]] for c in cols]) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(blobs), pa.int32()), pa.array(sorted_part[edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "part", "blob"])


def fan(parts: int, times: int = 1) -> int:
    """Buckets to a group of the first dealing; 1 where all rows are dealt at once, up to FAN ``times`` as often."""
    return 1 if parts <= FAN * times else math.isqrt(parts - 1) + 1


def dealt_again(rows: DataFrame, parts: int, own: dict[int, tuple[list, object]], times: int = 1) -> DataFrame:
    """Rows dealt by groups of ``fan(parts, times)`` buckets (part // fan) -> rows dealt by bucket, so that no task
    cuts its rows in more than about sqrt(parts) pieces. ``own`` has, by kind, the types of the columns and
    a function of them that gives each row's bucket."""
    if fan(parts, times) == 1:
        return rows

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            for kind, blobs in held.items():
                kinds, part = own[kind]
                cols = unpack(blobs, kinds)
                yield deal(kind, part(*cols), *cols)

        for b in batches:
            for kind, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                held.setdefault(kind, []).append(blob)
                size += len(blob)
                if size > GATHERED:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return rows.repartition("kind", "part").mapInArrow(run, DEALT)


#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The same with ASCII white space and punctuation as blanks: what is left are words.
WORDS = LOWER.copy()
WORDS[[c for c in range(128) if not chr(c).isalnum()]] = 32
