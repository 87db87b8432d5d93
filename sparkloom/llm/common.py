"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver's own threads, gets a
    folder of its own where none is named; a cluster without one is an error.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder: columnar and compressed, for many narrow rows. ``options``: of the writer."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(*frames: DataFrame) -> None:
    """Removes the tables of materialised() that the frames read. No frame that is still to be computed may read them."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.fullmatch(r".*/tables/[0-9a-f]{32}", folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Rows and bytes that a Python worker of this session is sent at a time from now on: texts and lists can be long, and Spark's defaults are far larger."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_KEPT = "_sparkloom_kept_"


def remembered(name: str) -> dict:
    """What tasks of this Python worker remember for later ones under a name, until a task of ``lean`` makes room."""
    return sys.modules.setdefault(_KEPT + name, types.ModuleType(_KEPT + name)).__dict__


def return_memory() -> None:
    """Free memory of this process goes back to the system; C's allocator would keep tens of MB of freed arrays."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of mapInPandas in a worker that forgets what other operators' tasks remembered, and returns its free memory before and after.

    Workers outlive their tasks, so that a stage would otherwise take its memory on top of what the stages before it have left.
    """

    def task(batches: Iterator) -> Iterator:
        for name in [m for m in sys.modules if m.startswith(_KEPT)]:
            sys.modules.pop(name)
        return_memory()
        yield from run(batches)
        return_memory()

    return task


BUCKETS = 1 << 18


def likely(df: DataFrame, ids: DataFrame, column: str, key: str | None = None, inverse: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Rows of df whose ``column`` may be among the ``key`` (by default of the same name) of ids: a filter by hash bucket, ahead of an exact join.

    The bucket table has at most ``buckets`` rows, so it is broadcast at any size
    of ids; when it is full it filters nothing and the exact join still holds.
    ``inverse`` gives the other rows: those whose value is certainly not among ids.
    """
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(buckets)).cast("int")
    some = ids.select(bucket(key or column).alias("__bucket")).distinct()
    return df.withColumn("__own", bucket(column)).join(F.broadcast(some), F.col("__own") == F.col("__bucket"), "left_anti" if inverse else "left_semi").drop("__own")


BITMAP_BITS = 1 << 26


def bitmap(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bit for each hash bucket of the keys: ``bits / 8`` bytes (8 MB) whatever the number of keys. When it is full it filters nothing."""
    slot = (F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits)) + 1).alias("slot")
    pages = keys.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((-(-bits // 32768), 4096), dtype=np.uint8)
    for row in pages.collect():
        out[row["page"] - 1] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.reshape(-1)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def long_hash(x: np.ndarray) -> np.ndarray:
    """The engine's xxhash64 (seed 42) of whole numbers of 64 bits."""
    u = np.uint64
    # The primes of the public xxHash64 algorithm.
    p1, p2, p3, p4, p5 = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x85EBCA77C2B2AE63), u(0x27D4EB2F165667C5)
    with np.errstate(over="ignore"):
        h = u(42) + p5 + u(8)
        h = h ^ (_rotated(np.asarray(x).view(np.uint64) * p2, 31) * p1)
        h = _rotated(h, 27) * p1 + p4
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        return h ^ (h >> u(32))


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of bitmap()."""
    # bits is a power of two, so the remainder of the signed hash is its low bits
    slot = (long_hash(np.ascontiguousarray(keys, dtype=np.int64)) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A stateless uniform draw in (0, 1) of a row: the same in every run and under any partitioning."""
    key = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
