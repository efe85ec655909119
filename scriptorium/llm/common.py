"""What the operators share: staged tables in the cluster's shared folder, and Arrow plumbing.

A staged table is written as Parquet below ``spark.checkpoint.dir`` and read back. That cuts lineage
with files that outlive any executor, gives Spark exact sizes (so that it broadcasts a side only when
the size it measured is under its threshold), and makes several passes agree on one input.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local one is made, on one machine only: executors elsewhere could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone; the folder is scratch space
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written below the shared folder and read back; df.staged_path tells where."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes staged tables that no pending plan reads any more."""
    for df in frames:
        if path := getattr(df, "staged_path", None):
            remove(df.sparkSession, path)


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text, as folds are cut by."""
    return F.crc32(F.col(column).cast("string"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver's JVM collect its garbage, upon which Spark's cleaner deletes the shuffle files of plans that
    nothing refers to any more; else they stay on the executors' disks until the driver happens to collect."""
    for _ in range(2):  # what the first round frees lets the second see the rest
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def trim() -> None:
    """Gives freed memory of this Python worker back to the system, which its allocators else keep for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def zipped(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes."""
    raw = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(raw, asbytes=True) if raw else b"")


def unzipped(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    raw = pa.Codec("zstd").decompress(b[8:], 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def zipped_keys(x: np.ndarray) -> bytes:
    """Ascending keys."""
    return zipped(np.diff(x, prepend=np.uint64(0)))


def unzipped_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unzipped(b), dtype=np.uint64)
