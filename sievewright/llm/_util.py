"""Shared plumbing: the shared workspace, materialised tables, local components."""

from __future__ import annotations

import gc
import time
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.plans.workspace import trim_native

#: Used only where the session names no shared folder (tests on one machine).
FALLBACK_DIR = "file:///tmp/checkpoints/sievewright"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, seen by the driver and all executors."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/sievewright-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the workspace through Hadoop's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: What the last ``trim`` left in the driver's heap.
_left = [0]


def trim(spark: SparkSession) -> None:
    """Gives the driver's heap back once it is past half of its limit and twice what the last call left.

    Finished jobs' plans and events are garbage, but the collector lets a heap grow to its limit before it looks, and keeps what it has grown to.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > max(heap.maxMemory() // 2, 2 * _left[0]):
        spark._jvm.System.gc()
        _left[0] = heap.totalMemory() - heap.freeMemory()


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    trim(df.sparkSession)
    trim_native(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def valid_text(column: str = "text"):
    """The column as text that Python can read: bytes that aren't UTF-8 become replacement characters."""
    return F.make_valid_utf8(F.col(column).cast("string")).alias(column)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(doc_id) -> int:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the undirected edges (a, b)."""
    label = np.arange(n, dtype=np.int64)
    while len(a):
        la, lb = label[a], label[b]
        live = la != lb
        if not live.any():
            break
        la, lb, a, b = la[live], lb[live], a[live], b[live]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def release(spark: SparkSession, rounds: int = 3) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs now.

    It does so once the driver's JVM has collected their plans; Python's handles on them and the listeners' events let go of them a moment
    after a job's end, hence the rounds.
    """
    for _ in range(rounds):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
