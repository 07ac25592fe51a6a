"""Tables written to the shared folder: stable input for plans that read a table twice."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests on one machine).
FALLBACK_DIR = "file:///tmp/checkpoints/sievewright"


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/sievewright-{uuid.uuid4().hex}"


#: What the last ``trim`` left in the driver's heap.
_left = [0]


def trim(spark: SparkSession) -> None:
    """Gives the driver's heap back once it is past half of its limit and twice what the last call left: loops of many jobs leave much garbage."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > max(heap.maxMemory() // 2, 2 * _left[0]):
        spark._jvm.System.gc()
        _left[0] = heap.totalMemory() - heap.freeMemory()


#: Seconds between two calls that give native memory back, and when the next may be.
NATIVE_EVERY_S = 5.0
_next = [0.0]


def trim_native(spark: SparkSession) -> None:
    """Gives back what the driver's JVM has freed outside its heap, every few seconds at most.

    Compiled plans, codecs and hundreds of short-lived threads allocate there; the C library keeps what they free, more than 100 MB after some hundred jobs.
    """
    if time.monotonic() < _next[0]:
        return
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server, kinds, values = jvm.java.lang.Class.forName("javax.management.MBeanServer"), array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's own class isn't open to reflection, its interface is.
        server.getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # this JVM has no such command
        _next[0] = float("inf")
        return
    _next[0] = time.monotonic() + NATIVE_EVERY_S


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` and reads it back; a lost executor costs no recomputation."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    trim(df.sparkSession)
    trim_native(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)
