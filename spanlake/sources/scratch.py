"""Intermediate tables in the shared scratch folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import time
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []

#: Seconds between two times that driver and executors give memory back, and when they last did.
REST = 10.0
_rested = [0.0]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir as the cluster names it.

    Only where neither that setting nor a checkpoint folder is set and the whole session is one process (tests on one
    machine), a temporary folder is made and set. A cluster without the setting is an error: its machines' own folders
    don't hold what other machines write.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spanlake-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def give_back() -> None:
    """This Python process hands the memory that it no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _trim_native(spark: SparkSession) -> str:
    """The C library below the driver's JVM hands back what it holds free; called by the interface's method, as py4j sees only
    the server's own class, which is closed to it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    array = lambda kind, *values: [(a := gateway.new_array(kind, len(values))), *[a.__setitem__(i, v) for i, v in enumerate(values)]][0]
    named = jvm.java.lang.Class.forName
    types = array(jvm.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    values = array(jvm.Object, command, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String))
    return named("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def rest_driver(spark: SparkSession) -> bool:
    """The driver's JVM and Python hand back what they no longer use, at most every REST seconds; whether they did.

    Between steps little of the JVM's heap is in use, but it stays as large as plans, events and task results of the step
    before once made it, and so do the system's buffers of threads that have gone. The collection also lets Spark delete
    the shuffles and broadcasts of steps that are over. The executors follow."""
    if time.monotonic() - _rested[0] < REST:
        return False
    give_back()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # a JVM without this command
        _trim_native(spark)
    rest_executors(spark)
    _rested[0] = time.monotonic()
    return True


def rest_executors(spark: SparkSession) -> int:
    """The executors' JVMs collect their garbage, so that their heaps shrink to a few times what is in use; how many were asked.

    A heap grows with what a step allocates, not with what it needs at once, and stays so while Python workers fill up beside
    it. A task for each executor, which the scheduler deals out one by one over those that are free; one that is missed keeps
    its heap until the next time."""
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # without the driver, which is all there is in local mode
    if n > 0:
        with contextlib.suppress(PySparkException):  # where calls into the JVM are not allowed
            spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
    return n


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet under the scratch folder and read them back, so that a lost executor costs its tasks only."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/spanlake-{uuid.uuid4().hex}"
    rest_driver(spark)
    df.write.parquet(path)
    _written.append(path)
    rest_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process has materialized, once no result needs it any more; returns how many tables."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _written:
        hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop.Path(path), True)
    n = len(_written)
    _written.clear()
    return n
