"""Shared helpers of the training-data operators: tables, the shared work folder, file access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a session
    without one (tests on one machine) a temporary folder that this process removes at exit."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="knotwork-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir().rstrip("/")


def trim_driver(spark: SparkSession) -> None:
    """Returns memory to the system that the driver's JVM has freed and its C allocator keeps.

    That allocator has arenas for many threads, and what stays behind in them lies outside the heap and its bound. No result depends on
    this; a JVM without that command leaves its memory to its allocator."""
    sc = spark.sparkContext
    lang, arrays = sc._jvm.java.lang, sc._gateway.new_array
    kinds, values = arrays(lang.Class, 4), arrays(lang.Object, 4)
    for i, c in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = lang.Class.forName(c)
    values[0], values[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # by the interface's method, as the server's own class isn't open to callers
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        pass


class Workspace:
    """A fresh folder below the shared one, for tables that cut lineage.

    A table saved here survives the loss of any executor, unlike cached blocks. ``drop()`` removes
    the folder once nothing reads from it any more."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns what reads it."""
        at = f"{self.path}/{name}"
        df.write.mode("error").parquet(at)
        trim_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_fs(uri: str):
    """pyarrow's file system and the path on it, for a folder in the shared store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def attempt_name() -> str:
    """A file stem of this attempt at a task: a second attempt never writes over the first one's file,
    and only files named in rows that a successful attempt returned are ever read."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.stageId()}-{t.taskAttemptId()}-{os.getpid()}" if t else uuid.uuid4().hex


def files_frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A frame of ``rows``, one per file: a task for each, or for some where that would make very many tasks."""
    n = len(rows)
    return spark.createDataFrame(rows, schema).repartition(max(1, min(n, max(16 * spark.sparkContext.defaultParallelism, n // 64))))


def thinned(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About ``rows`` rows of ``df``, or all of a smaller one, by the hash of some columns: so that what is sorted for a bounded
    sample is bounded too, however many partitions there are."""
    share = max(1, df.count() // rows)
    return df if share == 1 else df.where(F.pmod(F.xxhash64(F.lit(11), *columns), F.lit(share)) == 0)


def utf8_size(c):
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
