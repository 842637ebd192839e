"""What the operators share: the shared folder, written intermediate tables, batches of texts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir; Spark removes the folder when the session ends. Without that setting, a
    session of this machine alone gets a folder of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cellspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/cellspark-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def trim(spark: SparkSession) -> bool:
    """Gives memory that the driver's JVM has freed outside its heap, which the C library keeps, back to the system; whether
    the JVM can do so."""
    sc = spark.sparkContext
    java, new = sc._jvm.java.lang, sc._gateway.new_array
    try:
        # The server's class is of a package that is closed to callers, its interface isn't.
        kinds = new(java.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = java.Class.forName(kind)
        values = new(java.Object, 4)
        values[0], values[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        values[2], values[3] = new(java.Object, 0), new(java.String, 0)
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # another JVM
        return False
    return True


def rest(spark: SparkSession) -> None:
    """Lets the executors' JVMs collect their garbage, after which they give most of the heap that is free back to the system;
    Python workers need the room. As many tasks as cores reach each executor, where nothing else runs."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of tables from `written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


Batches = Iterator[pa.RecordBatch]
#: Most bytes of a batch between Spark and Python, where the session doesn't say; Spark's own limit is the second.
BATCH_BYTES, SPARK_BATCH_BYTES = 8 << 20, 64 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session passes batches of few MB to Python, which both sides hold at once, unless it has a limit
    of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("bB") == str(SPARK_BATCH_BYTES):
        conf.set(key, str(BATCH_BYTES))
    return df


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which the worker, which waits for the next task, gives its free memory back to the system."""

    def out(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return out


def texts(df: DataFrame, id_col: str, text_col: str, *more: str | Column) -> DataFrame:
    """The id as `doc_id` (long) and the text as `text` (null: empty); other columns of df cannot clash with later ones."""
    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls, as views where Arrow permits."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], (offsets - offsets[0]) if len(offsets) else np.zeros(1, np.int64)


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1_500_000, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of text and at most `rows` rows, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).cast(pa.large_string())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        start = 0
        while start < batch.num_rows:
            fits = int(np.searchsorted(edges, edges[start] + most, "right")) - 1
            stop = min(max(start + 1, fits), start + rows, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
