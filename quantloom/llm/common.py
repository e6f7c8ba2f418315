"""Shared helpers: the cluster's shared folder, written tables, text batches."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step works on at once (one longer document is taken alone).
SLICE_BYTES = 1 << 19
#: Bytes of a page in files between steps: below half of a memory region of the JVM's heap, so that pages need no regions of their own.
PAGE_BYTES = 1 << 18
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every node sees: ``spark.checkpoint.dir``.

    Only where one machine runs all of Spark may it be unset; a local folder is taken then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), "quantloom-shared")
    os.makedirs(own, exist_ok=True)
    return "file://" + own


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/quantloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors.

    ``per_file`` bounds the rows of a file (0: no bound).
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("parquet.page.size", PAGE_BYTES).option("maxRecordsPerFile", per_file).parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that ``materialize`` returned; nothing may read it afterwards."""
    path = getattr(df, "_shared_path", None)
    if path:
        _delete(df.sparkSession, path)


def written() -> list[str]:
    """Folders that ``materialize`` has written in this session and nobody has deleted."""
    return list(_WRITTEN)


def sweep(spark: SparkSession, before: list[str], keep: DataFrame) -> None:
    """Delete what was written after ``before`` was taken, but for the files behind ``keep``; frames that read it are of no use afterwards."""
    for path in written():
        if path not in before and path != keep._shared_path:
            _delete(spark, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, whether it is one file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state() -> dict:
    """What this Python process keeps from one task to the next, by name.

    The package's functions travel by value and bring new globals with every
    task, so the state is a module of its own in the process.
    """
    name = "_quantloom_worker"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def other_columns(df: DataFrame, results) -> list[str]:
    """Columns of ``df`` but for those that have the name of a result, in any case."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken]


def text_buffers(column):
    """(uint8 data, int64 offsets) of an Arrow string column; a null is an empty text."""
    import numpy as np
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets, limit: int = SLICE_BYTES):
    """Row ranges (a, b) whose texts take about ``limit`` bytes; a longer text is a range of its own."""
    import numpy as np

    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def give_back() -> None:
    """Return freed memory of this process to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass


def settle(spark: SparkSession) -> None:
    """Let the executors' Java give back the memory that earlier steps have freed.

    Java's heap, and buffers outside it that only its collector frees, otherwise
    stay at the most that any step so far needed.  Two tasks for each core, so
    that every executor has some, one after another: the second collection
    frees what the first one only found to be unused.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def frugal(run):
    """A batch function that gives freed memory back to the system when its task ends.

    Workers live on between tasks; without this each keeps the most that any task needed.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
