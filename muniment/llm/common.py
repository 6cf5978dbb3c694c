"""What the corpus operators share: table access, durable intermediate tables, small hash helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting that deletes an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    there = f"file://{tempfile.mkdtemp(prefix='muniment-')}"
    spark.conf.set("spark.checkpoint.dir", there)
    return there


def durable(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: the lineage ends here, and a lost
    executor takes nothing with it. Its place is kept in `.path_` for drop(). The shuffle files that it took
    are deleted once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_ = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a durable() table that nothing will read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.path_)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_plans(spark: SparkSession) -> None:
    """Lets the driver collect the plans of finished steps, which a driver with memory to spare does late."""
    spark._jvm.System.gc()


def free_heaps(spark: SparkSession) -> None:
    """Has every executor collect its garbage and give the heap that this frees back to the system: a heap that grew to its
    limit in earlier steps would stay there, and the Python workers of the next come on top of it."""
    n = spark.sparkContext.defaultParallelism  # a task for each core, so that none is left out
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def unit_hash(*columns: str) -> Column:
    """A repeatable number in [0, 1) from values, for hash-threshold samples."""
    return F.pmod(F.xxhash64(F.lit(7), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that a task holds few texts as Python objects. At the end spare()."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    del batches
    spare()


def grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups from frames sorted by the keys, many to a frame: (frame, group starts and end)."""
    carry = None
    for frame in frames:
        frame = frame if carry is None or not len(carry) else pd.concat([carry, frame], ignore_index=True)
        if not len(frame):
            continue
        ids = frame[keys].to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        if len(cuts):
            yield frame.iloc[: cuts[-1]], np.concatenate([[0], cuts])
            frame = frame.iloc[cuts[-1] :]
        carry = frame
    if carry is not None and len(carry):
        yield carry, np.array([0, len(carry)])


def spare() -> None:
    """Gives the allocators' spare memory back to the system: workers outlive their tasks, and the next operator's
    peak would come on top of what they keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
