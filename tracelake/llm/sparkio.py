"""Small Spark helpers shared by the operators: shared folders, checkpoints and sized broadcasts."""

from __future__ import annotations

import ctypes
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_count = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset (tests on one machine), a temporary one."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracelake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows, unless the session asks for fewer: they are held twice outside the heap, and whole in each worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def release_unused() -> None:
    """Give freed memory back to the system: Spark keeps workers, with what earlier stages left in them, also while only the JVM works."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other libraries give it back by themselves
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` whose worker begins and ends each task without freed memory."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_unused()
        yield from run(batches)
        release_unused()

    return released


def lean_groups(run: Callable[..., pa.Table], tables: int = 1) -> Callable[..., pa.Table]:
    """A function for ``applyInArrow`` (of two ``tables``: of cogroups) that gives freed memory back after each group."""

    def released(*given: pa.Table) -> pa.Table:
        out = run(*given)
        release_unused()
        return out

    return (lambda table: released(table)) if tables == 1 else (lambda left, right: released(left, right))  # Spark counts the arguments


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: work done once, safe from lost executors, lineage cut."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{next(_count)}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small iterative state."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fitting(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint if ``rows``, the counted size, is within ``limit``; else Spark chooses a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def slices(rows: int, per_slice: int, least: int = 1) -> int:
    """How many partitions hold ``rows`` at ``per_slice`` each."""
    return max(least, -(-int(rows) // per_slice))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the DataFrame does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
