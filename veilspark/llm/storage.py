"""Materialised intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local folder is chosen only where the setting is absent and the master
    is one machine (tests); elsewhere a missing setting is an error, as each
    machine would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        at = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Bytes of a batch sent to a Python worker, where the session has Spark's default.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the memory of Python workers small when texts are long.

    The setting is read when a plan runs, which is after the operator has
    returned, so it stays; a session that has its own value keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for a Python worker that gives freed memory back to the system
    at the end of each task; workers stay for later tasks and would keep it."""

    def trimmed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(frames)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return trimmed


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables that operators write inside the block
    when it ends. Results must have been written by then, as they read them."""
    paths: list[str] = []
    outer = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(outer)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str = "step", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts the lineage: a lost executor costs one task of the reader, never a
    recomputation of the writer, and non-deterministic parts (range
    boundaries, generated ids) are fixed once. Tables stay until the end of
    the scratch() block around them, if there is one and not ``keep``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    written = _written.get()
    if written is not None and not keep:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
