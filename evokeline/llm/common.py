"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with files in the cluster's shared checkpoint folder."""
    return cut(df)


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that no table needs any more: it notices when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


#: Bytes of a table that is broadcast at most, as rows of so many bytes beside its arrays and texts.
BROADCAST = 32 << 20


def bounded(df: DataFrame, width: int) -> DataFrame:
    """``df``, which is checkpointed and has ``width`` bytes a row or so, with a hint to broadcast it if it is small enough."""
    return F.broadcast(df) if df.count() * width <= BROADCAST else df


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, none of which ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def small_batches(spark: SparkSession, most: int = 1 << 20) -> Iterator[None]:
    """Actions inside hand Python at most about ``most`` bytes at once; the session's own bound is back afterwards.

    For jobs of many steps in one executor: a batch is held several times over, by the JVM and by its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows and bytes of an Arrow batch that a function works on at once. Spark bounds the bytes of whole batches itself
#: (spark.sql.execution.arrow.maxBytesPerBatch); what Python makes of them is larger.
ROWS_AT_ONCE, BYTES_AT_ONCE = 2048, 2 << 20


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ROWS_AT_ONCE rows and, beyond one row, about BYTES_AT_ONCE bytes."""
    at, rows = 0, ROWS_AT_ONCE
    while at < len(batch):
        part = batch.slice(at, rows)
        if part.nbytes > BYTES_AT_ONCE and len(part) > 1:
            rows = len(part) // 2
            continue
        yield part
        at, rows = at + len(part), min(ROWS_AT_ONCE, 2 * rows)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of a task's batches. At the end the worker, which other tasks share, gives back the memory it no longer needs."""
    try:
        for batch in batches:
            yield from sliced(batch)
    finally:
        give_back()


def give_back() -> None:
    """Unused memory of Arrow and, where the C library can, of Python and numpy to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
