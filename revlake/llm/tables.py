"""Tables that the operators read, and tables written between their steps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.llm import bytetext as B
from revlake.sources.staging import new_folder

#: Of texts that are worked on together, in bytes; a longer text is alone.
PART = 1 << 20
_LARGE = 4 << 20
#: Settings of a job. Limits of an Arrow batch between Spark and Python: a task holds some batches on both sides.
#: A job's shuffle files go when it ends: what it wrote or told is all that a later one reads, and files of many
#: tasks take a disk block each, however small. Spark repeats the stages if one of them is asked for again.
_SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def frugal_job(spark: SparkSession) -> Iterator[None]:
    """While a job runs, Arrow batches are small and its shuffles end with it; the session's own settings come back after it."""
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder that all executors share and read back; cuts the lineage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with frugal_job(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    with frugal_job(df.sparkSession):
        return df.isEmpty()


def frugal(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Give memory back at once: large arrays when they are freed, the rest at the end of a task.

    A worker process lives on for later tasks, and what its allocators keep is
    missing to them and to Spark. Where the C library has no such calls nothing
    changes.
    """

    @wraps(run)
    def held(*args) -> Iterator[pa.RecordBatch]:
        library = ctypes.CDLL(None)
        if hasattr(library, "mallopt"):
            library.mallopt(-3, _LARGE)  # M_MMAP_THRESHOLD: from this size on, memory of its own
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(library, "malloc_trim"):
                library.malloc_trim(0)

    return held


def parts(column: pa.Array, size: int = PART) -> Iterator[tuple[int, int]]:
    """Rows low to high that hold about ``size`` bytes of text, or one row."""
    _, offsets = B.flat(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high
        low = high


def text_parts(batches: Iterable[pa.RecordBatch], text: int = 1, size: int = PART) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The first column and the texts, cut by bytes."""
    for b in batches:
        for low, high in parts(b.column(text), size):
            yield b.column(0).slice(low, high - low), b.column(text).slice(low, high - low)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until the table has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: str = "doc_id"):
    """0 to 3 by the CRC-32 of the id as text; 2 is held out. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(2))
