"""Shared helpers: safe column names, Arrow batches and schemas."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..staging import discard, stage

__all__ = ["append", "arrow_schema", "chunks", "discard", "fresh", "map_batches", "release", "small_batches", "stage", "utf8", "with_fields"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names as near to ``names`` as those that ``df`` has already allow."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bound the Arrow batches that go to Python by rows and by bytes, so that long texts fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` whose worker gives its memory back when a task ends: workers are kept between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Return free memory to the system."""
    gc.collect(1)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def append(batch: pa.RecordBatch, schema: pa.Schema, *columns) -> pa.RecordBatch:
    """``batch`` with more columns at its end; ``schema`` is that of the result."""
    n = batch.num_columns
    arrays = [a.cast(schema.field(i).type) for i, a in enumerate(batch.columns)]
    arrays += [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n + i).type) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to ``most``; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
