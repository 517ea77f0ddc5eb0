"""Helpers shared by the text operators: Arrow batches cut by bytes, word splitting, tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from termloom.session import use_local_dir

# ASCII white space as the word pattern [^\x20\x09-\x0D]+ sees it; bytes.split() cuts at it.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_local_dir(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of every value of a string column; null counts as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def by_bytes(
    batches: Iterator[pa.RecordBatch], column: str, most: int
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that each holds about ``most`` bytes of text, or a single longer one."""
    for batch in batches:
        group: list[bytes] = []
        start = size = 0
        for at, text in enumerate(texts(batch.column(column))):
            if group and size + len(text) > most:
                yield batch.slice(start, at - start), group
                group, start, size = [], at, 0
            group.append(text)
            size += len(text)
        if group:
            yield batch.slice(start, batch.num_rows - start), group


def slices_by_bytes(
    batches: Iterator[pa.RecordBatch], column: str, most: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Like ``by_bytes``, with the texts left in the batch and only their lengths beside it."""
    for batch in batches:
        lengths = np.asarray(
            pc.binary_length(batch.column(column)).fill_null(0).cast(pa.int64()), np.int64
        )
        start = 0
        while start < len(lengths):
            total = np.cumsum(lengths[start : start + batch.num_rows])
            count = max(1, int(np.searchsorted(total, most, "right")))
            yield batch.slice(start, count), lengths[start : start + count]
            start += count


def map_arrow(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` in workers that keep no freed memory once a task is done.

    Workers outlive their tasks; what several of them hold idle is missing to the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
