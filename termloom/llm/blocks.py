"""Texts as blocks: rows of a bucketed table that send keys out and get answers back.

A block is a few MB of documents. It sends each different key once, however many of its
documents have it, to the bucket of the key; what the bucket finds comes back by block. A key
in a third of all documents is thus one row per block, and texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import by_bytes, map_arrow
from termloom.session import shared_dir, work_path

BLOCK_BYTES = 4 << 20
BATCH_BYTES = "8m"  # of an Arrow batch, in sessions that work on blocks
NO_ID = np.iinfo(np.int64).max  # stands for a null id, behind all others


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (scrambled(keys * np.uint64(0xA0761D6478BD642F)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def text_blocks(
    df: DataFrame,
    id_column: str,
    text_column: str,
    extra: Sequence[str],
    block_bytes: int | None = None,
) -> DataFrame:
    """Rows of about ``block_bytes`` of text: ids, lengths, compressed texts and other columns.

    A task works on one block at a time, with some 60 times its bytes; BLOCK_BYTES if not given.
    """
    most = block_bytes or BLOCK_BYTES
    picked = df.select(
        df[id_column].alias("id"),
        F.coalesce(df[id_column].cast("long"), F.lit(int(NO_ID))).alias("order"),
        df[text_column].alias("text"),
        *[df[name].alias(f"x{i}") for i, name in enumerate(extra)],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        press = zstandard.ZstdCompressor(level=3)
        for batch, group in by_bytes(batches, "text", most):
            rest = batch.drop_columns(["order", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_batch(rest)
            lengths = np.array([len(t) for t in group], np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "n_bytes": pa.array([int(lengths.sum())], pa.int64()),
                    "rest": [press.compress(sink.getvalue().to_pybytes())],
                    "lengths": [lengths.tobytes()],
                    "ids": [np.asarray(batch.column("order"), np.int64).tobytes()],
                    "body": [press.compress(b"".join(group))],
                }
            )
            number += 1

    schema = "block long, n_bytes long, rest binary, lengths binary, ids binary, body binary"
    return map_arrow(picked, run, schema)


def stored(rows: DataFrame, buckets: int, column: str = "block") -> tuple[DataFrame, str]:
    """The rows as a table bucketed by ``column``, so that joins on it move no texts.

    Returns the table and its name, for ``drop_stored``.
    """
    spark = rows.sparkSession
    # A row is some MB, so the usual 64 MB of an Arrow batch would be there several times a task.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    path = work_path(spark, "blocks")
    name = "blocks_" + path.rsplit("-", 1)[1]
    writer = rows.write.format("parquet").option("path", path).option("compression", "none")
    writer.bucketBy(buckets, column).saveAsTable(name)
    return spark.table(name), name


def drop_stored(spark: SparkSession, name: str) -> None:
    """Delete a table of ``stored`` once nothing reads it any more."""
    path = f"{shared_dir(spark)}/termloom-blocks-{name.removeprefix('blocks_')}"
    spark.sql(f"DROP TABLE {name}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Mask of the values found in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def shared_keys(group: pa.Table) -> pa.Table:
    """Of each block, the keys that another block has too."""
    blobs = [np.frombuffer(v.as_py(), np.uint64) for v in group.column("keys")]
    keys = np.sort(np.concatenate(blobs))
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
    del keys
    found = [b[among(b, twice)].tobytes() for b in blobs]
    return pa.table(
        {"block": group.column("block").combine_chunks(), "keys": pa.array(found, pa.binary())}
    )


def answers_by_block(rows: DataFrame, column: str) -> DataFrame:
    kept = rows.where(F.length(column) > 0)
    return kept.groupBy("block").agg(F.collect_list(column).alias("answers"))


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    return blocks.join(answers.hint("shuffle_hash"), "block", "left")
