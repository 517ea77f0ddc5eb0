"""Text to vector."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.text import HASH_BASE, HASH_MODULUS, TOKEN_GAP
from termloom.functions.vectors import l2_normalise

_PART = 1 << 20  # characters counted at once


def ngram_matrix(texts: list[str | None], dim: int, n: int, max_tokens: int | None) -> np.ndarray:
    """Counts of hashed n-grams of the framed words of lower-cased texts, a row per text.

    All words of all texts are one run of code points; n-grams that reach into the next
    word are left out. A framed word shorter than ``n`` is one n-gram itself.
    """
    split = [[w for w in re.split(TOKEN_GAP, t or "") if w][:max_tokens] for t in texts]
    words = [f"<{w}>" for part in split for w in part]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(split)), [len(part) for part in split])
    # Characters from here to the end of the word.
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))
    whole = np.zeros(len(points), bool)
    whole[np.cumsum(lengths)[lengths < n] - lengths[lengths < n]] = True
    at = np.flatnonzero((rest >= n) | whole)
    code = np.zeros(len(at), np.int64)
    for i in range(n):
        inside = rest[at] > i
        point = np.where(inside, points[np.minimum(at + i, len(points) - 1)], 0)
        code = (code * HASH_BASE + point) % HASH_MODULUS
    row = np.repeat(owner, lengths)[at]
    counts = np.bincount(row * dim + code % dim, minlength=dim * len(split))
    return counts.reshape(len(split), dim).astype(np.float64)


def add_ngrams(
    df: DataFrame,
    text: str,
    dim: int = 64,
    n: int = 3,
    max_tokens: int | None = None,
    name: str = "embedding",
) -> DataFrame:
    """Add ``name``: L2-normalised hashed n-gram counts of ``text``, whole texts by default.

    A value of one row only, so rows stay where they are. Null and empty text has the
    zero vector. ``max_tokens`` is the input limit of an encoder; set it only to imitate one.
    """
    columns = df.columns
    # Lower case as SQL makes it.
    ready = df.withColumn("_low", F.lower(text))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_low").to_pylist()
            sizes = np.cumsum([len(t or "") for t in texts])
            start = 0
            while start < len(texts):
                before = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + _PART, "right")))
                counts = ngram_matrix(texts[start:stop], dim, n, max_tokens)
                norm = np.sqrt((counts * counts).sum(1))[:, None]
                cells = np.divide(counts, norm, out=counts, where=norm > 0)
                edges = np.arange(len(cells) + 1, dtype=np.int32) * dim
                vectors = pa.ListArray.from_arrays(pa.array(edges), pa.array(cells.ravel()))
                kept = batch.slice(start, stop - start).select(columns)
                yield pa.RecordBatch.from_arrays([*kept.columns, vectors], names=[*columns, name])
                start = stop

    return ready.mapInArrow(run, schema)


def encode_ngrams(
    texts: DataFrame,
    key: str,
    text: str,
    dim: int = 64,
    n: int = 3,
    max_tokens: int | None = None,
    name: str = "embedding",
) -> DataFrame:
    """(key, embedding) of ``add_ngrams``, a row per text."""
    picked = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    vectors = add_ngrams(picked, "text", dim, n, max_tokens, name)
    return vectors.select(F.col("key").alias(key), name)


def _kept_by_worker(mark: str, make: Callable):
    """What ``make`` returns, made once in this worker; only the latest is kept."""
    # A module of its own, as functions of this one are sent by value with every task.
    holder = sys.modules.setdefault("termloom_models", types.ModuleType("termloom_models"))
    if getattr(holder, "mark", None) != mark:
        holder.model = make()
        holder.mark = mark
    return holder.model


def encode_with(
    texts: DataFrame,
    key: str,
    text: str,
    encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    batch_size: int = 32,
    name: str = "embedding",
) -> DataFrame:
    """Hook for a neural encoder.

    ``encoder`` is called once per Python worker, which keeps what it returns for all its tasks: a
    function from a list of texts to a matrix with one row per text. Texts of like length are
    encoded together, so that a batch needs little padding, and come out in their own order. Rows
    are L2-normalised.
    """
    mark = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _kept_by_worker(mark, encoder)
        for batch in batches:
            values = batch.column("text").to_pylist()
            order = sorted(range(len(values)), key=lambda i: len(values[i] or ""))
            rows: list = [None] * len(values)
            for lo in range(0, len(order), batch_size):
                part = order[lo : lo + batch_size]
                found = np.asarray(encode([values[i] for i in part]), np.float64)
                for i, row in zip(part, found, strict=True):
                    rows[i] = row
            vectors = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), vectors], names=[key, name])

    schema = T.StructType(
        [
            T.StructField(key, texts.schema[key].dataType),
            T.StructField(name, T.ArrayType(T.DoubleType())),
        ]
    )
    picked = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    vectors = picked.mapInArrow(run, schema)
    return vectors.select(key, l2_normalise(F.col(name)).alias(name))
