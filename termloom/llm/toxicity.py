"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, white space is folded to one space, and its n-grams of a few widths are
hashed into buckets; a feature is 1 if the text has the n-gram anywhere. The classifier is fitted
on at most ``SAMPLE_ROWS`` labelled ids of each class, those with the smallest hash among the
labelled documents that are not held out. The log ratio of a feature between toxic and clean texts
is counted by Spark; the features whose ratio is best proved by its counts are kept, and a
logistic regression on them, each times its ratio, is fitted in numpy, with rows weighted so that
the classes keep the shares that they have among all labelled documents.

Whole texts are read, in slices, so a very long text needs memory for itself and its different
features only. Null text counts as empty and gets the score of a text without features. A row
without label, or with a null id, teaches nothing; an id labelled twice counts as toxic if one
label says so, and an id with several texts teaches by one of them. Repeated rows are scored
each. Without labelled rows of both classes every score is the share of the one that is there, 0
for none. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import by_bytes, map_arrow, table
from termloom.llm.words import worker_cache
from termloom.session import pinned

WIDTHS = (4, 5)
BUCKET_BITS = 21
FEATURES = 1 << 13
MIN_ROWS = 4  # labelled rows that must hold a feature
SAMPLE_ROWS = 3000  # labelled ids of each class that are learned from, at most
STEPS = 150
PENALTY = 0.3
SMOOTHING = 1.0
SLICE = 1 << 18
GROUP_BYTES = 1 << 20
_WHITE = re.compile(r"\s+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, with repeats, slice by slice."""
    folded = " " + _WHITE.sub(" ", text.lower()).strip() + " "
    for start in range(0, len(folded), SLICE):
        part = folded[start : start + SLICE + max(WIDTHS) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        key = codes
        for width in range(2, max(WIDTHS) + 1):
            if len(key) < 2:
                break
            key = key[:-1] * _FACTOR + codes[width - 1 :]
            if width in WIDTHS:
                mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def present(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Different buckets of a text, only those that are ``wanted`` if a mask is given."""
    found = [np.unique(b if wanted is None else b[wanted[b]]) for b in buckets(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def held_out(id_column: Column) -> Column:
    """True for rows whose id's crc32 is a multiple of 5; their labels are never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def class_counts(labelled: DataFrame) -> DataFrame:
    """Rows of each class that hold a feature: (bucket, toxic, clean), of ``labelled``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BUCKET_BITS), np.int32)  # a task has fewer rows than that holds
        for batch, group in by_bytes(batches, "text", GROUP_BYTES):
            for text, toxic in zip(group, batch.column("toxic").to_pylist(), strict=True):
                sums[toxic, present(text.decode("utf-8"))] += 1
        some = np.flatnonzero(sums.any(0))
        for part in np.array_split(some, max(1, len(some) >> 16)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(sums[1, part]), pa.array(sums[0, part])],
                names=["bucket", "toxic", "clean"],
            )

    counted = map_arrow(
        labelled.select("text", "toxic"), run, "bucket int, toxic int, clean int"
    )
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log of a feature's share among toxic texts over that among clean ones."""
    of_toxic = (toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)
    return np.log(of_toxic) - np.log((clean + SMOOTHING) / (n_clean + 2 * SMOOTHING))


@dataclass
class Classifier:
    """Weight of each bucket, ratio included, and the constant."""

    picked: np.ndarray
    weights: np.ndarray
    constant: float

def fit(
    rows: list[np.ndarray], labels: np.ndarray, row_weights: np.ndarray, ratios: np.ndarray
) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression on features of value ``ratios``.

    ``rows`` holds the feature numbers of each row. Accelerated gradient steps on the mean
    loss with a penalty on the squared weights.
    """
    flat = np.concatenate([*rows, np.zeros(0, np.int32)])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    values = ratios.astype(np.float32)[flat]
    share = row_weights / row_weights.sum()
    squares = np.bincount(owner, values**2, len(rows)) + 1
    step = 4 / (share @ squares + 1e-12)
    shrink = PENALTY / row_weights.sum()
    mean = float(share @ labels)
    weights, constant = np.zeros(len(ratios)), np.log(mean / (1 - mean))
    ahead, ahead_constant = weights.copy(), constant
    for number in range(STEPS):
        logit = np.bincount(owner, values * ahead[flat], len(rows)) + ahead_constant
        error = share * (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels)
        slope = np.bincount(flat, values * error[owner], len(ratios)) + shrink * ahead
        now, now_constant = ahead - step * slope, ahead_constant - step * error.sum()
        push = number / (number + 3)
        ahead = now + push * (now - weights)
        ahead_constant = now_constant + push * (now_constant - constant)
        weights, constant = now, now_constant
    return weights * ratios, float(constant)


def _feature_rows(
    labelled: DataFrame, picked: np.ndarray
) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers and class of every row, in the order of their ids' hashes."""
    packed = picked.astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(packed, np.int32)
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[own] = True
        for batch, group in by_bytes(batches, "text", GROUP_BYTES):
            found = [np.searchsorted(own, present(t.decode("utf-8"), wanted)) for t in group]
            cells = pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("draw"), cells],
                names=["toxic", "draw", "cells"],
            )

    got = map_arrow(labelled, run, "toxic int, draw long, cells binary").toArrow()
    got = got.sort_by([("toxic", "ascending"), ("draw", "ascending")])
    rows = [np.frombuffer(cells, np.int32) for cells in got.column("cells").to_pylist()]
    return rows, np.asarray(got.column("toxic"), float)


def sampled(texts: DataFrame, marks: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, draw) of at most SAMPLE_ROWS ids of each class, and each class's ids.

    ``texts`` is (id, text), ``marks`` (id, toxic) with different ids. Ids alone are joined; only
    the texts of the chosen ones are moved.
    """
    known = marks.join(texts.select("id"), "id", "left_semi")
    known = pinned(known.select("id", "toxic", F.xxhash64("id").alias("draw")), "labels")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [
        known.where(F.col("toxic") == c).orderBy("draw", "id").limit(SAMPLE_ROWS) for c in (0, 1)
    ]
    # Two times SAMPLE_ROWS rows at most.
    chosen = F.broadcast(pinned(parts[0].unionByName(parts[1]), "chosen"))
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    picked = texts.join(chosen, "id").groupBy("id", "toxic", "draw").agg(one)
    return pinned(picked.select("text", "toxic", "draw"), "sample"), n


def learn(labelled: DataFrame, n: dict[int, int]) -> Classifier:
    """Fit on ``text``, ``toxic`` (0 or 1) and ``draw``; ``n`` counts the labelled ids they stand for."""
    nothing = np.zeros(0, np.int64)
    if len(n) < 2:
        return Classifier(nothing, np.zeros(0), np.inf if 1 in n else -np.inf)
    seen = {c: min(n[c], SAMPLE_ROWS) for c in (0, 1)}
    counts = class_counts(labelled).where(F.col("toxic") + F.col("clean") >= MIN_ROWS)
    a, b = F.col("toxic") + F.lit(SMOOTHING), F.col("clean") + F.lit(SMOOTHING)
    shift = float(np.log((seen[1] + 2 * SMOOTHING) / (seen[0] + 2 * SMOOTHING)))
    proved = F.abs(F.log(a) - F.log(b) - F.lit(shift)) / F.sqrt(1 / a + 1 / b)
    best = counts.orderBy(proved.desc(), "bucket").limit(FEATURES).toArrow().sort_by("bucket")
    picked = np.asarray(best.column("bucket"), np.int64)
    toxic, clean = (np.asarray(best.column(c), float) for c in ("toxic", "clean"))
    ratios = log_ratio(toxic, clean, seen[1], seen[0])

    rows, labels = _feature_rows(labelled, picked)
    row_weights = np.where(labels > 0, n[1] / seen[1], n[0] / seen[0])
    weights, constant = fit(rows, labels, row_weights, ratios)
    return Classifier(picked, weights, constant)


def predict(df: DataFrame, model: Classifier, id_column: str, text_column: str) -> DataFrame:
    """Id, ``score`` and ``predicted`` of every whole text."""
    picked = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()
    sink = io.BytesIO()
    np.savez(sink, picked=model.picked.astype(np.int32), weights=model.weights)
    packed, constant = sink.getvalue(), model.constant
    mark = f"toxicity:{zlib.crc32(packed)}:{len(packed)}"

    def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        saved = np.load(io.BytesIO(packed))
        wanted = np.zeros(1 << BUCKET_BITS, bool)
        wanted[saved["picked"]] = True
        return wanted, saved["picked"], saved["weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, own, weights = worker_cache(mark, tables)
        for batch, group in by_bytes(batches, "text", GROUP_BYTES):
            found = [np.searchsorted(own, present(t.decode("utf-8"), wanted)) for t in group]
            logits = np.array([weights[f].sum() for f in found]) + constant
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-logits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["id", "score", "predicted"],
            )

    schema = f"id {id_type}, score double, predicted int"
    return map_arrow(picked, run, schema).withColumnRenamed("id", id_column)


def toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> DataFrame:
    """Learn from the labelled rows that are not held out, score all rows of ``df``."""
    marks = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    marks = marks.groupBy(F.col(id_column).alias("id")).agg(
        F.max(F.when(F.col(label_column) == 1, 1).otherwise(0)).alias("toxic")
    )
    texts = df.where(~held_out(df[id_column])).select(
        df[id_column].alias("id"), F.coalesce(df[text_column], F.lit("")).alias("text")
    )
    out = predict(df, learn(*sampled(texts, marks)), id_column, text_column)
    return out.select(
        id_column, held_out(F.col(id_column)).alias("held_out"), "score", "predicted"
    )


def op13_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
