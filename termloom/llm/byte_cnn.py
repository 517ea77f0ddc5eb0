"""Language identification with a convolutional network over bytes.

Byte embeddings, filters of several widths, the maximum of each filter over a window of fixed
length, and a softmax over the learned languages; trained in numpy on windows of labelled
texts. Every window of a text is classified and the mean of their probabilities, weighted by
their letters, decides.

The sample is bounded: ``ROWS_PER_LANG`` ids of each language at most, those with the smallest
hash, of the ``MAX_LANGS`` languages with most rows, and ``WINDOWS_PER_ROW`` windows at random
places of each; an id with several texts teaches by one of them. Rows with a null label or a null
id are not learned from. An empty table gives an empty one. A very long text is read in rows of
windows, so it needs some times its own size of memory. Null text and
text without letters is ``und`` with score 0; so is every text if nothing could be learned.
Repeated rows are classified each; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import by_bytes, map_arrow, table
from termloom.llm.words import worker_cache

WINDOW = 128
ROWS_PER_LANG = 1500
MAX_LANGS = 200
WINDOWS_PER_ROW = 2
EMBEDDING = 8
FILTERS = 16
WIDTHS = (2, 3, 4)
EPOCHS = 4
BATCH = 128
RATE = 0.01
GROUP_BYTES = 1 << 20
SEED = 5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_LETTER_BYTE = np.zeros(256, np.float32)
_LETTER_BYTE[97:123] = 1
_LETTER_BYTE[128:] = 1


def windows(text: bytes) -> np.ndarray:
    """The text's bytes in rows of WINDOW, the last one filled up with zero bytes."""
    rows = max(1, -(-len(text) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, WINDOW)


@dataclass
class Network:
    """Weights: byte embeddings, filters by width and offset, their biases, the last layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per width, what a pair or a single byte at an offset adds to each filter."""
        found = {}
        for width, weights in self.filters.items():
            single = [self.embedding @ weights[j] for j in range(width)]
            steps = []
            for j in range(0, width - 1, 2):
                pair = single[j][:, None, :] + single[j + 1][None, :, :]
                steps.append((j, pair.reshape(65536, -1).astype(np.float32)))
            if width % 2:
                steps.append((width - 1, single[-1].astype(np.float32)))
            found[width] = steps
        return found

    def probabilities(self, rows: np.ndarray, tables) -> np.ndarray:
        pairs = rows[:, :-1].astype(np.uint16) * np.uint16(256) + rows[:, 1:]
        pooled = []
        for width, steps in tables.items():
            span = WINDOW - width + 1
            total = None
            for j, values in steps:
                index = pairs if len(values) == 65536 else rows
                part = values.take(index[:, j : j + span], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(np.maximum(total.max(1) + self.biases[width], 0))
        return softmax(np.concatenate(pooled, 1) @ self.out + self.out_bias)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = SEED) -> Network:
    """Fit by Adam on cross entropy; gradients pass the maximum at its place only."""
    random = np.random.default_rng(seed)
    n_classes = len(languages)
    epochs = EPOCHS if len(rows) else 0
    p: dict = {"e": random.normal(0, 0.3, (256, EMBEDDING))}
    for w in WIDTHS:
        p[f"w{w}"] = random.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p["v"] = random.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_classes))
    p["c"] = np.zeros(n_classes)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        for part in np.array_split(random.permutation(len(rows)), max(1, len(rows) // BATCH)):
            x, y = rows[part], labels[part]
            n = len(x)
            line = np.arange(n)[:, None]
            e = p["e"][x]
            places, pooled = {}, []
            for w in WIDTHS:
                span = WINDOW - w + 1
                conv = sum(e[:, j : j + span] @ p[f"w{w}"][j] for j in range(w))
                places[w] = conv.argmax(1)
                pooled.append(np.take_along_axis(conv, places[w][:, None], 1)[:, 0] + p[f"b{w}"])
            before = np.concatenate(pooled, 1)
            hidden = np.maximum(before, 0)
            error = softmax(hidden @ p["v"] + p["c"])
            error[np.arange(n), y] -= 1
            error /= n
            g = {"v": hidden.T @ error, "c": error.sum(0), "e": np.zeros_like(p["e"])}
            back = (error @ p["v"].T) * (before > 0)
            for i, w in enumerate(WIDTHS):
                here = back[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"b{w}"] = here.sum(0)
                g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    at = places[w] + j
                    g[f"w{w}"][j] = np.einsum("nf,nfd->df", here, e[line, at])
                    np.add.at(
                        g["e"],
                        x[line, at].ravel(),
                        (here[:, :, None] * p[f"w{w}"][j].T).reshape(-1, EMBEDDING),
                    )
            step += 1
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                size = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                p[k] -= (size * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)
    return Network(
        languages,
        p["e"],
        {w: p[f"w{w}"] for w in WIDTHS},
        {w: p[f"b{w}"] for w in WIDTHS},
        p["v"],
        p["c"],
    )


def held_out(id_column: Column) -> Column:
    """True for rows whose id's crc32 leaves remainder 1; they are never learned from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def sample(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and label numbers from a bounded part of ``id``, ``text``, ``lang``."""
    counts = labelled.groupBy("lang").count()
    most = counts.orderBy(F.col("count").desc(), "lang").limit(MAX_LANGS).collect()
    languages = sorted(r["lang"] for r in most)
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    known = labelled.where(F.col("lang").isin(languages) & F.col("id").isNotNull())
    place = Window.partitionBy("lang").orderBy("draw", "id")
    ids = known.select("id", "lang", F.xxhash64("id").alias("draw")).distinct()
    ids = ids.withColumn("place", F.row_number().over(place)).where(F.col("place") <= ROWS_PER_LANG)
    # MAX_LANGS times ROWS_PER_LANG rows at most.
    chosen = known.join(F.broadcast(ids.select("id", "lang")), ["id", "lang"])
    chosen = chosen.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in by_bytes(batches, "text", GROUP_BYTES):
            names, cells = [], []
            for text, lang in zip(group, batch.column("lang").to_pylist(), strict=True):
                low = text.decode("utf-8").lower().encode("utf-8")
                random = np.random.default_rng(zlib.crc32(low))
                for _ in range(WINDOWS_PER_ROW):
                    at = int(random.integers(0, max(1, len(low) - WINDOW + 1)))
                    names.append(lang)
                    cells.append(low[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(cells, pa.binary())],
                names=["lang", "cell"],
            )

    found = map_arrow(chosen.select("text", "lang"), run, "lang string, cell binary")
    cells = found.orderBy("lang", "cell").collect()
    if not cells:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    rows = np.concatenate([windows(bytes(r["cell"])) for r in cells])
    numbers = {name: i for i, name in enumerate(languages)}
    return rows, np.array([numbers[r["lang"]] for r in cells]), languages


def predict(df: DataFrame, network: Network, id_column: str, text_column: str) -> DataFrame:
    """Id, ``lang_pred`` and ``score`` of every whole text."""
    picked = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()
    packed = pickle.dumps(network.__dict__)
    mark = f"network:{zlib.crc32(packed)}:{len(packed)}"

    def classify(group: list[bytes]) -> tuple[list[str], list[float]]:
        tables = worker_cache(mark, network.tables)
        low = [t.decode("utf-8") for t in group]
        some = [i for i, t in enumerate(low) if _LETTER.search(t)]
        names, scores = [UNKNOWN] * len(group), [0.0] * len(group)
        if not some or not network.languages:
            return names, scores
        cells = [windows(low[i].lower().encode("utf-8")) for i in some]
        rows = np.concatenate(cells)
        found = np.concatenate(
            [network.probabilities(rows[i : i + 64], tables) for i in range(0, len(rows), 64)]
        )
        weight = _LETTER_BYTE[rows].sum(1) + 1e-6
        starts = np.cumsum([0, *[len(c) for c in cells[:-1]]])
        mean = np.add.reduceat(found * weight[:, None], starts, axis=0)
        mean /= np.add.reduceat(weight, starts)[:, None]
        best = mean.argmax(1)
        for i, b, m in zip(some, best.tolist(), mean, strict=True):
            names[i], scores[i] = network.languages[b], min(1.0, float(m[b]))
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in by_bytes(batches, "text", GROUP_BYTES):
            names, scores = classify(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    schema = f"id {id_type}, lang_pred string, score double"
    return map_arrow(picked, run, schema).withColumnRenamed("id", id_column)


def identify(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    labelled = df.where(~held_out(df[id_column]) & df[lang_column].isNotNull()).select(
        df[id_column].alias("id"), df[text_column].alias("text"), df[lang_column].alias("lang")
    )
    labelled = labelled.where(F.col("text").rlike(r"\p{L}"))
    network = train(*sample(labelled))
    out = predict(df, network, id_column, text_column)
    return out.select(
        id_column, held_out(F.col(id_column)).alias("held_out"), "lang_pred", "score"
    )


def op5_byte_cnn(spark: SparkSession, sf: str) -> DataFrame:
    return identify(table(spark, sf, "documents"))
