"""Quality rules: rule statistics per document, an isolation forest over them, and a verdict.

Path lengths over random splits tell how alone a document stands. The forest sees how far each
rate lies outside the range that is usual among labelled good rows; the ranges and the cut are
calibrated on all labelled rows. Null text has no words and fails the base rule. Repeated rows
get the same verdict each. A table without labels of both kinds has no cut: only the base rule
rejects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import by_bytes, map_arrow, table
from termloom.session import pinned

GROUP_BYTES = 4 << 20
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SAMPLE_ROWS = 4096  # the forest is fitted on at most so many labelled rows
TREES = 100
SUBSAMPLE = 256
STEPS = 1000  # rates are counted in steps of a thousandth
MOST = 100  # rates above are seen as this
GOOD_LOSS = 0.005  # share of labelled good rows that the cut may reject
RATES = (
    "symbol_rate",
    "sign_rate",
    "upper_share",
    "dup_line_share",
    "repeat_share",
    "same_word_share",
    "mean_word_chars",
)
# Every rate may be too high; only the mean length of words may be too low.
LOW = [RATES.index("mean_word_chars")]
SIDES = len(RATES) + len(LOW)

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"!?@^_=+~`{}[]\\/")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_STARTS = np.ones(256, bool)  # bytes that begin a code point
_STARTS[128:192] = False

STATISTICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_signs",
    "n_upper",
    "n_letters",
    "n_lines",
    "n_same_words",
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that the text holds twice or more.

    Windows get exact numbers by joining neighbours: 1, 2, 4, 8 words.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    width, counts = 1, None
    while width < window:
        step = min(width, window - width)
        ids = ids[: len(ids) - step] * len(ids) + ids[step:]
        _, ids, counts = np.unique(ids, return_inverse=True, return_counts=True)
        width += step
        if len(counts) == len(ids):
            return 0
    at = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge) > 0).sum())


def text_statistics(text: bytes) -> tuple[int, ...]:
    """The values named in STATISTICS for one text."""
    words = text.split()
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        int(seen[_STARTS].sum() - seen[_WHITE].sum()),
        int(seen[_SYMBOL].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        int(seen[_SIGN].sum()),
        int(seen[_UPPER].sum()),
        int(seen[_UPPER].sum() + seen[_LOWER].sum()),
        len(lines),
        sum(map(eq, words, islice(words, 1, None))),  # words equal to the one before
    )


def with_statistics(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per row of ``df``: its id, the statistics and ``base_failed``."""
    picked = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in by_bytes(batches, "text", GROUP_BYTES):
            found = np.array([text_statistics(t) for t in group], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(column) for column in found.T]],
                names=["id", *STATISTICS],
            )

    schema = ", ".join([f"id {id_type}", *[f"{name} long" for name in STATISTICS]])
    rows = map_arrow(picked, run, schema)
    return rows.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    )


def rates(statistics: dict[str, np.ndarray]) -> np.ndarray:
    """The values named in RATES, in whole steps."""
    words = np.maximum(statistics["n_words"], 1)
    found = [
        statistics["n_symbols"] / words,
        statistics["n_signs"] / words,
        statistics["n_upper"] / np.maximum(statistics["n_letters"], 1),
        statistics["n_dup_lines"] / np.maximum(statistics["n_lines"], 1),
        statistics["n_repeat_words"] / words,
        statistics["n_same_words"] / words,
        statistics["word_chars"] / words,
    ]
    return np.floor(np.minimum(np.stack(found, 1), MOST) * STEPS + 1e-9).astype(np.int64)


def features(statistics: dict[str, np.ndarray], usual: np.ndarray) -> np.ndarray:
    """How far each rate is outside its usual range, in doublings of a step; 0 inside."""
    found = rates(statistics)
    low, high = usual
    outside = np.concatenate([found - high, (low - found)[:, LOW]], 1)
    return np.floor(np.log2(1 + np.maximum(outside, 0)))


def usual_ranges(labelled: DataFrame) -> np.ndarray:
    """Lowest and highest usual step of each rate, from all labelled good rows.

    Each side leaves out its part of ``GOOD_LOSS`` at most, so all sides together do not reject
    more. The counts are ``MOST * STEPS`` numbers a rate at most, whatever the number of rows.
    """
    good = labelled.where(~F.col("base_failed") & (F.col("quality") == 1)).select(*STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in STATISTICS}
            for i, column in enumerate(rates(columns).T):
                steps, counts = np.unique(column, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(steps), i)), pa.array(steps), pa.array(counts)],
                    names=["rate", "step", "rows"],
                )

    counted = map_arrow(good, run, "rate long, step long, rows long")
    counts = counted.groupBy("rate", "step").agg(F.sum("rows").alias("rows")).toPandas()
    usual = np.array([[0] * len(RATES), [MOST * STEPS] * len(RATES)], np.int64)
    for i, part in counts.sort_values("step").groupby("rate"):
        steps, rows = part["step"].to_numpy(), part["rows"].to_numpy()
        spared = GOOD_LOSS * rows.sum() / SIDES
        up = np.cumsum(rows)
        usual[0, i] = steps[np.searchsorted(up, spared, "right")]
        usual[1, i] = steps[np.flatnonzero(up[-1] - up <= spared)[0]]
    return usual


@dataclass
class Forest:
    """Random trees as arrays: feature (-1 at a leaf), split or path length, child numbers."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    roots: np.ndarray
    scale: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected length): near 1 for rows that stand alone."""
        kinds, back = np.unique(rows, axis=0, return_inverse=True)
        total = np.zeros(len(kinds))
        for root in self.roots:
            node = np.full(len(kinds), root)
            while True:
                inner = self.feature[node] >= 0
                if not inner.any():
                    break
                at = node[inner]
                right = kinds[inner, self.feature[at]] >= self.value[at]
                node[inner] = self.child[at, right.astype(int)]
            total += self.value[node]
        scores = 2.0 ** (-total / max(len(self.roots), 1) / self.scale)
        return scores[back.ravel()]


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def fit_forest(rows: np.ndarray, seed: int = 7, every: np.ndarray | None = None) -> Forest:
    """Trees of random splits, each over ``SUBSAMPLE`` of the rows and the rows of ``every``."""
    random = np.random.default_rng(seed)
    feature: list[int] = []
    value: list[float] = []
    child: list[list[int]] = []
    size = min(SUBSAMPLE, len(rows))
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(feature)
        feature.append(-1)
        value.append(depth + _expected(len(part)))
        child.append([0, 0])
        if len(part) > 1 and depth < limit:
            low, high = part.min(0), part.max(0)
            free = np.flatnonzero(high > low)
            if len(free):
                f = int(random.choice(free))
                cut = float(random.uniform(low[f], high[f]))
                right = part[:, f] >= cut
                if right.any() and not right.all():
                    feature[at], value[at] = f, cut
                    child[at] = [grow(part[~right], depth + 1), grow(part[right], depth + 1)]
        return at

    more = rows[:0] if every is None else every
    roots = [
        grow(np.concatenate([rows[random.choice(len(rows), size, replace=False)], more]), 0)
        for _ in range(TREES if size else 0)
    ]
    return Forest(
        np.array(feature, int),
        np.array(value),
        np.array(child, int).reshape(-1, 2),
        np.array(roots, int),
        max(_expected(size), 1.0),
    )


def with_scores(rows: DataFrame, forest: Forest, usual: np.ndarray) -> DataFrame:
    """Add ``anomaly``, the forest's score of each row's statistics."""
    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in STATISTICS}
            scores = forest.score(features(columns, usual))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], names=[*names, "anomaly"]
            )

    return map_arrow(rows, run, f"{schema}, anomaly double")


def calibrate(scored: DataFrame) -> float | None:
    """Cut between two scores that best parts labelled good from labelled bad rows.

    All labelled rows that pass the base rule count. Scores come in steps, so the table of
    their counts is bounded by the forest's distinct leaves over whole doublings.
    """
    counts = (
        scored.where(~F.col("base_failed"))
        .groupBy(F.round("anomaly", 6).alias("score"))
        .agg(
            F.sum((F.col("quality") == 1).cast("long")).alias("good"),
            F.sum((F.col("quality") == 0).cast("long")).alias("bad"),
        )
    )
    by_score = counts.orderBy("score").collect()
    good = sum(r["good"] for r in by_score)
    bad = sum(r["bad"] for r in by_score)
    if not good or not bad:
        return None
    best, cut, lost, caught = 0.0, None, 0, 0
    for i in range(len(by_score) - 1, -1, -1):
        lost += by_score[i]["good"]
        caught += by_score[i]["bad"]
        if lost > GOOD_LOSS * good:
            break
        gain = caught / bad - lost / good
        if gain > best:
            below = by_score[i - 1]["score"] if i else by_score[i]["score"] - 1e-6
            best, cut = gain, (by_score[i]["score"] + below) / 2
    return cut


def fit_rows(labelled: DataFrame, usual: np.ndarray, id_column: str = "id") -> np.ndarray:
    """Features of the ``SAMPLE_ROWS`` labelled rows that come first by hash of their id."""
    part = (
        labelled.where(~F.col("base_failed"))
        .orderBy(F.xxhash64(id_column), id_column, *STATISTICS)
        .limit(SAMPLE_ROWS)
        .select(*STATISTICS)
        .toPandas()
    )
    return features({n: part[n].to_numpy() for n in STATISTICS}, usual)


def _fit(
    rows: DataFrame, labels: DataFrame, id_column: str
) -> tuple[Forest, np.ndarray, float | None]:
    """Forest, usual ranges and cut from the statistics of all rows and the labels of some.

    Each tree also sees a row per side that is as far outside as can be, so that every rate is
    split even where the sample has nothing unusual.

    ``labels`` has ``id_column`` and ``quality`` (1 good, 0 bad); other values and null ids
    are left out, and an id with both labels counts under each.
    """
    marks = (
        labels.where(F.col("quality").isin(0, 1))
        .select(F.col(id_column).alias("id"), "quality")
        .distinct()
    )
    labelled = pinned(rows.join(marks, "id"), "labelled")
    usual = usual_ranges(labelled)
    far = np.eye(SIDES) * math.floor(math.log2(1 + MOST * STEPS))
    forest = fit_forest(fit_rows(labelled, usual), every=far)
    return forest, usual, calibrate(with_scores(labelled, forest, usual))


def judge(
    df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Statistics, ``base_failed``, ``anomaly`` and ``kept`` of every row of ``df``."""
    rows = pinned(with_statistics(df, id_column, text_column), "statistics")
    forest, usual, cut = _fit(rows, labels, id_column)
    scored = with_scores(rows, forest, usual)
    passed = F.lit(True) if cut is None else F.col("anomaly") < F.lit(cut)
    return scored.withColumn("kept", ~F.col("base_failed") & passed).withColumnRenamed(
        "id", id_column
    )


def kept_rows(
    df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``df`` that are kept, judged where they are read; no text is shuffled."""
    rows = pinned(with_statistics(df, id_column, text_column), "statistics")
    forest, usual, cut = _fit(rows, labels, id_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in by_bytes(batches, text_column, GROUP_BYTES):
            found = np.array([text_statistics(t) for t in group], np.int64)
            columns = dict(zip(STATISTICS, found.T, strict=True))
            n, repeats = columns["n_words"], columns["n_repeat_words"]
            kept = (n >= MIN_WORDS) & (100 * repeats <= REPEAT_PERCENT * n)
            if cut is not None:
                kept &= forest.score(features(columns, usual)) < cut
            yield batch.filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return judge(table(spark, sf, "documents"), table(spark, sf, "labels")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "anomaly",
    )
