"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are taken relative to a centre, scaled to unit length and rotated at random; a code
is the signs of the rotated components. With the code's own inner product with the vector as
correction, packed bits give an unbiased estimate of the inner product with any query, and
its error is within ``BOUND / sqrt(bits)`` of a known scale but for a tiny chance (with 4, one
in 30,000). A vector is compared exactly only if the lower bound of its distance is within
the k-th true distance found so far.

Vectors that are null, zero or hold null or non-finite components take no part. Only vectors
of the query's dimension are candidates. Candidates never include the query's own row's id;
repeated ids are candidates each. Fewer candidates than ``k`` give fewer rows; ties go to the
smaller id. Empty tables give an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import map_arrow, table
from termloom.llm.words import worker_cache
from termloom.session import pinned

BLOCK_VALUES = 1 << 19  # vector components in a block
QUERY_VALUES = 1 << 16  # query components in a block, and distances kept for its queries
QUERY_TILE = 64  # queries compared at once
PAIRS = 1 << 16  # pairs compared exactly at once
LEAST_BITS = 256
FIRST_COMPARED = 8  # times k vectors whose true distances set the first limit
TASKS_PER_CORE = 4  # copies of the query blocks, which vector blocks share
CENTRE_ROWS = 4096  # the centre is the mean of so many vectors; any centre is right
BOUND = 4.0
SEED = 11


def usable(vector: Column) -> Column:
    """True for a vector that has finite components only and not all zero."""
    good = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def code_bits(dimension: int) -> int:
    """Bits of a code: short vectors are filled up with zeros, which tightens the bounds."""
    return max(dimension, LEAST_BITS)


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    """Columns of a random orthogonal matrix, the same wherever it is made."""

    def draw() -> np.ndarray:
        bits = code_bits(dimension)
        normal = np.random.default_rng((seed, dimension)).standard_normal((bits, bits))
        q, r = np.linalg.qr(normal)
        return (q * np.sign(np.diag(r)))[:, :dimension]

    return worker_cache(f"rotation:{dimension}:{seed}", draw)


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distance from the centre, and the code's inner product with its vector."""
    moved = vectors - centre
    length = np.sqrt((moved * moved).sum(1))
    unit = moved / np.where(length > 0, length, 1)[:, None]
    turned = unit @ rotation(vectors.shape[1]).T
    correction = np.abs(turned).sum(1) / math.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1), length, correction


def unpacked(codes: np.ndarray, bits: int) -> np.ndarray:
    """Signs of a code as columns of 1 and -1."""
    return np.ascontiguousarray(
        (np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1).T
    )


def distance_bounds(
    signs: np.ndarray,
    length: np.ndarray,
    correction: np.ndarray,
    queries: np.ndarray,
    centre: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances, a row per query.

    The inner product of two unit vectors is estimated by that of the query and the code
    over the correction; what the code leaves out is spread over the other directions.
    """
    bits = len(signs)
    moved = queries - centre
    reach = np.sqrt((moved * moved).sum(1))
    turned = (moved @ rotation(queries.shape[1]).T) / np.where(reach > 0, reach, 1)[:, None]
    dots = (turned.astype(np.float32) @ signs).astype(np.float64) / math.sqrt(bits)
    scale = np.where(correction > 0, correction, 1)
    inner = dots / scale
    slack = np.sqrt(np.maximum(1 - correction**2, 0)) / scale * (BOUND / math.sqrt(bits - 1))
    slack = slack + 1e-5  # single precision in the product above
    both = 2 * reach[:, None] * length
    base = reach[:, None] ** 2 + length**2
    return base - both * np.minimum(inner + slack, 1), base - both * np.maximum(inner - slack, -1)


def squared_distances(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of pairs of columns of ``a`` and ``b``, in double, components added in order."""
    total = np.zeros(len(at))
    for lo in range(0, len(at), PAIRS):
        part = slice(lo, lo + PAIRS)
        for x, y in zip(a, b, strict=True):
            gap = x.take(at[part]) - y.take(to[part])
            total[part] += gap * gap
    return total


def nearest_in_block(
    block: dict, queries: dict, centre: np.ndarray, k: int, best: np.ndarray | None = None
):
    """Query number, vector number and squared distance of the k nearest of each query.

    ``best`` holds the k smallest squared distances of each query in the blocks before, and is
    brought up to date. Where there are not yet as many, the vectors with the smallest estimates
    are compared first. The k-th true distance is the limit that the lower bound of any other
    must not exceed.
    """
    if best is None:
        best = np.full((len(queries["ids"]), k), np.inf)
    signs = unpacked(block["codes"], code_bits(len(centre)))
    vectors, points = (np.ascontiguousarray(x["vectors"].T) for x in (block, queries))
    found = []
    for start in range(0, len(queries["ids"]), QUERY_TILE):
        part = slice(start, start + QUERY_TILE)
        asked = queries["vectors"][part]
        low, high = distance_bounds(signs, block["length"], block["correction"], asked, centre)
        own = queries["ids"][part, None] == block["ids"][None, :]
        low[own] = np.inf
        limit = best[part].max(1)
        few = FIRST_COMPARED * k
        if low.shape[1] > few and np.isinf(limit).any():
            middle = np.where(own, np.inf, low + high)
            first = np.argpartition(middle, few - 1, axis=1)[:, :few]
            row = np.repeat(np.arange(len(asked)), few)
            true = squared_distances(vectors, first.ravel(), points, row + start)
            true = np.where(own[row, first.ravel()], np.inf, true).reshape(-1, few)
            limit = np.minimum(limit, np.partition(true, k - 1, axis=1)[:, k - 1])
        query, vector = np.nonzero((low <= limit[:, None]) & ~own)
        squared = squared_distances(vectors, vector, points, query + start)
        near = squared <= limit[query]
        query, vector, squared = query[near], vector[near], squared[near]
        order = np.lexsort((block["ids"][vector], squared, query))
        query, vector, squared = query[order], vector[order], squared[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < k
        query, vector, squared = query[kept], vector[kept], squared[kept]
        both = np.concatenate([best[part], np.full((len(asked), k), np.inf)], axis=1)
        both[query, place[kept] + k] = squared
        best[part] = np.partition(both, k - 1, axis=1)[:, :k]
        found.append((query + start, vector, squared))
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _rows(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    vector = df[vector_column]
    return df.where(usable(vector) & df[id_column].isNotNull()).select(
        df[id_column].cast("long").alias("id"),
        F.size(vector).alias("dimension"),
        vector.cast("array<double>").alias("vector"),
    )


def _blocks(
    rows: DataFrame, values: int, centres: dict[int, np.ndarray] | None, least: int = 1
) -> DataFrame:
    """Rows of about ``values`` components of one dimension; with codes if there are centres.

    A vector counts as ``least`` components at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dimension: int) -> pa.RecordBatch:
            nonlocal number
            parts = held.pop(dimension)
            ids = np.concatenate([p[0] for p in parts])
            vectors = np.concatenate([p[1] for p in parts])
            number += 1
            row = {
                "block": pa.array([number], pa.int64()),
                "dimension": pa.array([dimension], pa.int32()),
                "ids": [ids.tobytes()],
                "vectors": [vectors.tobytes()],
            }
            if centres is not None:
                codes, length, correction = encode(vectors, centre_of(centres, dimension))
                row |= {
                    "codes": [codes.tobytes()],
                    "length": [length.tobytes()],
                    "correction": [correction.tobytes()],
                }
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            sizes = np.asarray(batch.column("dimension"))
            for dimension in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dimension))
                ids = np.asarray(part.column("id"), np.int64)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                vectors = flat.reshape(-1, dimension)
                step = max(1, values // max(dimension, least))
                for at in range(0, len(ids), step):
                    held.setdefault(dimension, []).append(
                        (ids[at : at + step], vectors[at : at + step])
                    )
                    if sum(len(p[0]) for p in held[dimension]) >= step:
                        yield block(dimension)
        for dimension in list(held):
            yield block(dimension)

    schema = "block long, dimension int, ids binary, vectors binary"
    if centres is not None:
        schema += ", codes binary, length binary, correction binary"
    return map_arrow(rows, run, schema)


def centres_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """Means of the first ``CENTRE_ROWS`` vectors by hash, by dimension.

    They are looked for among the vectors below a hash that leaves a few times as many, so what
    the tasks send does not grow with their number; the driver gets the means alone.
    """

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            sizes = np.asarray(batch.column("dimension"))
            for dimension in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dimension)).column("vector")
                part = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                n, total = sums.get(dimension, (0, np.zeros(dimension)))
                sums[dimension] = n + len(part), np.vstack([total, part]).sum(0)
        for dimension, (n, total) in sums.items():
            columns = [[dimension], [n], [(total / n).tobytes()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))],
                names=["dimension", "n", "centre"],
            )

    hashed = rows.withColumn("hash", F.xxhash64("id"))
    count = rows.count()
    share = 4 * CENTRE_ROWS / max(count, 1)
    while True:
        some = hashed
        if share < 1:
            some = hashed.where(F.col("hash") < F.lit(int(share * 2**64) - 2**63))
        first = some.orderBy("hash", "id").limit(CENTRE_ROWS).select("dimension", "vector")
        found = map_arrow(first, mean, "dimension int, n long, centre binary").collect()
        if share >= 1 or sum(r["n"] for r in found) >= CENTRE_ROWS:
            return {r["dimension"]: np.frombuffer(r["centre"]) for r in found}
        share *= 16  # ids repeat, so that few of them are below the hash


def centre_of(centres: dict[int, np.ndarray], dimension: int) -> np.ndarray:
    """Zero for a dimension that no vector of the sample has."""
    return centres[dimension] if dimension in centres else np.zeros(dimension)


def search(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, the candidate's id and ``score``, its Euclidean distance.

    Every block of vectors meets every block of queries of its dimension once: query blocks
    are repeated per vector block and joined by its number, by sorted shuffles, since the size of
    repeated blocks is not known when a broadcast is chosen. Per pair only k rows a query leave
    the task.
    """
    rows = _rows(candidates, id_column, vector_column)
    centres = centres_of(rows)
    index = pinned(_blocks(rows, BLOCK_VALUES, centres), "codes")
    asked = _rows(queries, id_column, vector_column)
    asked = pinned(_blocks(asked, QUERY_VALUES, None, k), "queries")
    # Salted, so that no task repeats the query blocks for all vector blocks.
    salts = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    numbers = index.select("dimension", "block").withColumn(
        "salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    )
    repeated = asked.select(
        "dimension",
        F.col("block").alias("q_block"),
        F.col("ids").alias("q_ids"),
        F.col("vectors").alias("q_vectors"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    spread = numbers.hint("merge").join(repeated.hint("merge"), ["dimension", "salt"])
    pairs = index.hint("merge").join(spread.drop("dimension", "salt").hint("merge"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # by block of queries
        for batch in batches:
            for i in range(batch.num_rows):
                value = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                d = value["dimension"]
                block = {
                    "ids": np.frombuffer(value["ids"], np.int64),
                    "vectors": np.frombuffer(value["vectors"]).reshape(-1, d),
                    "codes": np.frombuffer(value["codes"], np.uint8).reshape(-1, (code_bits(d) + 7) // 8),
                    "length": np.frombuffer(value["length"]),
                    "correction": np.frombuffer(value["correction"]),
                }
                asked = {
                    "ids": np.frombuffer(value["q_ids"], np.int64),
                    "vectors": np.frombuffer(value["q_vectors"]).reshape(-1, d),
                }
                kept = best.setdefault(value["q_block"], np.full((len(asked["ids"]), k), np.inf))
                centre = centre_of(centres, d)
                query, vector, squared = nearest_in_block(block, asked, centre, k, kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(asked["ids"][query]),
                        pa.array(block["ids"][vector]),
                        pa.array(np.sqrt(squared)),
                    ],
                    names=["query_id", "id", "score"],
                )

    found = map_arrow(pairs, run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")


def op6_rotated_codes(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings")
    return search(embeddings, embeddings.where(F.col("vec_id") % 100 == 0))


OP6_SQL = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_sum([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) FOR i IN range(1, len(q.v) + 1)]))
           AS score
  FROM good q JOIN good c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""
