"""Exact inner-product search that skips blocks of a large catalog by a bound.

Entities are gathered around pivots. With a block's pivot p, its radius r (the farthest entity
from p) and its longest entity m, no inner product of a query q with the block exceeds
``min(q·p + |q| r, |q| m)``. A query is first scored in its most promising blocks, whose k-th
best score is a floor; then it is scored in the blocks whose bound reaches that floor. Blocks of
near pivots share an area of bounded size: a query travels once to each area that holds such a block,
with a bit for each block there, so what is sent does not grow with the number of blocks. The rows are
those of ``operators.search.search``, whatever the pivots are.

Pivots are means of a bounded sample (``MAX_PIVOTS`` times ``ROWS_PER_PIVOT`` rows at most); all
entities are assigned, counted and searched. A block has about ``block_rows`` entities: a
crowded pivot is cut into several blocks. What is sent to the tasks is one vector per pivot and
three numbers per block, both bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.operators.ranking import top_k
from termloom.operators.search import _block_top_k, _Entities, _matrix
from termloom.session import pinned

MAX_PIVOTS = 4096
MAX_BLOCKS = 1 << 18
PIVOT_BYTES = 16 << 20
ROWS_PER_PIVOT = 32
ROUNDS = 3
AREA_ROWS = 16384  # entities that meet a part of the queries in one task
AREA_BYTES = 32 << 20
_CELLS = 1 << 22  # cells of a matrix of bounds or distances made at once


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, and the distance to it."""
    half = (pivots**2).sum(1) / 2
    found, far = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    tile = max(1, _CELLS // max(len(pivots), rows.shape[1] if rows.ndim > 1 else 1))
    for lo in range(0, len(rows), tile):
        part = rows[lo : lo + tile]
        best = (part @ pivots.T - half).argmax(1)
        found[lo : lo + tile] = best
        far[lo : lo + tile] = np.sqrt(((part - pivots[best]) ** 2).sum(1))
    return found, far


def _means(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` pivots: the first rows of the sample, moved to the means around them."""
    pivots = sample[:count].copy()
    for _ in range(ROUNDS):
        near, _ = _nearest(sample, pivots)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=count)
        pivots[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return pivots


class _Bounds:
    """Upper bounds of the inner products of queries with all blocks."""

    def __init__(self, pivots: np.ndarray, blocks: dict[str, np.ndarray]):
        self.pivots, self.blocks = pivots, blocks
        lengths = np.linalg.norm(pivots, axis=1)[blocks["pivot"]]
        self.widest = blocks["norm"] + lengths + blocks["radius"]

    def tiles(self, queries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, bounds of some rows with every block), a margin for rounding included."""
        b = self.blocks
        step = max(1, _CELLS // max(len(b["pivot"]), 1))
        margin = 4 * (queries.shape[1] + 16) * 2.0**-52
        for lo in range(0, len(queries), step):
            part = queries[lo : lo + step]
            size = np.linalg.norm(part, axis=1)[:, None]
            near = (part @ self.pivots.T)[:, b["pivot"]] + size * b["radius"]
            yield lo, np.minimum(near, size * b["norm"]) + margin * size * self.widest

    def first_blocks(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Mask of each query's best blocks that hold ``k`` entities together."""
        order = np.arange(bounds.shape[1])[None, :].repeat(len(bounds), 0)
        if bounds.shape[1] > k:  # a block holds one entity at least
            order = np.sort(np.argpartition(-bounds, k - 1, axis=1)[:, :k], axis=1)
        best = np.argsort(-np.take_along_axis(bounds, order, axis=1), axis=1, kind="stable")
        order = np.take_along_axis(order, best, axis=1)
        held = np.cumsum(self.blocks["n"][order], axis=1) - self.blocks["n"][order]
        mask = np.zeros(bounds.shape, bool)
        np.put_along_axis(mask, order, held < k, axis=1)
        return mask


class PivotIndex:
    """A catalog cut into blocks around pivots, for any number of searches."""

    def __init__(
        self,
        catalog: DataFrame,
        entity: str = "entity_id",
        entity_vec: str = "embedding",
        block_rows: int = 4096,
    ) -> None:
        e = catalog.select(F.col(entity).alias("entity_id"), F.col(entity_vec).alias("vec"))
        e = e.where("vec is not null")
        size = e.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
        self.count, width = size["n"], max(size["width"] or 1, 1)
        block_rows = max(block_rows, -(-self.count // MAX_BLOCKS), 1)
        most = max(1, min(MAX_PIVOTS, PIVOT_BYTES // (8 * width)))
        n_pivots = max(1, min(most, -(-self.count // block_rows)))
        drawn = e.orderBy(F.xxhash64("entity_id"), "entity_id").limit(n_pivots * ROWS_PER_PIVOT)
        sample = drawn.toArrow()
        rows = _matrix(sample, "vec").astype(np.float64) if sample.num_rows else np.zeros((1, width))
        self.pivots = _means(rows, min(n_pivots, len(rows)))
        self.rows = pinned(self._blocks(e, block_rows), "blocks")
        # One row per block, MAX_BLOCKS and as many as there are pivots at most.
        stats = self.rows.groupBy("block").agg(
            F.first("pivot").alias("pivot"),
            F.count("*").alias("n"),
            F.max("far").alias("radius"),
            F.max("norm").alias("norm"),
        )
        table = stats.toArrow().sort_by("block")
        self.blocks = {c: table.column(c).to_numpy() for c in table.column_names}
        area_rows = max(1, min(AREA_ROWS, AREA_BYTES // (8 * width)))
        # Where the blocks of each area are, and its blocks in order.
        self.areas = self._areas(area_rows)
        ends = [(a, at, b) for a, part in enumerate(self.areas) for at, b in enumerate(part)]
        columns = np.array(ends, np.int64).reshape(-1, 3).T
        placed = {"area": columns[0], "at": columns[1], "block": self.blocks["block"][columns[2]]}
        placed = pa.table({c: pa.array(v, pa.int64()) for c, v in placed.items()})
        # One row per block.
        self.placed = catalog.sparkSession.createDataFrame(placed)

    def _areas(self, area_rows: int) -> list[np.ndarray]:
        """Positions of the blocks of each area; about ``area_rows`` entities are in one."""
        held, pivot = self.blocks["n"], self.blocks["pivot"]
        if not len(held):
            return []
        coarse = min(-(-self.count // area_rows), len(self.pivots))
        near, _ = _nearest(self.pivots, _means(self.pivots, coarse))
        order = np.lexsort((pivot, near[pivot]))
        area = (np.cumsum(held[order]) - held[order]) // area_rows
        return np.split(order, np.flatnonzero(np.diff(area)) + 1)

    def _blocks(self, e: DataFrame, block_rows: int) -> DataFrame:
        """Entities with their pivot, the distance to it, their length, and their block."""
        pivots = self.pivots
        kinds = {f.name: f.dataType.simpleString() for f in e.schema}

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = _matrix(pa.Table.from_batches([batch]), "vec").astype(np.float64)
                    near, far = _nearest(rows, pivots)
                    columns = [near, far, np.linalg.norm(rows, axis=1)]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns, *map(pa.array, columns)],
                        names=["entity_id", "vec", "pivot", "far", "norm"],
                    )

        near = e.mapInArrow(
            assign,
            f"entity_id {kinds['entity_id']}, vec {kinds['vec']}, pivot long, far double, norm double",
        )
        near = pinned(near, "assigned")
        parts = near.groupBy("pivot").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
        # One row per pivot.
        cut = near.join(F.broadcast(parts), "pivot")
        part = F.pmod(F.xxhash64("entity_id"), F.col("parts"))
        return cut.withColumn("block", F.col("pivot") * F.lit(1 << 32) + part).drop("parts")

    def search(
        self, queries: DataFrame, k: int = 10, query: str = "query_id", query_vec: str = "embedding"
    ) -> DataFrame:
        """Exact top-k entities per query: (query_id, entity_id, score, rank)."""
        return self._scored(self._pairs(queries, k, query, query_vec)[1], k)

    def block_pairs(
        self, queries: DataFrame, k: int = 10, query: str = "query_id", query_vec: str = "embedding"
    ) -> DataFrame:
        """One row: pairs of a query and a block, those that were scored, and the share skipped."""
        first, later = self._pairs(queries, k, query, query_vec)
        n = queries.where(F.col(query_vec).isNotNull()).select(F.count("*")).scalar()
        every = n * F.lit(len(self.blocks["n"]))
        both = first.select("fresh").unionByName(later.select("fresh"))
        scored = F.coalesce(F.sum("fresh"), F.lit(0)).alias("scored")
        counted = both.agg(scored).select(every.alias("pairs"), "scored")
        return counted.withColumn("skipped", 1 - F.try_divide(F.col("scored"), F.col("pairs")))

    def _pairs(
        self, queries: DataFrame, k: int, query: str, query_vec: str
    ) -> tuple[DataFrame, DataFrame]:
        """Queries with the blocks they are scored in first, and with all that reach their floor."""
        q = queries.select(F.col(query).alias("query_id"), F.col(query_vec).alias("vec"))
        q = q.where("vec is not null")
        first = self._sent(q.withColumn("floor", F.lit(None).cast("double")), k)
        early = self._scored(first, k)
        floors = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        return first, self._sent(q.join(floors, "query_id", "left"), k, later=True)

    def _sent(self, q: DataFrame, k: int, later: bool = False) -> DataFrame:
        """(query_id, vec, area, reach, fresh) of the first blocks, or of all that reach the floor.

        ``reach`` has a bit for each block of the area; ``fresh`` counts those not taken before.
        """
        pivots, blocks, areas = self.pivots, self.blocks, self.areas
        kinds = {f.name: f.dataType.simpleString() for f in q.schema}

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = _Bounds(pivots, blocks)
            for batch in batches:
                if not batch.num_rows or not len(blocks["n"]):
                    continue
                vectors = _matrix(pa.Table.from_batches([batch]), "vec").astype(np.float64)
                if vectors.shape[1] != pivots.shape[1]:
                    raise ValueError("query and entity vectors differ in length")
                floor = batch.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                for lo, upper in bounds.tiles(vectors):
                    mask = new = bounds.first_blocks(upper, k)
                    if later:
                        mask = upper >= floor[lo : lo + len(upper), None]
                        new = mask & ~new
                    for number, inside in enumerate(areas):
                        part = mask[:, inside]
                        rows = np.flatnonzero(part.any(1))
                        if not len(rows):
                            continue
                        bits = np.packbits(part[rows], axis=1)
                        ends = np.arange(len(rows) + 1, dtype=np.int32) * bits.shape[1]
                        sides = [None, pa.py_buffer(ends), pa.py_buffer(bits.tobytes())]
                        reach = pa.Array.from_buffers(pa.binary(), len(rows), sides)
                        fresh = new[:, inside][rows].sum(1)
                        taken = batch.select(["query_id", "vec"]).take(pa.array(rows + lo))
                        area = np.full(len(rows), number)
                        yield pa.RecordBatch.from_arrays(
                            [*taken.columns, pa.array(area), reach, pa.array(fresh)],
                            names=["query_id", "vec", "area", "reach", "fresh"],
                        )

        schema = f"query_id {kinds['query_id']}, vec {kinds['vec']}, area long, reach binary, fresh long"
        return q.select("query_id", "vec", "floor").mapInArrow(choose, schema)

    def _scored(self, sent: DataFrame, k: int, query_rows: int = 16384) -> DataFrame:
        """Best ``k`` of each query in the blocks it reaches.

        An area that many queries come to meets them in parts of about ``query_rows``.
        """
        schema = T.StructType(
            [
                T.StructField("query_id", sent.schema["query_id"].dataType),
                T.StructField("entity_id", self.rows.schema["entity_id"].dataType),
                T.StructField("score", T.DoubleType()),
                T.StructField("rank", T.IntegerType()),
            ]
        )
        sent = pinned(sent, "sent")
        # Few areas would give few groups: then the queries are cut finer, up to the cores.
        cores = sent.sparkSession.sparkContext.defaultParallelism
        spread = F.least(F.ceil(F.count("*") / 256), F.lit(-(-cores // max(len(self.areas), 1))))
        count = F.greatest(F.ceil(F.count("*") / query_rows), spread).cast("long")
        parts = sent.groupBy("area").agg(count.alias("parts"))
        # One row per area, and one per block.
        left = sent.join(F.broadcast(parts), "area").select(
            "query_id",
            "vec",
            "reach",
            "area",
            F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"),
        )
        placed = self.rows.join(F.broadcast(self.placed), "block")
        right = placed.join(F.broadcast(parts), "area").select(
            "entity_id",
            "vec",
            "at",
            "area",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        )

        def score(left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
            if not left_rows.num_rows or not right_rows.num_rows:
                return pa.table(
                    {
                        "query_id": left_rows.column("query_id").slice(0, 0),
                        "entity_id": right_rows.column("entity_id").slice(0, 0),
                        "score": pa.array([], pa.float64()),
                        "rank": pa.array([], pa.int32()),
                    }
                )
            packed = b"".join(left_rows.column("reach").to_pylist())
            bits = np.frombuffer(packed, np.uint8).reshape(left_rows.num_rows, -1)
            # Queries that reach the same blocks are scored together.
            order = np.lexsort(bits.T[::-1]) if bits.shape[1] < 512 else bits.argmax(1).argsort()
            entities = _Entities(right_rows)
            at = right_rows.column("at").to_numpy()[entities.order]
            queries = left_rows.select(["query_id", "vec"]).take(pa.array(order))
            return _block_top_k(queries, entities, k, None, (bits[order], at))

        keys = ["area", "part"]
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)
        return top_k(hits.drop("rank"), k)
