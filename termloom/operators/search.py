"""Exact inner-product search over vector columns."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.vectors import dot
from termloom.operators.ranking import top_k

Encoder = Callable[[DataFrame, str, str], DataFrame]
# A function from inner products to the scores that are returned; it never falls.
Link = Callable[[np.ndarray], np.ndarray]

_TILE = 256  # query rows scored at once inside a task, at most
_CELLS = 1 << 21  # pairs of a query and an entity scored at once, at most
_KEPT = 1 << 21  # hits that a task keeps for a block of queries
_LEAST = np.finfo(np.float32).min
_PART = 1 << 16  # pairs whose exact scores are added at once
_BLOCK_BYTES = 32 << 20  # vectors of a block of entities, in double
_MIN_BLOCK = 256  # smaller query blocks are not worth another task
_JOINED_ROWS = 16384  # small blocks of a large table are joined up to so many rows,
_COPIES = 16  # once it would be cut into more blocks than this


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    vectors = table.column(column).combine_chunks()
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = pc.min_max(pc.list_value_length(vectors)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors in {column} differ in length")
    if not np.isfinite(values).all():
        raise ValueError(f"vectors in {column} hold values that are not finite")
    return values.reshape(len(vectors), -1)


def _columns(matrix: np.ndarray) -> np.ndarray:
    """Components in double, each beside those of the other rows."""
    return np.ascontiguousarray(matrix.T, np.float64)


def _ordered_dot(q: np.ndarray, e: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Dot products of pairs of columns, added in order in double as the SQL expression does.

    Worked in parts, since many equal vectors make many pairs.
    """
    out = np.zeros(len(rows))
    for lo in range(0, len(rows), _PART):
        part = slice(lo, lo + _PART)
        for x, y in zip(q, e, strict=True):
            out[part] += x.take(rows[part]) * y.take(cols[part])
    return out


def _lengths(matrix: np.ndarray) -> np.ndarray:
    """Row norms in double, with 1 in place of 0."""
    norms = np.linalg.norm(matrix.astype(np.float64), axis=1)
    return np.where(norms > 0, norms, 1.0)


class _Entities:
    """Entity ids in order, their vectors, and these in single precision, scaled, as columns.

    Positions in id order make the tie rule an integer comparison.
    """

    def __init__(self, table: pa.Table):
        ids = table.column("entity_id").combine_chunks()
        order = pc.sort_indices(ids)
        self.ids = ids.take(order)
        self.order = order.to_numpy()
        vectors = _matrix(table, "vec")[self.order]
        self.longest = float(_lengths(vectors).max()) if len(vectors) else 1.0
        self.columns = _columns(vectors)
        self.scaled = np.ascontiguousarray((vectors / self.longest).astype(np.float32).T)


class _Queries:
    """Query ids, their vectors as columns, and these in single precision with length 1."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("query_id").combine_chunks()
        vectors = _matrix(table, "vec")
        self.lengths = _lengths(vectors)
        self.columns = _columns(vectors)
        self.scaled = (vectors / self.lengths[:, None]).astype(np.float32)


def _lowest_alike(scores: np.ndarray, link: Link) -> np.ndarray:
    """For each inner product a value at or just below the least one with the same link."""
    goal = link(scores)
    step = np.maximum(np.abs(scores), 1.0) * 2.0**-52
    while True:  # the range that holds the edge, then its halves
        alike = link(scores - step) >= goal
        if not alike.any() or not np.isfinite(step).all():
            break
        step = np.where(alike, 2 * step, step)
    low, high = scores - step, scores.copy()
    for _ in range(64):
        middle = low + (high - low) / 2
        alike = link(middle) >= goal
        high, low = np.where(alike, middle, high), np.where(alike, low, middle)
    return low


def _low_bound(approx: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that ``k`` of its cells reach, and few more.

    The k-th best of the highest cells of groups; neighbours are in different groups.
    """
    deep = max(1, min(64, approx.shape[1] // (8 * k)))
    groups = approx.shape[1] // deep
    if deep > 1:
        approx = approx[:, : groups * deep].reshape(len(approx), deep, groups).max(1)
    return np.partition(approx, groups - k, axis=1)[:, groups - k].astype(np.float64)


def _promising(
    approx: np.ndarray,
    k: int,
    slack: float,
    scale: np.ndarray,
    link: Link | None,
    known: np.ndarray | None,
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells that can be among the best ``k`` of their row.

    ``known`` has for each row the least product that counts beside entities scored before.
    """
    floor = np.full(len(approx), float(_LEAST))
    mask = None
    if known is not None and np.isfinite(known).any():
        floor = np.fmax(known / scale - slack, floor)
        mask = approx >= floor[:, None]
    if mask is None or np.count_nonzero(mask) > 4 * k * len(approx):
        if approx.shape[1] > k:
            own = np.maximum(_low_bound(approx, k) - slack, float(_LEAST))
            if link is not None:
                # No k-th best product is below the floor; what is scored like it counts too.
                own = np.minimum(own, _lowest_alike(own * scale, link) / scale - slack)
            floor = np.maximum(own, floor)
        mask = approx >= floor[:, None]
    return np.divmod(np.flatnonzero(mask), approx.shape[1])


def _scored(
    queries: _Queries,
    entities: _Entities,
    part: slice,
    k: int,
    link: Link | None = None,
    used: np.ndarray | None = None,
    seen: np.ndarray | None = None,
    known: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, entity and inner product of the pairs that can be among the best ``k`` of some queries.

    A float32 matrix product of vectors scaled to length 1 at most finds them, with a margin above
    its rounding error; they are scored again in double.
    """
    if len(queries.columns) != len(entities.columns):
        raise ValueError("query and entity vectors differ in length")
    slack = 2.0 * (len(queries.columns) + 8) * 2.0**-23
    approx = queries.scaled[part] @ (entities.scaled if used is None else entities.scaled[:, used])
    if seen is not None:
        approx[~seen] = -np.inf
    scale = queries.lengths[part] * entities.longest
    rows, cols = _promising(approx, k, slack, scale, link, known)
    if used is not None:
        cols = used[cols]
    return rows, cols, _ordered_dot(queries.columns[:, part], entities.columns, rows, cols)


def _first(rows: np.ndarray, scores: np.ndarray, ties: np.ndarray, k: int, n: int):
    """Positions of the best ``k`` of each of ``n`` rows in rank order, and their places."""
    best = np.lexsort((ties, -scores, rows))
    starts = np.searchsorted(rows[best], np.arange(n))
    place = np.arange(len(best)) - starts[rows[best]]
    return best[place < k], place[place < k]


def _hits(query_ids: pa.Array, entity_ids: pa.Array, rows, at, scores, place) -> pa.Table:
    return pa.table(
        {
            "query_id": query_ids.take(pa.array(rows)),
            "entity_id": entity_ids.take(pa.array(at)),
            "score": pa.array(scores),
            "rank": pa.array((place + 1).astype(np.int32)),
        }
    )


def _block_tiles(
    queries: pa.Table,
    entities: _Entities,
    k: int,
    link: Link | None = None,
    reach: tuple[np.ndarray, np.ndarray] | None = None,
) -> Iterator[pa.Table]:
    """Best ``k`` entities of one block for every query of one block, in rank order.

    Queries are ranked a few at a time, so that what is held does not grow with their hits. With
    a ``link``, which can give unequal products one score, all entities with the score of the k-th
    one are among those ranked.

    ``reach`` restricts the pairs: for each query a bit for each part, and the part of each entity.
    """
    asked = _Queries(queries)
    tile = max(1, min(_TILE, _CELLS // max(len(entities.ids), 1)))
    for lo in range(0, len(asked.ids), tile):
        used, seen = None, None
        part = slice(lo, lo + tile)
        if reach is not None:
            bits, parts = reach
            mask = np.unpackbits(bits[part], axis=1, count=int(parts.max()) + 1).view(bool)
            if not mask.all():
                used = np.flatnonzero(mask.any(0)[parts])
                seen = mask[:, parts[used]]
        rows, cols, scores = _scored(asked, entities, part, k, link, used, seen)
        if link is not None:
            scores = link(scores)
        best, place = _first(rows, scores, cols, k, tile)
        yield _hits(asked.ids, entities.ids, rows[best] + lo, cols[best], scores[best], place)


def _block_top_k(
    queries: pa.Table,
    entities: _Entities,
    k: int,
    link: Link | None = None,
    reach: tuple[np.ndarray, np.ndarray] | None = None,
) -> pa.Table:
    """The hits of all tiles of a block of queries."""
    return pa.concat_tables(_block_tiles(queries, entities, k, link, reach))


class _Running:
    """The best ``k`` entities of each query of a block, while blocks of entities come one by one.

    Kept are the products, by tile of queries, and where the ids of their entities are: about 2 k
    of each query at most.
    """

    def __init__(self, queries: pa.Table, k: int, link: Link | None):
        self.queries, self.k, self.link = _Queries(queries), k, link
        self.known = np.full(len(self.queries.ids), -np.inf)
        self.tiles: list[slice] = []
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: pa.Array | None = None
        self.ranks: np.ndarray | None = None

    def add(self, entities: _Entities) -> None:
        if self.ids is None:
            # Tiles stay as they are: later blocks are about as large.
            tile = max(1, min(_TILE, _CELLS // max(len(entities.ids), 1)))
            n = len(self.queries.ids)
            self.tiles = [slice(lo, min(lo + tile, n)) for lo in range(0, n, tile)]
            none = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0)
            self.kept = [none] * len(self.tiles)
        start = 0 if self.ids is None else len(self.ids)
        self.ids = entities.ids if self.ids is None else pa.concat_arrays([self.ids, entities.ids])
        self.ranks = None
        for number, part in enumerate(self.tiles):
            known = self.known[part]
            rows, cols, products = _scored(
                self.queries, entities, part, self.k, self.link, known=known
            )
            new = rows.astype(np.uint16), cols + start, products
            both = [np.concatenate(x) for x in zip(self.kept[number], new, strict=True)]
            self.kept[number] = self._cut(part, *both)
        self._drop_ids()

    def _cut(self, part: slice, rows: np.ndarray, at: np.ndarray, products: np.ndarray):
        """What can still be among the best of its query; ``known`` rises to the k-th best."""
        n = part.stop - part.start
        counts = np.bincount(rows, minlength=n)
        if counts.max(initial=0) < self.k:
            return rows, at, products
        order = np.argsort(rows, kind="stable")
        rows, at, products = rows[order], at[order], products[order]
        place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        wide = np.full((n, counts.max()), -np.inf)
        wide[rows, place] = products
        floor = np.partition(wide, wide.shape[1] - self.k, axis=1)[:, wide.shape[1] - self.k]
        full = counts >= self.k
        if self.link is not None:
            floor[full] = _lowest_alike(floor[full], self.link)
        self.known[part] = np.where(full, floor, -np.inf)
        keep = ~(products < floor[rows])
        rows, at, products = rows[keep], at[keep], products[keep]
        if np.bincount(rows, minlength=n).max() > 2 * self.k:
            best, _ = self._best(n, rows, at, products)
            rows, at, products = rows[best], at[best], products[best]
        return rows, at, products

    def _best(self, n: int, rows: np.ndarray, at: np.ndarray, products: np.ndarray):
        if self.ranks is None:
            self.ranks = np.empty(len(self.ids), np.int64)
            self.ranks[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        scores = products if self.link is None else self.link(products)
        return _first(rows, scores, self.ranks[at], self.k, n)

    def _drop_ids(self) -> None:
        """Forget ids of entities that are not kept, once they are most of them."""
        if len(self.ids) > _JOINED_ROWS + 2 * sum(len(at) for _, at, _ in self.kept):
            used = np.unique(np.concatenate([at for _, at, _ in self.kept]))
            self.ids, self.ranks = self.ids.take(pa.array(used)), None
            self.kept = [(r, np.searchsorted(used, at), p) for r, at, p in self.kept]

    def tables(self) -> Iterator[pa.Table]:
        """The hits in rank order, tile by tile."""
        if self.ids is None:
            return
        for part, (rows, at, products) in zip(self.tiles, self.kept, strict=True):
            best, place = self._best(part.stop - part.start, rows, at, products)
            scores = products if self.link is None else self.link(products)
            of = rows[best].astype(np.int64) + part.start
            yield _hits(self.queries.ids, self.ids, of, at[best], scores[best], place)


def search(
    queries: DataFrame,
    catalog: DataFrame,
    k: int = 10,
    query: str = "query_id",
    query_vec: str = "embedding",
    entity: str = "entity_id",
    entity_vec: str = "embedding",
    block_rows: int = 16384,
    broadcast_bytes: int = 32 << 20,
    link: Link | None = None,
) -> DataFrame:
    """Exact top-k entities per query: (query_id, entity_id, score, rank).

    With a ``link`` the score is its value of the inner product, and the rank is the rank of that
    score.

    Ids must be unique on each side. A catalog whose vectors are counted and found to fit
    in ``broadcast_bytes`` goes to every executor, and the queries are ranked where they
    are, without a shuffle. A larger one is searched block by block: a task keeps the best of a
    bounded part of the queries while it reads the blocks of the catalog. Every part reads every
    block, so blocks of ``block_rows`` are joined, up to a bounded size, where there would be more
    than a few.
    """
    index = CatalogIndex(catalog, entity, entity_vec, block_rows, broadcast_bytes)
    return index.search(queries, k, query, query_vec, link)


class CatalogIndex:
    """A catalog made ready for any number of searches: counted once, and sent once if it fits."""

    def __init__(
        self,
        catalog: DataFrame,
        entity: str = "entity_id",
        entity_vec: str = "embedding",
        block_rows: int = 16384,
        broadcast_bytes: int = 32 << 20,
    ) -> None:
        e = catalog.select(F.col(entity).alias("entity_id"), F.col(entity_vec).alias("vec"))
        self.rows = e.where("vec is not null")
        # Ids count with their text; 8 bytes a number covers float and double vectors.
        width = F.size("vec") * 8 + F.octet_length(F.col("entity_id").cast("string"))
        size = self.rows.agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(width), F.lit(0)).alias("bytes"),
            F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("width"),
        ).first()
        self.count = size["n"]
        # A block is bounded in bytes too, however wide the vectors are.
        self.most_rows = max(1, _BLOCK_BYTES // (8 * max(size["width"], 1)))
        joined = max(block_rows, min(_JOINED_ROWS, -(-self.count // _COPIES)))
        self.block_rows = min(joined, self.most_rows)
        self.shared = None
        if 0 < size["bytes"] <= broadcast_bytes:
            # A plain table: an executor without this package could not load an object of it.
            self.shared = e.sparkSession.sparkContext.broadcast(self.rows.toArrow())

    def search(
        self,
        queries: DataFrame,
        k: int = 10,
        query: str = "query_id",
        query_vec: str = "embedding",
        link: Link | None = None,
    ) -> DataFrame:
        q = queries.select(F.col(query).alias("query_id"), F.col(query_vec).alias("vec"))
        q = q.where("vec is not null")
        schema = T.StructType(
            [
                T.StructField("query_id", q.schema["query_id"].dataType),
                T.StructField("entity_id", self.rows.schema["entity_id"].dataType),
                T.StructField("score", T.DoubleType()),
                T.StructField("rank", T.IntegerType()),
            ]
        )
        if self.shared is not None:
            return _search_broadcast(q, self.shared, k, schema, link)
        sizes = (self.block_rows, min(_JOINED_ROWS, self.most_rows))
        return _search_blocks(q, self.rows, self.count, k, schema, sizes, link)

    def close(self) -> None:
        """Take the sent catalog back from the executors."""
        if self.shared is not None:
            self.shared.unpersist()


def _search_broadcast(
    q: DataFrame, shared: Broadcast[pa.Table], k: int, schema: T.StructType, link: Link | None
) -> DataFrame:
    """Rank each batch of queries against a catalog of checked size."""

    def rank_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities = None
        for batch in batches:
            if batch.num_rows:
                entities = entities or _Entities(shared.value)
                for hits in _block_tiles(pa.Table.from_batches([batch]), entities, k, link):
                    yield from hits.to_batches()

    return q.mapInArrow(rank_batches, schema)


def _packed(rows: DataFrame, block_rows: int) -> DataFrame:
    """(number, packed): the rows of each partition in blocks of ``block_rows``, as Arrow bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                writer.write_table(pa.Table.from_batches(held).combine_chunks())
            held.clear()
            columns = [pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["number", "packed"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block_rows - sum(b.num_rows for b in held)))
                at += held[-1].num_rows
                if sum(b.num_rows for b in held) == block_rows:
                    yield block()
        if held:
            yield block()

    return rows.mapInArrow(pack, "number long, packed binary")


def _search_blocks(
    q: DataFrame,
    e: DataFrame,
    n_e: int,
    k: int,
    schema: T.StructType,
    sizes: tuple[int, int],
    link: Link | None = None,
) -> DataFrame:
    """Rank parts of the queries, each in one task that reads all blocks of about ``sizes[0]`` entities.

    A part has ``sizes[1]`` rows at most, and so many that ``_KEPT`` hits of it are kept. No hits
    are shuffled but where few queries are ranked by several tasks each, and where ids repeat.
    """
    cores = q.sparkSession.sparkContext.defaultParallelism
    block_rows, joined = sizes
    size = q.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids")).first()
    e_blocks = max(-(-n_e // block_rows), 1)
    q_rows = max(1, min(joined, _KEPT // max(1, min(k, n_e))))
    # Few queries are cut finer, up to the cores, and then the catalog is.
    parts = max(-(-size["n"] // q_rows), min(-(-size["n"] // _MIN_BLOCK), cores), 1)
    lanes = min(e_blocks, -(-cores // parts))

    # A task takes several parts one after the other, so that the catalog is copied for tasks only.
    tasks = max(1, min(parts, 2 * cores))

    # Rows are dealt out nearly evenly, not quite: a block may be a little larger.
    left = _packed(e.repartition(e_blocks), block_rows + block_rows // 4)
    right = _packed(q.repartition(parts), q_rows + q_rows // 4)
    dealt = F.shiftright("number", 33)

    def numbers(count: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = left.select(F.pmod(dealt, F.lit(lanes)).alias("lane"), "packed", numbers(tasks).alias("task"))
    right = right.select(F.pmod(dealt, F.lit(tasks)).alias("task"), "packed", numbers(lanes).alias("lane"))
    key = (F.col("task") * lanes + F.col("lane")).alias("key")
    both = left.select(key, F.lit(False).alias("asked"), "packed").union(
        right.select(key, F.lit(True).alias("asked"), "packed")
    )

    def unpacked(packed: bytes) -> pa.Table:
        return pa.ipc.open_stream(packed).read_all()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of entities come first; they wait in a file for each block of queries.
        with tempfile.TemporaryFile() as kept:
            last, sizes = None, []
            for batch in batches:
                cells = zip(batch.column("key").to_pylist(), batch.column("asked").to_pylist(), strict=True)
                for i, (number, asked) in enumerate(cells):
                    packed = batch.column("packed")[i].as_py()
                    if number != last:
                        last, sizes = number, []
                        kept.seek(0)
                        kept.truncate()
                    if not asked:
                        kept.write(packed)
                        sizes.append(len(packed))
                        continue
                    best = _Running(unpacked(packed), k, link)
                    kept.seek(0)
                    for n in sizes:
                        best.add(_Entities(unpacked(kept.read(n))))
                    for hits in best.tables():
                        yield from hits.to_batches()

    both = both.repartitionByRange(tasks * lanes, "key").sortWithinPartitions("key", "asked")
    hits = both.mapInArrow(rank, schema)
    if lanes == 1 and size["n"] == size["ids"]:
        return hits
    return top_k(hits.drop("rank"), k)


def search_one(
    catalog: DataFrame,
    vector: Sequence[float],
    k: int = 10,
    entity: str = "entity_id",
    entity_vec: str = "embedding",
) -> DataFrame:
    """Top-k for one query vector: a scan with a local top-k per task, no shuffle of rows."""
    target = F.array(*[F.lit(float(x)) for x in vector])
    scored = catalog.where(F.col(entity_vec).isNotNull()).select(
        F.col(entity).alias("entity_id"), dot(F.col(entity_vec), target).alias("score")
    )
    return scored.orderBy(F.col("score").desc(), "entity_id").limit(k)


def with_outside_vectors(
    pairs: DataFrame, vectors: DataFrame, encoder: Encoder | None, vec: str = "embedding"
) -> DataFrame:
    """(entity_id, vec) of the catalog and, encoded from their ids, of the other entities.

    An entity outside the catalog is known by its id alone, as in ``candidate_text``.
    Without an encoder it has no vector.
    """
    known = vectors.select("entity_id", F.col(vec).alias("embedding"))
    if encoder is None:
        return known
    outside = pairs.select("entity_id").join(known, "entity_id", "left_anti").distinct()
    texts = outside.select("entity_id", F.col("entity_id").cast("string").alias("text"))
    encoded = encoder(texts, "entity_id", "text").select("entity_id", "embedding")
    return known.select(
        "entity_id", F.col("embedding").cast("array<double>").alias("embedding")
    ).unionByName(encoded.withColumn("embedding", F.col("embedding").cast("array<double>")))


def score_candidates(
    queries: DataFrame,
    catalog: DataFrame,
    candidates: DataFrame,
    query: str = "query_id",
    query_vec: str = "embedding",
    entity: str = "entity_id",
    entity_vec: str = "embedding",
    encoder: Encoder | None = None,
) -> DataFrame:
    """Inner products of given (query, entity) pairs only, by two equi joins.

    Every pair comes out. A candidate outside the catalog is encoded from its id; without
    an ``encoder``, as without a query vector, its score is null.
    """
    q = queries.select(F.col(query).alias("query_id"), F.col(query_vec).alias("_q"))
    pairs = candidates.select(
        F.col(query).alias("query_id"), F.col(entity).alias("entity_id")
    ).distinct()
    known = catalog.withColumnRenamed(entity, "entity_id")
    vectors = with_outside_vectors(pairs, known, encoder, entity_vec)
    joined = pairs.join(vectors, "entity_id", "left").join(q, "query_id", "left")
    return joined.select(
        "query_id", "entity_id", dot(F.col("_q"), F.col("embedding")).alias("score")
    )


def search_candidates(
    queries: DataFrame,
    catalog: DataFrame,
    candidates: DataFrame,
    k: int = 10,
    encoder: Encoder | None = None,
    **columns: str,
) -> DataFrame:
    """Top-k restricted to the given candidates; those without a score come last."""
    return top_k(score_candidates(queries, catalog, candidates, encoder=encoder, **columns), k)


def search_mentions(
    rows: DataFrame,
    vectors: DataFrame,
    catalog: DataFrame,
    k: int = 10,
    mention: str = "mention",
    **columns: str,
) -> DataFrame:
    """Search every distinct mention once; ``vectors`` holds (mention, embedding)."""
    distinct = rows.select(mention).distinct().join(vectors, mention)
    hits = search(distinct, catalog, k, query=mention, **columns)
    return hits.withColumnRenamed("query_id", mention)
