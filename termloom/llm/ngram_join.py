"""N-gram Jaccard join: adaptive multi-match prefixes, and the components of its links.

If two sets of sizes n and m overlap in ``need(n)`` and ``need(m)`` tokens or more, then in any
common order of tokens their first ``n - need(n) + k`` and ``m - need(m) + k`` tokens share at
least k. A prefix may thus be lengthened for as many more shared tokens before a pair is
looked at.

1. Blocks of documents send the tokens of their prefixes in hash order, lengthened by a
   share of the set; a document whose prefix shares too few tokens with any other has no
   link. Sets that are equal become one.
2. The sets left get the number of sets that hold each token. In order of rarity each
   chooses how far to lengthen its prefix, by the estimated cost of its candidates.
3. Within the sets that share a prefix token, each is first compared with one of them only,
   and sets that turn out to be linked are one component. Then every pair of sets that is
   still in different components and shares enough prefix tokens is compared. Links inside a
   component need not be found, so copies in thousands cost one comparison each.

Tokens are 64-bit hashes of shingles of ``WIDTH`` words. Null or empty text has the empty set
and no link; a text with fewer words is one shingle. Repeated rows are equal sets. A null id is
never the smallest id of a component with others. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.blocks import (
    NO_ID,
    among,
    answers_by_block,
    bucket_of,
    by_bucket,
    drop_stored,
    scrambled,
    shared_keys,
    stored,
    text_blocks,
    with_answers,
)
from termloom.llm.common import map_arrow, table, texts
from termloom.llm.components import contract
from termloom.session import pinned

WIDTH = 5
PERCENT = 75
GROUP_TOKENS = 3 << 20  # tokens that meet in one task
BLOCK_TOKENS = 1 << 19  # tokens in a block of sets
BROADCAST_IDS = 1_000_000
LENGTHEN_PERCENT = 15  # first prefix: so much of the set beyond the shortest one
LENGTHENINGS = (1, 2, 3, 4)  # shared tokens that a set may ask for in the second
PAIR_COST = 0.01  # comparing a token of a pair, in rows of a prefix token
COMPARED = 4  # sets that a set is compared with in a later round
ROUNDS = 4  # comparisons with one other set before all pairs left are compared
EARLY = 48  # tokens before a shared one that are looked through for another shared one
_MIX = np.array(
    [
        0x9E3779B97F4A7C15,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0xD6E8FEB86659FD93,
        0xA0761D6478BD642F,
    ],
    np.uint64,
)


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    words = text.lower().split()  # of bytes, so A-Z only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, WIDTH)
    total = hashes[: n - width + 1] * _MIX[0]
    for i in range(1, width):
        total = total + hashes[i : n - width + 1 + i] * _MIX[i]
    return np.unique(scrambled(total + np.uint64(width)))


def need(n):
    """Tokens that a set of n must share with any set it links to."""
    return (PERCENT * n + 99) // 100


def lengthening(n):
    """Shared tokens asked for in the first prefix."""
    return np.maximum(1, n * LENGTHEN_PERCENT // 100)


def first_prefix(tokens: np.ndarray) -> np.ndarray:
    n = len(tokens)
    return tokens[: n - need(n) + int(lengthening(n))] if n else tokens


def _group_by_bytes(offsets: np.ndarray, blob: bytes):
    view = memoryview(blob)
    return [view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _block_sets(value: dict) -> list[np.ndarray]:
    lengths = np.frombuffer(value["lengths"], np.int64)
    body = zstandard.ZstdDecompressor().decompress(value["body"], int(lengths.sum()))
    edges = np.concatenate([[0], np.cumsum(lengths)])
    return [shingles(bytes(part)) for part in _group_by_bytes(edges, body)]


def _first_keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """The different first-prefix tokens of each block, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.to_pylist():
                sets = _block_sets(value)
                keys = np.unique(np.concatenate([first_prefix(s) for s in sets]))
                parts = list(by_bucket(bucket_of(keys, buckets)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([b for b, _ in parts], pa.int64()),
                        "block": pa.array([value["block"]] * len(parts), pa.int64()),
                        "keys": pa.array([keys[p].tobytes() for _, p in parts], pa.binary()),
                    }
                )

    return map_arrow(
        blocks.select("block", "lengths", "body"), run, "bucket long, block long, keys binary"
    )


def _candidate_sets(joined: DataFrame) -> DataFrame:
    """Every document with its set's size and digest; the set itself where it may have a link.

    Of equal sets in a block, the one with the smallest id carries the set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.to_pylist():
                ids = np.frombuffer(value["ids"], np.int64)
                sets = _block_sets(value)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                least: dict[bytes, int] = {}
                for i in sorted(range(len(sets)), key=lambda i: ids[i]):
                    least.setdefault(digests[i], i)
                chosen = sorted(least.values())
                prefixes = [first_prefix(sets[i]) for i in chosen]
                keys = np.concatenate([np.zeros(0, np.uint64), *prefixes])
                owner = np.repeat(np.arange(len(chosen)), [len(p) for p in prefixes])
                ordered = np.sort(keys)
                outside = [np.frombuffer(a, np.uint64) for a in value["answers"] or []]
                shared = np.unique(
                    np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *outside])
                )
                hits = np.bincount(owner[among(keys, shared)], minlength=len(chosen))
                blobs: list[bytes | None] = [None] * len(sets)
                for at, i in enumerate(chosen):
                    n = len(sets[i])
                    # The other set may be smaller and ask for fewer.
                    if n and hits[at] >= lengthening(need(n)):
                        blobs[i] = sets[i].tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(ids),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array(digests, pa.binary()),
                        "tokens": pa.array(blobs, pa.binary()),
                    }
                )

    return map_arrow(
        joined, run, "id long, n long, digest binary, tokens binary"
    )


def _set_blocks(nodes: DataFrame) -> DataFrame:
    """Rows of about BLOCK_TOKENS tokens: nodes, sizes, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[int, bytes]] = []
        size = 0

        def row():
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "n_tokens": pa.array([size // 8], pa.int64()),
                    "ids": [np.array([h[0] for h in held], np.int64).tobytes()],
                    "lengths": [np.array([len(h[1]) // 8 for h in held], np.int64).tobytes()],
                    "body": [b"".join(h[1] for h in held)],
                }
            )

        for batch in batches:
            for node, tokens in zip(
                batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), strict=True
            ):
                held.append((node, tokens))
                size += len(tokens)
                if size >= 8 * BLOCK_TOKENS:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return map_arrow(
        nodes.select("node", "tokens"),
        run,
        "block long, n_tokens long, ids binary, lengths binary, body binary",
    )


def _token_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """The different tokens of each block and how many of its sets hold them, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.to_pylist():
                keys, counts = np.unique(
                    np.frombuffer(value["body"], np.uint64), return_counts=True
                )
                counts = counts.astype(np.uint32)
                parts = list(by_bucket(bucket_of(keys, buckets)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([b for b, _ in parts], pa.int64()),
                        "block": pa.array([value["block"]] * len(parts), pa.int64()),
                        "keys": pa.array([keys[p].tobytes() for _, p in parts], pa.binary()),
                        "counts": pa.array([counts[p].tobytes() for _, p in parts], pa.binary()),
                    }
                )

    return map_arrow(
        blocks.select("block", "body"),
        run,
        "bucket long, block long, keys binary, counts binary",
    )


def _total_counts(group: pa.Table) -> pa.Table:
    """For each block, its tokens held by two sets or more anywhere, and by how many."""
    blobs = [np.frombuffer(v.as_py(), np.uint64) for v in group.column("keys")]
    counts = [np.frombuffer(v.as_py(), np.uint32) for v in group.column("counts")]
    keys, back = np.unique(np.concatenate(blobs), return_inverse=True)
    totals = np.bincount(back, np.concatenate(counts).astype(np.float64)).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    found = []
    for i, blob in enumerate(blobs):
        total = totals[back[at[i] : at[i + 1]]]
        many = total > 1
        found.append(np.stack([blob[many], total[many]]).tobytes())
    return pa.table(
        {"block": group.column("block").combine_chunks(), "found": pa.array(found, pa.binary())}
    )


def choose_prefix(n: int, counts: np.ndarray) -> tuple[int, int]:
    """How many of the shared tokens in order of rarity to take, and how many must match.

    ``counts`` are the ascending numbers of sets that hold each shared token. A prefix
    lengthened by k - 1 costs its rows. Its candidates are about as many as hold one of its
    tokens, less by k, and each costs the comparison of n tokens.
    """
    alone = n - len(counts)
    rows = np.concatenate([[0], np.cumsum(counts)])
    best = None
    for k in LENGTHENINGS:
        if k > need(n):
            break
        take = n - need(n) + k - alone
        if take <= 0:
            return 0, k
        cost = rows[take] * (1 + PAIR_COST * n / (k * take))
        if best is None or cost < best[0]:
            best = (cost, take, k)
    return best[1], best[2]


def _prefix_rows(joined: DataFrame) -> DataFrame:
    """The chosen prefix of each set, a row per token.

    ``at`` is the token's place in the set's order of rarity, which begins with the
    ``alone`` tokens that no other set holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.to_pylist():
                found = [np.frombuffer(f, np.uint64).reshape(2, -1) for f in value["answers"] or []]
                if not found:
                    continue
                keys, totals = np.concatenate(found, axis=1)
                order = np.argsort(keys)
                keys, totals = keys[order], totals[order].astype(np.int64)
                ids = np.frombuffer(value["ids"], np.int64)
                lengths = np.frombuffer(value["lengths"], np.int64)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                body = np.frombuffer(value["body"], np.uint64)
                columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for i, node in enumerate(ids.tolist()):
                    tokens = body[edges[i] : edges[i + 1]]
                    n = len(tokens)
                    shared = tokens[among(tokens, keys)]
                    if len(shared) < need(n):
                        continue
                    count = totals[np.searchsorted(keys, shared)]
                    rare = np.lexsort((shared, count))
                    take, k = choose_prefix(n, count[rare])
                    part = shared[rare[:take]]
                    alone = n - len(shared)
                    same = [[v] * take for v in (node, n, k, alone)]
                    cells_of = (part.view(np.int64), *same, alone + np.arange(take))
                    for column, cells in zip(columns, cells_of, strict=True):
                        column.append(np.asarray(cells, np.int64))
                if columns[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in columns],
                        names=["token", "node", "n", "k", "alone", "at"],
                    )

    return map_arrow(
        joined.select("block", "ids", "lengths", "body", "answers"),
        run,
        "token long, node long, n long, k long, alone long, at long",
    )


def _may_link(a: str, b: str) -> Column:
    """Whether sets of which a shared token is given can be linked, and this row tells it.

    A linked pair shares ``needed`` tokens, so k of them are among the first n - needed + k
    of each set. Up to the given token both can share what is not alone in either, behind
    it what is left of the shorter rest.
    """
    n, m, at, bt = (F.col(c) for c in (f"n{a}", f"n{b}", f"at{a}", f"at{b}"))
    k = F.least(f"k{a}", f"k{b}")
    needed = F.ceil((n + m) * PERCENT / (100 + PERCENT))
    up_to = F.least(at - F.col(f"alone{a}"), bt - F.col(f"alone{b}")) + 1
    behind = F.least(n - at, m - bt) - 1
    return (
        (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))
        & (at < n - needed + k)
        & (bt < m - needed + k)
        & (up_to + behind >= needed)
    )


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose sets are similar enough."""
    left = nodes.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            similar = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a = np.frombuffer(x.as_py(), np.uint64)
                b = np.frombuffer(y.as_py(), np.uint64)
                common = int(among(a, b).sum())
                similar.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield batch.drop_columns(["x", "y"]).filter(pa.array(similar))

    joined = pairs.join(left, "a").join(right, "b").select(*pairs.columns, "x", "y")
    return map_arrow(joined, run, ", ".join(columns))


def _components(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node of the component of every node that has a link, as (v, p)."""
    here = rows.withColumn("part", F.col("node"))
    labels = None
    carried = ("node", "part", "n", "k", "alone", "at")
    for number in range(ROUNDS):
        # One set for all tokens first; then one for each token, which also finds near relatives.
        by = [F.col("node"), F.lit(number), *([F.col("token")] if number else [])]
        drawn = F.struct(F.xxhash64(*by).alias("h"), *carried)
        hubs = (
            here.groupBy("token")
            .agg(F.min(drawn).alias("hub"), F.min("part").alias("low"), F.max("part").alias("high"))
            .where(F.col("low") < F.col("high"))
            .select("token", "hub.*")
            .select("token", *[F.col(c).alias(f"{c}_hub") for c in carried])
        )
        met = here.withColumnsRenamed({c: f"{c}_own" for c in carried}).join(hubs, "token")
        met = met.where((F.col("part_own") != F.col("part_hub")) & _may_link("_own", "_hub"))
        counted = met.groupBy("node_own", "part_own", "node_hub", "part_hub").count()
        met_by = F.sort_array(F.collect_list(F.struct("count", "node_hub", "part_hub")), False)
        best = counted.groupBy("node_own", "part_own").agg(
            F.slice(met_by, 1, COMPARED if number else 1).alias("all")
        )
        pairs = best.select("*", F.explode("all").alias("best")).select(
            F.col("node_own").alias("a"),
            F.col("best.node_hub").alias("b"),
            F.col("part_own").alias("pa"),
            F.col("best.part_hub").alias("pb"),
        )
        links = pinned(_linked(pairs, nodes), "links")
        merged = contract(links.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
        if merged.isEmpty():
            break
        labels = _joined_labels(labels, merged)
        here = pinned(_relabelled(here, merged), "prefixes")
    # Tokens whose sets are all in one component are done.
    mixed = (
        here.groupBy("token")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"))
        .where(F.col("low") < F.col("high"))
        .select("token")
    )
    pairs = _pairs_left(here.join(mixed, "token"))
    links = pinned(_linked(pairs, nodes), "links")
    merged = contract(links.select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    return merged if labels is None else _joined_labels(labels, merged)


def _pairs_left(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different parts (pa, pb) that share enough prefix tokens.

    Tokens are in one order in all prefixes. A pair is taken where it shares its first token, if
    that is among the EARLY first ones of both, so a pair is one row and not one for each shared
    token; only then are its prefixes met and all shared tokens counted.
    """
    facts = ("n", "k", "alone", "part")
    prefix = F.sort_array(F.collect_list(F.struct("at", "token"))).alias("prefix")
    # One document's prefix at most.
    lists = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in facts], prefix)
    lists = pinned(lists, "unresolved")
    placed = lists.select("node", *facts, "prefix", F.posexplode("prefix").alias("i", "c"))
    early = F.slice(F.col("prefix.token"), 1, F.least("i", F.lit(EARLY)))
    left = placed.select("node", *facts, "c.at", "c.token", early.alias("early"))
    left = pinned(left, "tokens")
    carried = ("node", *facts, "at", "early")
    x = left.withColumnsRenamed({c: f"{c}_a" for c in carried})
    y = left.withColumnsRenamed({c: f"{c}_b" for c in carried})
    met = x.join(y, "token").where(
        (F.col("part_a") < F.col("part_b"))
        & _may_link("_a", "_b")
        & ~F.arrays_overlap("early_a", "early_b")
    )
    once = met.select("node_a", "node_b").distinct()
    for side in ("_a", "_b"):
        own = lists.withColumnsRenamed({c: f"{c}{side}" for c in ("node", *facts, "prefix")})
        once = once.join(own, f"node{side}")
    k = F.least("k_a", "k_b")
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * PERCENT / (100 + PERCENT))

    def inside(side: str) -> Column:
        stop = F.col(f"n{side}") - needed + k
        cells = F.filter(f"prefix{side}", lambda c: c["at"] < stop)
        return F.transform(cells, lambda c: c["token"])

    shared = F.size(F.array_intersect(inside("_a"), inside("_b")))
    return once.where(shared >= k).select(
        F.col("node_a").alias("a"),
        F.col("node_b").alias("b"),
        F.col("part_a").alias("pa"),
        F.col("part_b").alias("pb"),
    )


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    new = labels.select(F.col("v").alias("part"), F.col("p").alias("_new"))
    return rows.join(new, "part", "left").select(
        *[c for c in rows.columns if c != "part"], F.coalesce("_new", "part").alias("part")
    )


def _joined_labels(labels: DataFrame | None, merged: DataFrame) -> DataFrame:
    """Labels of nodes after parts were merged into others."""
    if labels is None:
        return merged
    moved = _relabelled(labels.select("v", F.col("p").alias("part")), merged)
    fresh = merged.join(labels.select("v"), "v", "left_anti")
    return pinned(moved.select("v", F.col("part").alias("p")).unionByName(fresh), "labels")


def join_components(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Id, ``n_shingles`` and ``component_id`` of every row."""
    return _joined(df, id_column, text_column).drop("node", "root")


def _joined(
    df: DataFrame, id_column: str, text_column: str, block_bytes: int | None = None
) -> DataFrame:
    """What ``join_components`` gives, with the ``node`` of every row's set and its ``root``."""
    spark = df.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks, name = stored(text_blocks(df, id_column, text_column, (), block_bytes), least)
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, math.ceil(size / 16 / GROUP_TOKENS), min(least, size >> 22))
    shared = _first_keys(blocks, buckets).groupBy("bucket").applyInArrow(
        shared_keys, "block long, keys binary"
    )
    joined = with_answers(
        blocks.select("block", "ids", "lengths", "body"), answers_by_block(shared, "keys")
    )
    sets = pinned(_candidate_sets(joined).withColumn("node", F.xxhash64("digest")), "sets")
    drop_stored(spark, name)

    # Sets that are equal are one node, named by their digest.
    held = sets.where(F.col("tokens").isNotNull())
    nodes, _ = stored(
        held.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")),
        least,
        "node",
    )
    node_blocks, name = stored(_set_blocks(nodes), least)
    total = node_blocks.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, math.ceil(total / GROUP_TOKENS), min(least, total >> 17))
    counted = _token_counts(node_blocks, groups).groupBy("bucket").applyInArrow(
        _total_counts, "block long, found binary"
    )
    rows = _prefix_rows(with_answers(node_blocks, answers_by_block(counted, "found")))
    rows = pinned(rows, "prefixes")
    drop_stored(spark, name)
    labels = _components(rows, nodes.select("node", "tokens"))

    classes = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = classes.join(labels.withColumnRenamed("v", "node"), "node", "left").select(
        "node", "least", F.coalesce("p", "node").alias("root")
    )
    named = pinned(named, "classes")
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(smallest, "root").select("node", "component", "root")
    out = sets.select("id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    kind = df.schema[id_column].dataType
    return out.select(
        _restored(F.col("id")).cast(kind).alias(id_column),
        F.col("n").alias("n_shingles"),
        _restored(component).cast(kind).alias("component_id"),
        "node",
        "root",
    )


def _with_nodes(df: DataFrame, text_column: str) -> DataFrame:
    """Every row of ``df`` as ``row``, with the ``digest`` of its text's set."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text_column].alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in texts(batch.column("text"))]
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(digests, pa.binary())], names=["row", "text", "digest"]
            )

    return map_arrow(rows, run, f"row {kind}, text string, digest binary")


def one_of_each(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_bytes: int | None = None,
) -> DataFrame:
    """One row of ``df`` for each component: that of the smallest id.

    Only the ids to drop are joined. They are sent to the tasks if they are few, and joined
    by key otherwise. Rows with a null id are no copies of each other and stay. Where an id is
    there more than once, its rows are told apart by their sets of shingles: of a component's rows
    of the smallest id the smallest set is kept, of equal sets the smallest text. Rows without
    words are one for each id.
    """
    found = pinned(_joined(df, id_column, text_column, block_bytes), "components")
    drop = found.where(F.col(id_column) != F.col("component_id")).select(id_column).distinct()
    repeated = found.groupBy(id_column).count().where("count > 1").select(id_column)
    repeated = pinned(repeated.where(F.col(id_column).isNotNull()), "repeated")
    if repeated.isEmpty():
        kept = df.join(_few(pinned(drop, "copies")), id_column, "left_anti")
        return kept.select(*df.columns)
    few = _few(repeated)
    # A repeated id may be dropped for one of its texts only.
    drop = pinned(drop.join(few, id_column, "left_anti"), "copies")
    once = df.join(_few(drop), id_column, "left_anti").join(few, id_column, "left_anti")
    # The sets to keep. An id that is there once is the smallest of its component here too.
    first = found.where(F.col("root").isNull() | (F.col(id_column) == F.col("component_id")))
    group = F.when(F.col("root").isNull(), F.col(id_column).cast("long")).otherwise(F.col("root"))
    chosen = (
        first.join(few, id_column, "left_semi")
        .groupBy(F.col("root").isNull().alias("_empty"), group.alias("_group"))
        .agg(F.min("node").alias("_node"), F.min(id_column).alias("_id"))
        .select("_id", "_node")
    )
    again = _with_nodes(df.join(few, id_column, "left_semi").select(*df.columns), text_column)
    again = again.withColumn("node", F.xxhash64("digest"))
    again = again.join(
        pinned(chosen, "chosen"),
        (F.col("row")[id_column] == F.col("_id")) & (F.col("node") == F.col("_node")),
    )
    rest = [F.col("row")[c].cast("string") for c in df.columns]
    again = again.groupBy("_id", "_node").agg(
        F.min_by("row", F.struct("text", F.xxhash64(*rest))).alias("row")
    )
    return once.select(*df.columns).unionByName(
        again.select(*[F.col("row")[c].alias(c) for c in df.columns])
    )


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _restored(value: Column) -> Column:
    return F.when(value != F.lit(int(NO_ID)), value)


def op7_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return join_components(table(spark, sf, "documents"))
