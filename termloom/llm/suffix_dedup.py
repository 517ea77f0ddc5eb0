"""Suffix-array dedup: remove bytes of 50-byte strings that also start in an earlier document.

Texts are kept as blocks in a bucketed table. Of all suffixes only those at window minima are
indexed: every 50-byte window names one of its 20-byte strings, the same wherever the window
stands, so two equal windows always meet under one key.

1. Each block sends the keys of its windows; a key found in one document only needs no more.
2. For shared keys a block sends each different stretch of windows once, with the smallest
   document that has it, so a passage in a third of all documents is one row per block.
3. Stretches meet by key range. In document order, each new batch gets a sorted array of the
   suffixes at its windows, which is merge-scanned against the sorted levels of all earlier
   batches; levels of equal size merge, so their sizes form a geometric series. A match counts
   if all 50 bytes are equal.
4. Each block gets back where an earlier document has its windows, and removes those bytes.

Null text is empty. Null ids come after all others. Rows with one id do not remove each
other's bytes; repeated rows have the same result. An empty table gives an empty one. Columns
not asked for are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.blocks import (
    NO_ID,
    among,
    answers_by_block,
    bucket_of,
    by_bucket,
    scrambled,
    shared_keys,
    stored,
    text_blocks,
    with_answers,
)
from termloom.llm.common import map_arrow, table
from termloom.session import work_path

LENGTH = 50
KEY = 20
WINDOW = LENGTH - KEY + 1  # keys that a window of LENGTH bytes holds
SLICE = 1 << 17  # windows worked on at once
GROUP_KEYS = 1 << 19  # keys that meet in one group; their stretches take some 30 times the bytes
LEVEL_BATCH = 1 << 12  # stretches in a batch
_POSITION = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of the ``width`` bytes at every position, joined from powers of two."""
    count = len(data) - width + 1
    part = data.astype(np.uint64) + np.uint64(1)
    out, done, size, base = None, 0, 1, _BASE
    while True:
        if width & size:
            if out is None:
                out, done = part, size
            else:  # what is there comes behind this part
                out = part[: len(out) - size] * np.uint64(pow(_BASE, done, 1 << 64)) + out[size:]
                done += size
        size *= 2
        if size > width:
            break
        half = size // 2
        part = part[:-half] * np.uint64(base) + part[half:]
        base = base * base % (1 << 64)
    return out[:count]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first and last window of each run of windows that name the same key.

    ``ends`` are the ends of the documents in ``data``; windows stay inside a document.
    """
    keys, firsts, lasts = [], [], []
    total = len(data) - LENGTH + 1
    for begin in range(0, max(total, 0), SLICE):
        stop = min(begin + SLICE, total)
        marks = rolling(data[begin : stop + LENGTH - 1], KEY)
        packed = scrambled(marks) & ~_POSITION
        packed |= np.arange(len(packed), dtype=np.uint64)
        named = (sliding_min(packed, WINDOW) & _POSITION).astype(np.int64)
        inside = np.ones(stop - begin, bool)
        near = ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, stop + LENGTH)]
        crossing = (near[:, None] - np.arange(1, LENGTH)).ravel() - begin
        inside[crossing[(crossing >= 0) & (crossing < stop - begin)]] = False
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        named = named[at]
        new = np.flatnonzero((named[1:] != named[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        start = np.concatenate([[0], new])
        keys.append(marks[named[start]])
        firsts.append(at[start] + begin)
        lasts.append(at[np.concatenate([new, [len(at)]]) - 1] + begin)
    if not keys:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(lasts)


class Block:
    """Documents of one row of the block table and the runs of their windows."""

    def __init__(self, lengths: bytes, ids: bytes, body: bytes):
        self.lengths = np.frombuffer(lengths, np.int64)
        self.ids = np.frombuffer(ids, np.int64)
        self.ends = np.cumsum(self.lengths)
        text = zstandard.ZstdDecompressor().decompress(body, int(self.lengths.sum()))
        self.text = text
        self.data = np.frombuffer(text, np.uint8)
        # Ends of empty documents repeat their neighbour's.
        self.keys, self.first, self.last = window_runs(self.data, self.ends)
        self.document = np.searchsorted(self.ends, self.first, "right")

    def local(self) -> np.ndarray:
        """Keys found in two or more ids of this block, sorted."""
        owner = self.ids[self.document]
        order = np.lexsort((owner, self.keys))
        keys, owner = self.keys[order], owner[order]
        return np.unique(keys[1:][(keys[1:] == keys[:-1]) & (owner[1:] != owner[:-1])])

    def stretches(self, shared: np.ndarray):
        """Runs under shared keys, and the different (key, bytes) they come to.

        Returns the run numbers, the stretch number of each, and for each stretch its key,
        its bytes and its smallest id.
        """
        runs = np.flatnonzero(among(self.keys, np.unique(shared)))
        numbers: dict[tuple[int, bytes], int] = {}
        text = self.text
        of = np.fromiter(
            (
                numbers.setdefault((key, text[a : b + LENGTH]), len(numbers))
                for key, a, b in zip(
                    self.keys[runs].tolist(),
                    self.first[runs].tolist(),
                    self.last[runs].tolist(),
                    strict=True,
                )
            ),
            np.int64,
            len(runs),
        )
        least = np.full(len(numbers), NO_ID)
        np.minimum.at(least, of, self.ids[self.document[runs]])
        keys = np.array([k for k, _ in numbers], np.uint64)
        return runs, of, keys, [text for _, text in numbers], least


def _keys(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(*[batch.column(c)[row].as_py() for c in ("lengths", "ids", "body")])
                keys = np.unique(block.keys)
                parts = list(by_bucket(bucket_of(keys, buckets)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([b for b, _ in parts], pa.int64()),
                        "block": pa.array(
                            [batch.column("block")[row].as_py()] * len(parts), pa.int64()
                        ),
                        "keys": pa.array([keys[part].tobytes() for _, part in parts], pa.binary()),
                    }
                )

    return map_arrow(
        blocks.select("block", "lengths", "ids", "body"),
        run,
        "bucket long, block long, keys binary",
    )


def _shared_of(answers: list[bytes] | None, block: Block) -> np.ndarray:
    return np.concatenate(
        [*[np.frombuffer(a, np.uint64) for a in answers or []], block.local()]
    )


def _stretches(joined: DataFrame, buckets: int) -> DataFrame:
    """One row per block and bucket: its different stretches with their smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(*[batch.column(c)[row].as_py() for c in ("lengths", "ids", "body")])
                shared = _shared_of(batch.column("answers")[row].as_py(), block)
                _, _, keys, parts, least = block.stretches(shared)
                out: dict[str, list] = {
                    n: [] for n in ("bucket", "block", "numbers", "least", "lengths", "body")
                }
                for bucket, part in by_bucket(bucket_of(keys, buckets)):
                    chosen = [parts[i] for i in part.tolist()]
                    out["bucket"].append(bucket)
                    out["block"].append(batch.column("block")[row].as_py())
                    out["numbers"].append(part.astype(np.int64).tobytes())
                    out["least"].append(least[part].tobytes())
                    out["lengths"].append(np.array([len(c) for c in chosen], np.int64).tobytes())
                    out["body"].append(b"".join(chosen))
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)],
                    names=list(out),
                )

    schema = (
        "bucket long, block long, numbers binary, least binary, lengths binary, body binary"
    )
    return map_arrow(joined, run, schema)


class Levels:
    """Logarithmic family of sorted suffix arrays over windows, each with its first id.

    Windows are ordered by the fingerprint of their bytes, as only matches over the whole
    length count; the bytes of a match are compared.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), bool)
        span = np.arange(LENGTH)
        for i in range(0, len(a), 1 << 16):
            x = self.data[a[i : i + (1 << 16), None] + span]
            y = self.data[b[i : i + (1 << 16), None] + span]
            same[i : i + (1 << 16)] = (x == y).all(1)
        return same

    def add(self, marks: np.ndarray, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """First id of each window among all windows added up to now; ids never go down."""
        first = ids.copy()
        known = np.zeros(len(marks), bool)
        for level_marks, level_places, level_ids in self.levels:
            at = np.minimum(np.searchsorted(level_marks, marks), len(level_marks) - 1)
            hit = np.flatnonzero(level_marks[at] == marks)
            hit = hit[self._same(places[hit], level_places[at[hit]])]
            first[hit] = level_ids[at[hit]]
            known[hit] = True
        new = np.flatnonzero(~known)
        order = new[np.argsort(marks[new], kind="stable")]  # equal marks stay in id order
        sorted_marks = marks[order]
        starts = np.flatnonzero(
            np.concatenate([[True], sorted_marks[1:] != sorted_marks[:-1]])[: len(order)]
        )
        head = np.repeat(order[starts], np.diff(np.concatenate([starts, [len(order)]])))
        same = self._same(places[order], places[head])
        first[order[same]] = ids[head[same]]
        if not same.all():  # one fingerprint, different bytes
            by_bytes: dict[bytes, int] = {}
            for i in order[~same].tolist():
                window = self.data[places[i] : places[i] + LENGTH].tobytes()
                first[i] = by_bytes.setdefault(window, int(ids[i]))
        heads = order[starts]
        self._push(marks[heads], places[heads], ids[heads])
        return first

    def _push(self, marks: np.ndarray, places: np.ndarray, ids: np.ndarray) -> None:
        level = (marks, places, ids)
        while self.levels and len(self.levels[-1][0]) <= len(level[0]):
            last = self.levels.pop()
            merged = [np.concatenate(pair) for pair in zip(last, level, strict=True)]
            order = np.argsort(merged[0], kind="stable")
            level = tuple(column[order] for column in merged)
        if len(level[0]):
            self.levels.append(level)


def _resolve(group: pa.Table) -> pa.Table:
    """Where an id below its own smallest has windows of a stretch, as (number, from, to, id)."""
    rows = [
        [np.frombuffer(group.column(c)[i].as_py(), np.int64) for c in ("numbers", "least", "lengths")]
        for i in range(group.num_rows)
    ]
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    number, least, length = (np.concatenate([r[i] for r in rows]) for i in range(3))
    data = np.frombuffer(b"".join(v.as_py() for v in group.column("body")), np.uint8)
    begin = np.cumsum(length) - length
    marks = np.empty(max(len(data) - LENGTH + 1, 0), np.uint64)
    for at in range(0, len(marks), SLICE):  # of all at once, the steps would take most memory
        stop = min(at + SLICE, len(marks))
        marks[at:stop] = rolling(data[at : stop + LENGTH - 1], LENGTH)
    order = np.lexsort((number, row, least))
    levels = Levels(data)
    answers: list[list[np.ndarray]] = [[] for _ in rows]
    for at in range(0, len(order), LEVEL_BATCH):
        part = order[at : at + LEVEL_BATCH]
        count = length[part] - LENGTH + 1
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(begin[part], count) + inner
        owner = np.repeat(np.arange(len(part)), count)
        first = levels.add(marks[place], place, least[part][owner])
        # Neighbouring windows with the same first id are one answer.
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (first[1:] != first[:-1])) + 1
        start = np.concatenate([[0], cut])
        stop = np.concatenate([cut, [len(first)]]) - 1
        earlier = first[start] < least[part][owner[start]]
        start, stop = start[earlier], stop[earlier]
        found = np.stack(
            [number[part[owner[start]]], inner[start], inner[stop], first[start]], 1
        ).astype(np.int64)
        of = row[part[owner[start]]]
        for i, chosen in by_bucket(of):
            answers[i].append(found[chosen])
    blobs = [np.concatenate(a).tobytes() if a else b"" for a in answers]
    return pa.table(
        {
            "block": group.column("block").combine_chunks(),
            "found": pa.array(blobs, pa.binary()),
        }
    )


def _removed(block: Block, answers: list[bytes] | None, found: list[bytes] | None) -> np.ndarray:
    """Mask of the bytes of the block to remove."""
    shared = _shared_of(answers, block)
    runs, of, _, _, least = block.stretches(shared)
    ids = block.ids[block.document[runs]]
    first, last = block.first[runs], block.last[runs]
    own = np.flatnonzero(ids > least[of])  # another document of this block has it all
    starts, stops = [first[own]], [last[own]]
    if found:
        rows = np.concatenate([np.frombuffer(f, np.int64).reshape(-1, 4) for f in found])
        # Every run of a stretch with an answer: an earlier document is earlier for all of them.
        order = np.argsort(of, kind="stable")
        low = np.searchsorted(of[order], rows[:, 0])
        many = np.searchsorted(of[order], rows[:, 0], "right") - low
        answer = np.repeat(np.arange(len(rows)), many)
        run = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        starts.append(first[run] + rows[answer, 1])
        stops.append(first[run] + rows[answer, 2])
    edge = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(edge, np.concatenate(starts), 1)
    np.subtract.at(edge, np.concatenate(stops) + LENGTH, 1)
    return np.cumsum(edge[:-1]) > 0


def _results(joined: DataFrame, rest_schema: str, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                block = Block(value["lengths"], value["ids"], value["body"])
                gone = _removed(block, value["answers"], value["found"])
                begins = block.ends - block.lengths
                rising = gone.copy()
                rising[1:] &= ~gone[:-1]
                inner = begins[(begins > 0) & (begins < len(gone))]
                rising[inner] = gone[inner]
                counts = np.concatenate([[0], np.cumsum(gone)])
                spans = np.concatenate([[0], np.cumsum(rising)])
                kept_at = np.arange(len(gone) + 1) - counts
                kept = block.data[~gone].tobytes()
                texts = [
                    kept[a:b]
                    for a, b in zip(
                        kept_at[begins].tolist(), kept_at[block.ends].tolist(), strict=True
                    )
                ]
                raw = zstandard.ZstdDecompressor().decompress(value["rest"])
                rest = pa.ipc.open_stream(raw).read_all().combine_chunks()
                columns = [
                    *[c.combine_chunks() for c in rest.columns],
                    pa.array(block.lengths),
                    pa.array(counts[block.ends] - counts[begins]),
                    pa.array(spans[block.ends] - spans[begins]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                ]
                names = [*rest.schema.names, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([t.decode("utf-8", "ignore") for t in texts]))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{rest_schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_arrow(joined, run, schema + (", kept_text string" if with_text else ""))


def dedup(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    extra: Sequence[str] = (),
    with_text: bool = False,
    block_bytes: int | None = None,
    group_keys: int = GROUP_KEYS,
) -> DataFrame:
    """Id, ``extra`` columns, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    ``with_text`` adds ``kept_text``: the remaining bytes without code points cut in two. A task
    works on one block of ``block_bytes`` or on one group of ``group_keys`` keys at a time.
    """
    spark = df.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rest = [f"id {kinds[id_column]}", *[f"x{i} {kinds[n]}" for i, n in enumerate(extra)]]
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks, _ = stored(text_blocks(df, id_column, text_column, extra, block_bytes), least)
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, math.ceil(size * 2 / (WINDOW + 1) / group_keys), min(least, size >> 22))

    shared = _keys(blocks, buckets).groupBy("bucket").applyInArrow(
        shared_keys, "block long, keys binary"
    )
    path = work_path(spark, "shared")
    answers_by_block(shared, "keys").write.parquet(path)
    answers = spark.read.schema("block long, answers array<binary>").parquet(path)
    joined = with_answers(blocks.select("block", "lengths", "ids", "body"), answers)
    found = _stretches(joined, buckets).groupBy("bucket").applyInArrow(
        _resolve, "block long, found binary"
    )
    replies = answers_by_block(found, "found").withColumnRenamed("answers", "found")
    final = with_answers(blocks, answers).join(replies.hint("shuffle_hash"), "block", "left")
    out = _results(final.drop("n_bytes"), ", ".join(rest), with_text)
    names = dict(zip([f"x{i}" for i in range(len(extra))], extra, strict=True)) | {"id": id_column}
    return out.withColumnsRenamed(names)


def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(table(spark, sf, "documents"))
