"""Packing: token streams cut into sequences by an order-preserving dynamic program.

Documents keep their order. A sequence may end behind a document, behind a sentence, or, in a
long sentence, at steps; the cuts chosen are those with the least sum of padding and of
penalties for cutting a document. The best start of a sequence is the minimum of a sliding
window, kept in a monotone queue; sequences whose length is a power of two need no padding,
only a share of it is counted for leaving room, and are looked up at their exact lengths.

Null text is empty: such a document is its end id alone. Repeated rows are packed each. Other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from termloom.llm import words as W
from termloom.llm.common import map_arrow, slices_by_bytes, table

GROUP_BYTES = 4 << 20  # documents whose cuts are chosen together
SEQUENCE = 2048
END_ID = 1
STEP = 32  # a longer sentence may be cut after every so many ids
# In tokens of padding: a further sequence, a cut behind a sentence, a cut inside one.
SEQUENCE_COST = 4.0
SENTENCE_PENALTY = 8.0
INNER_PENALTY = 24.0
LEAST_POWER = 256  # shorter sequences are not looked up
ROOM_SHARE = 0.25  # of the room that a sequence at a power of two leaves
_SEQUENCE_BITS = 33


def candidates(
    ends: np.ndarray, sentences: np.ndarray, most: int = SEQUENCE
) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, ascending from 0, and their penalties.

    ``ends`` are the ends of documents, ``sentences`` those of sentences. A stretch longer
    than STEP (or ``most``) gets a cut after every STEP ids.
    """
    inner = np.setdiff1d(sentences, ends)
    position = np.concatenate([[0], ends, inner]).astype(np.int64)
    penalty = np.concatenate([np.zeros(len(ends) + 1), np.full(len(inner), SENTENCE_PENALTY)])
    order = np.argsort(position, kind="stable")
    position, penalty = position[order], penalty[order]
    gaps = np.diff(position)
    step = min(STEP, most)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        many = (gaps[wide] - 1) // step
        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        extra = np.repeat(position[wide], many) + (number + 1) * step
        position = np.concatenate([position, extra])
        penalty = np.concatenate([penalty, np.full(len(extra), INNER_PENALTY)])
        order = np.argsort(position, kind="stable")
        position, penalty = position[order], penalty[order]
    return position, penalty


def choose_cuts(position: np.ndarray, penalty: np.ndarray, most: int = SEQUENCE) -> np.ndarray:
    """Ends of the sequences with the least cost, among the candidates, from 0 to the last."""
    n = len(position)
    exact: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    length = min(LEAST_POWER, most)
    while length <= most:
        at = np.searchsorted(position, position - length)
        found = position[np.minimum(at, n - 1)] == position - length
        room = np.full(int(found.sum()), (most - length) * ROOM_SHARE)
        exact.append((np.flatnonzero(found), at[found], room))
        length *= 2
    to, start, room = (np.concatenate(column) for column in zip(*exact, strict=True))
    order = np.argsort(to, kind="stable")
    starts = start[order].tolist()
    rooms = room[order].tolist()
    first = np.searchsorted(to[order], np.arange(n + 1)).tolist()

    places = position.tolist()
    extra = (penalty + SEQUENCE_COST).tolist()
    cost = [0.0] * n
    carried = [0.0] * n  # cost and place, as the window compares them
    back = [0] * n
    window: deque[int] = deque()
    for j in range(1, n):
        value = carried[j - 1]
        while window and carried[window[-1]] >= value:
            window.pop()
        window.append(j - 1)
        place = places[j]
        while places[window[0]] < place - most:
            window.popleft()
        best = window[0]
        least = carried[best] + most - place
        for k in range(first[j], first[j + 1]):
            i = starts[k]
            value = cost[i] + rooms[k]
            if value < least:
                best, least = i, value
        cost[j] = least + extra[j]
        carried[j] = cost[j] + place
        back[j] = best
    chosen, j = [n - 1], n - 1
    while j:
        j = back[j]
        chosen.append(j)
    return position[np.array(chosen[::-1])]


def pack_stream(ends: np.ndarray, sentences: np.ndarray, most: int = SEQUENCE):
    """Pieces of a stream: document number, start and length in the stream, sequence, offset."""
    cuts = choose_cuts(*candidates(ends, sentences, most), most)
    starts = np.union1d(cuts, np.concatenate([[0], ends]))[:-1].astype(np.int64)
    lengths = np.diff(np.concatenate([starts, ends[-1:]]))
    document = np.searchsorted(ends, starts, "right")
    sequence = np.searchsorted(cuts, starts, "right") - 1
    return document, starts, lengths, sequence, starts - cuts[sequence]


def pack(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = W.DEFAULT_TOKENIZER,
    most: int = SEQUENCE,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids.

    ``sequence_id`` joins the partition's number and a counter, so it is the same whenever
    the partition is worked out again. Needs a tokenizer that drops white space.
    """
    picked = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = W.tokenizer_path(tokenizer)
        if not W.drops_white_space(path):
            raise ValueError(f"{tokenizer} does not cut texts at white space")
        memo = W.worker_cache(f"pack:{path}:{end_id}", lambda: W.WordIds(path, end_id))
        sequences = TaskContext.get().partitionId() << _SEQUENCE_BITS
        for batch, _ in slices_by_bytes(batches, "text", GROUP_BYTES):
            words, index, counts = W.split_words(batch.column("text"))
            stops = np.cumsum(counts)
            # The empty word, number 0, behind each document.
            places = np.insert(memo.numbers(words)[index], stops, 0)
            stream, place, sentences = memo.stream(places)
            ids = stream.astype("<u4").tobytes()
            ends = place[stops + np.arange(len(stops))]
            document, start, length, sequence, offset = pack_stream(
                ends, place[sentences], most
            )
            begins = np.concatenate([[0], ends[:-1]])
            view = memoryview(ids)
            parts = [
                view[4 * a : 4 * b]
                for a, b in zip(start.tolist(), (start + length).tolist(), strict=True)
            ]
            columns = [
                batch.column("id").take(pa.array(document)),
                pa.array(start - begins[document]),
                pa.array(length),
                pa.array([zlib.crc32(part) for part in parts], pa.int64()),
                pa.array((ends - begins)[document]),
                pa.array(sequence + sequences),
                pa.array(offset),
            ]
            if with_ids:
                flat = pa.array(np.frombuffer(ids, "<u4").astype(np.int32))
                edges = pa.array(np.concatenate([start, ends[-1:]]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(edges, flat))
            sequences += int(sequence[-1]) + 1
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names += ["ids"] if with_ids else []
    schema = f"id {id_type}, " + ", ".join(f"{name} long" for name in names[1:7])
    schema += ", ids array<int>" if with_ids else ""
    return map_arrow(picked, run, schema).withColumnRenamed("id", id_column)


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"))
