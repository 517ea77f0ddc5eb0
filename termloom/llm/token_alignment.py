"""Alignment of two tokenizers: where their tokens of one text end together.

A is a byte-level vocabulary of tokenizers and encodes a space and the text; B is a vocabulary
of sentencepiece, which adds the space itself. Both become lists of ids in Arrow: lists are
flattened with their parent indices, byte ends are cumulative sums that start anew with each
document, and an Acero hash join on (document, end) finds the pairs of tokens that end
together. Their ends cut a document into groups. Id pairs are counted by ``Table.group_by`` per
document and block; Spark adds the blocks' partial counts, and a block gets the totals of its
own pairs back, each once, so texts are encoded once and a frequent pair is one row per block.

A text that is null or empty, or whose tokens of A or of B do not spell a space and the text,
has no tokens: zeros and the empty string, and it counts no pair. Strings of special tokens
inside a text are plain text. Repeated rows count each. Ties for the highest count of an id of
B all count as best. Very long texts are cut between two letters with a space in between, which
neither vocabulary joins, and are worked on in parts; a stretch without such a place is one part.
For the same reason words are encoded once per part, however often they stand in it. An empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import by_bytes, map_arrow, table
from termloom.llm.words import load_tokenizer, tokenizer_path, worker_cache
from termloom.session import pinned

A_TOKENIZER = "byte_bpe_50k.json"
B_TOKENIZER = "piece_bpe_32k.model"
BLOCK_BYTES = 4 << 20  # of text, in a row of the stored blocks
PART_CHARS = 4 << 20  # encoded at once
SEGMENT_CHARS = 1 << 20  # aligned at once
PIECE_CHARS = 1 << 16
JOINED_CHARS = 1 << 17
SPACE_SIGN = "▁"
# A space between two of these characters begins a token in both vocabularies.
_SAFE_SPACE = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_SAFE_PLACE = re.compile(r"[!-~\w] [!-~\w]")
_BYTE_PIECE = re.compile(r"<0x[0-9A-F]{2}>")
STATISTICS = ("n_a", "n_b", "n_groups", "n_links")


def byte_symbols() -> dict[str, int]:
    """Symbol of a byte-level vocabulary -> byte: printable Latin-1 stands for itself."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)).difference(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Bytes and decimal number of every id."""

    def __init__(self, spelled: list[bytes]):
        self.bytes = pa.array(spelled, pa.large_binary())
        self.sizes = pa.array([len(s) for s in spelled], pa.int64())
        self.numbers = pa.array([str(i) for i in range(len(spelled))])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        raise NotImplementedError

    def spell(self, ids: pa.Array) -> bytes:
        return self.bytes.take(ids).buffers()[2].to_pybytes() if len(ids) else b""

    def lists(self, units: list[str], joined: int) -> tuple[pa.LargeListArray, np.ndarray]:
        """Ids of every unit, and whether they spell it; the first ``joined`` ones may be joined.

        Joined units are encoded as one text and told apart by their byte ends.
        """
        sizes = np.array([len(u.encode("utf-8")) + 1 for u in units], np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        flat, lengths, right = [], [np.zeros(0, np.int64)], np.ones(len(units), bool)
        start = 0
        while start < len(units):
            most = edges[start] + JOINED_CHARS
            stop = int(min(len(units), max(start + 1, np.searchsorted(edges, most, "right") - 1)))
            if start < joined:
                stop = min(stop, joined)
                text = " ".join(units[start:stop])
                ids = pa.array(self.encode([text])[0], pa.int32())
                ends = np.cumsum(np.asarray(self.sizes.take(ids)))
                at = np.searchsorted(ends, edges[start + 1 : stop + 1] - edges[start])
                if self.spell(ids) == b" " + text.encode("utf-8") and np.array_equal(
                    ends[at], edges[start + 1 : stop + 1] - edges[start]
                ):
                    flat.append(ids)
                    lengths.append(np.diff(at, prepend=-1))
                    start = stop
                    continue
            for i, own in enumerate(self.encode(units[start:stop]), start):
                ids = pa.array(own, pa.int32())
                right[i] = self.spell(ids) == b" " + units[i].encode("utf-8")
                flat.append(ids)
                lengths.append(np.array([len(ids)], np.int64))
            start = stop
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
        values = pa.concat_arrays(flat) if flat else pa.array([], pa.int32())
        return pa.LargeListArray.from_arrays(pa.array(offsets), values), right


class ByteLevel(Vocabulary):
    """Encodes with a .json file of tokenizers."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.tokenizer.encode_special_tokens = True
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(entries.values()) + 1)
        symbols = byte_symbols()
        for entry, number in entries.items():
            if all(letter in symbols for letter in entry):
                spelled[number] = bytes(symbols[letter] for letter in entry)
        super().__init__(spelled)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]
        #: A cut before a space is safe if that is where words are cut anyway.
        self.cuts_before_space = steps.get("type") == "ByteLevel" and steps.get("use_regex", True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        spaced = [" " + text for text in texts]
        found = self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)
        return [encoded.ids for encoded in found]


class SentencePieces(Vocabulary):
    """Encodes with a .model file of sentencepiece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__(
            [
                bytes([int(p[3:5], 16)])
                if _BYTE_PIECE.fullmatch(p)
                else p.replace(SPACE_SIGN, " ").encode("utf-8")
                for p in pieces
            ]
        )
        self.cuts_before_space = not any(SPACE_SIGN in p.lstrip(SPACE_SIGN) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def cut(text: str, most: int = PIECE_CHARS) -> list[str]:
    """Pieces of a long text; a space was between any two of them."""
    pieces, start = [], 0
    while len(text) - start > most:
        found = _SAFE_PLACE.search(text, start + most)
        if not found:
            break
        pieces.append(text[start : found.start() + 1])
        start = found.start() + 2
    return [*pieces, text[start:]]


def _safe(unit: str) -> bool:
    """True if a space before or behind the unit is a safe one, seen from the unit."""
    if not unit:
        return False
    first, last = unit[0], unit[-1]
    return (first.isalnum() or "!" <= first <= "~") and (last.isalnum() or "!" <= last <= "~")


def split_units(pieces: list[str]) -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """Different units of the pieces, between safe spaces; units by place; edges of the pieces.

    The units that may be joined with others come first, so many as the second value says.
    """
    listed = pc.split_pattern(pa.array(pieces, pa.large_string()), " ")
    coded = listed.flatten().dictionary_encode()
    units = coded.dictionary.to_pylist()
    safe = np.array([_safe(u) for u in units], bool)
    places = np.asarray(coded.indices, np.int64)
    edges = np.asarray(listed.offsets, np.int64)
    owner = np.repeat(np.arange(len(pieces)), np.diff(edges))
    odd = np.bincount(owner[~safe[places]], minlength=len(pieces)) > 0
    if odd.any():
        number = {u: i for i, u in enumerate(units)}
        parts = np.split(places, edges[1:-1])
        for i in np.flatnonzero(odd).tolist():
            own = _SAFE_SPACE.split(pieces[i])
            parts[i] = np.array([number.setdefault(u, len(number)) for u in own], np.int64)
        places = np.concatenate(parts)
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        units = list(number)
        safe = np.array([_safe(u) for u in units], bool)
    used = np.zeros(len(units), bool)
    used[places] = True
    order = np.concatenate([np.flatnonzero(used & safe), np.flatnonzero(used & ~safe)])
    moved = np.zeros(len(units), np.int64)
    moved[order] = np.arange(len(order))
    joined = int((used & safe).sum())
    return [units[i] for i in order.tolist()], joined, moved[places], edges


@dataclass
class Encoded:
    """Ids of pieces, flat, the edges of each piece in them, and whether they spell it."""

    ids: pa.Array
    edges: np.ndarray
    right: np.ndarray

    def piece_lists(self, start: int, stop: int) -> pa.LargeListArray:
        low, high = int(self.edges[start]), int(self.edges[stop])
        offsets = pa.array(self.edges[start : stop + 1] - low)
        return pa.LargeListArray.from_arrays(offsets, self.ids.slice(low, high - low))


def encode_pieces(pieces: list[str], vocabularies: list[Vocabulary], whole: bool) -> list[Encoded]:
    """The pieces in each vocabulary; their different units are encoded once unless ``whole``."""
    if whole:
        units, joined = pieces, 0
        places, edges = np.arange(len(pieces)), np.arange(len(pieces) + 1)
    else:
        units, joined, places, edges = split_units(pieces)
    found = []
    for vocabulary in vocabularies:
        lists, right = vocabulary.lists(units, joined)
        taken = lists.take(pa.array(places))
        own_edges = np.asarray(taken.offsets, np.int64)[edges]
        wrong = np.concatenate([[0], np.cumsum(~right[places])])[edges]
        found.append(Encoded(taken.values, own_edges, np.diff(wrong) == 0))
    return found


@dataclass
class Tokens:
    """Flat tokens of a segment: document, id, and byte end within the document's part."""

    docs: np.ndarray
    ids: pa.Array
    ends: np.ndarray

    @classmethod
    def of(
        cls, listed: pa.LargeListArray, owners: pa.Array, sizes: pa.Array, n_docs: int
    ) -> Tokens:
        ids = pc.list_flatten(listed)
        docs = np.asarray(owners.take(pc.list_parent_indices(listed)))
        size = sizes.take(ids)
        running = np.asarray(pc.cumulative_sum(size))
        total = np.bincount(docs, np.asarray(size), n_docs).astype(np.int64)
        return cls(docs, ids, running - (np.cumsum(total) - total)[docs])

    def where(self, kept: np.ndarray) -> Tokens:
        some = kept[self.docs]
        if some.all():
            return self
        return Tokens(self.docs[some], self.ids.filter(pa.array(some)), self.ends[some])

    def table(self, name: str) -> pa.Table:
        places = np.arange(len(self.docs))
        columns = [self.docs, self.ends, self.ids, places]
        return pa.table([pa.array(c) for c in columns], ["doc", "end", name, f"at_{name}"])

    def group_ends(self, linked: np.ndarray) -> np.ndarray:
        """Places of the tokens that end a group: the last ones at a linked end."""
        ends = np.zeros(len(self.docs), bool)
        ends[linked] = True
        ends[:-1] &= (self.ends[1:] != self.ends[:-1]) | (self.docs[1:] != self.docs[:-1])
        return np.flatnonzero(ends)


@dataclass
class Document:
    """What is known of a document so far; long ones come in several segments."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros(len(STATISTICS), np.int64))
    groups: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    right: bool = True

    def add(self, counts: np.ndarray, groups: str) -> None:
        if self.counts.any():
            self.groups.update(b";")
        self.groups.update(groups.encode("ascii"))
        self.counts += counts

    def cells(self) -> list:
        if self.right and self.counts.any():
            return [*self.counts.tolist(), self.groups.hexdigest()]
        return [*[0] * len(STATISTICS), ""]


def _group_texts(tokens: Tokens, ends: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], ends + 1]).astype(np.int32))
    return pc.binary_join(
        pa.ListArray.from_arrays(offsets, vocabulary.numbers.take(tokens.ids)), ","
    )


def align_segment(
    owners: np.ndarray,
    in_a: pa.LargeListArray,
    in_b: pa.LargeListArray,
    right: np.ndarray,
    a: Vocabulary,
    b: Vocabulary,
    docs: list[Document],
) -> pa.Table:
    """Add a segment to its documents; number of links by (doc, a, b).

    ``owners`` holds each piece's document in rising order; ``right`` tells for each whether both
    vocabularies spell it.
    """
    first = int(owners[0])
    n_docs = int(owners[-1]) - first + 1
    local = owners - first
    for i in np.unique(local[~right]).tolist():
        docs[first + i].right = False
    alive = np.array([d.right for d in docs[first : first + n_docs]])
    in_a, in_b = (
        Tokens.of(listed, pa.array(local), v.sizes, n_docs).where(alive)
        for listed, v in ((in_a, a), (in_b, b))
    )
    links = in_a.table("a").join(
        in_b.table("b"), keys=["doc", "end"], join_type="inner", use_threads=False
    )
    end_a = in_a.group_ends(np.asarray(links.column("at_a")))
    end_b = in_b.group_ends(np.asarray(links.column("at_b")))
    groups = pc.binary_join_element_wise(
        _group_texts(in_a, end_a, a), _group_texts(in_b, end_b, b), "|"
    )
    n_groups = np.bincount(in_a.docs[end_a], minlength=n_docs)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32))
    texts = pc.binary_join(pa.ListArray.from_arrays(offsets, groups), ";").to_pylist()
    counts = np.stack(
        [
            np.bincount(in_a.docs, minlength=n_docs),
            np.bincount(in_b.docs, minlength=n_docs),
            n_groups,
            np.bincount(np.asarray(links.column("doc")), minlength=n_docs),
        ],
        axis=1,
    )
    for i in np.flatnonzero(counts.any(1)).tolist():
        docs[first + i].add(counts[i], texts[i])
    summed = links.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")])
    doc = pc.add(summed.column("doc"), first)
    return pa.table([doc, summed["a"], summed["b"], summed["count_all"]], ["doc", "a", "b", "n"])


def _parts(texts: list[bytes], whole: bool) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Pieces of the texts with their documents, about PART_CHARS at once."""
    owners: list[int] = []
    pieces: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        decoded = text.decode("utf-8")
        for piece in [decoded] if whole else cut(decoded, PIECE_CHARS):
            if pieces and size + len(piece) > PART_CHARS:
                yield np.array(owners), pieces
                owners, pieces, size = [], [], 0
            owners.append(i)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield np.array(owners), pieces


def _segments(pieces: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of about SEGMENT_CHARS."""
    edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    start = 0
    while start < len(pieces):
        stop = int(np.searchsorted(edges, edges[start] + SEGMENT_CHARS, "right")) - 1
        stop = max(start + 1, stop)
        yield start, stop
        start = stop


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def align_block(ids: pa.Array, texts: list[bytes], a: Vocabulary, b: Vocabulary) -> dict:
    """Documents of a block, their links by pair, and the block's number of links of each pair."""
    docs = [Document() for _ in texts]
    whole = not (a.cuts_before_space and b.cuts_before_space)
    parts = []
    for owners, pieces in _parts(texts, whole):
        in_a, in_b = encode_pieces(pieces, [a, b], whole)
        right = in_a.right & in_b.right
        for low, high in _segments(pieces):
            lists = [e.piece_lists(low, high) for e in (in_a, in_b)]
            parts.append(
                align_segment(owners[low:high], *lists, right[low:high], a, b, docs)
            )
    right = np.array([d.right for d in docs], bool)
    doc, pair, n = (np.zeros(0, np.int64) for _ in range(3))
    if parts:
        rows = pa.concat_tables(parts)
        # Documents of several segments have a pair several times, and may have turned out wrong.
        rows = rows.filter(pa.array(right[np.asarray(rows.column("doc"))]))
        rows = rows.group_by(["doc", "a", "b"], use_threads=False).aggregate([("n", "sum")])
        rows = rows.sort_by("doc")
        doc, n = np.asarray(rows.column("doc")), np.asarray(rows.column("n_sum"))
        pair = (np.asarray(rows.column("a")).astype(np.int64) << 32) + np.asarray(rows.column("b"))
    summed = pa.table([pa.array(pair), pa.array(n)], ["pair", "n"])
    summed = summed.group_by("pair", use_threads=False).aggregate([("n", "sum")]).sort_by("pair")
    pairs = np.asarray(summed.column("pair"))
    cells = [d.cells() for d in docs]
    columns = [pa.array(c, pa.int64()) for c in list(zip(*cells, strict=True))[:-1]]
    known = pa.table(
        [ids, *columns, pa.array([c[-1] for c in cells])], ["id", *STATISTICS, "groups_sha256"]
    )
    links = pa.table(
        [pa.array(doc.astype(np.int32)), pa.array(np.searchsorted(pairs, pair).astype(np.int32)), pa.array(n)],
        ["doc", "pair", "n"],
    )
    return {
        "pairs": pairs.tolist(),
        "counts": summed.column("n_sum").to_pylist(),
        "docs": _packed(known),
        "links": _packed(links),
    }


def aligned_blocks(df: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """One row per block of about BLOCK_BYTES of ``text``; texts are encoded here and only here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path_a, path_b = tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b)
        a = worker_cache(f"byte_level:{path_a}", lambda: ByteLevel(path_a))
        b = worker_cache(f"sentence_pieces:{path_b}", lambda: SentencePieces(path_b))
        number = TaskContext.get().partitionId() << 33
        for batch, group in by_bytes(batches, "text", BLOCK_BYTES):
            cells = align_block(batch.column("id"), group, a, b)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "pairs": pa.array([cells["pairs"]], pa.list_(pa.int64())),
                    "counts": pa.array([cells["counts"]], pa.list_(pa.int64())),
                    "docs": pa.array([cells["docs"]], pa.binary()),
                    "links": pa.array([cells["links"]], pa.binary()),
                }
            )
            number += 1

    schema = "block long, pairs array<long>, counts array<long>, docs binary, links binary"
    return map_arrow(df, run, schema)


def pair_totals(blocks: DataFrame) -> DataFrame:
    """``pair``, its ``total`` over all blocks, and whether it is the highest of its id of B."""
    partial = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("c"))
    totals = partial.groupBy(F.col("c.pairs").alias("pair")).agg(F.sum("c.counts").alias("total"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def align_tokens(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer_a: str = A_TOKENIZER,
    tokenizer_b: str = B_TOKENIZER,
) -> DataFrame:
    """Id, tokens of A and B, groups, links, links at a best pair, sum of counts, hash of groups."""
    picked = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()
    blocks = pinned(aligned_blocks(picked, tokenizer_a, tokenizer_b), "aligned")
    own = blocks.select("block", F.explode("pairs").alias("pair"))
    answers = own.join(pair_totals(blocks), "pair").groupBy("block").agg(
        F.collect_list(F.struct("pair", "total", "best")).alias("answers")
    )
    met = blocks.select("block", "docs", "links").join(answers, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answered = batch.column("answers")
            for i in range(batch.num_rows):
                docs = _unpacked(batch.column("docs")[i].as_py())
                links = _unpacked(batch.column("links")[i].as_py())
                sums = np.zeros((2, links.num_rows + 1), np.int64)
                if links.num_rows:
                    got = answered[i].values
                    order = np.argsort(np.asarray(got.field("pair")))
                    place = order[np.asarray(links.column("pair"))]
                    n = np.asarray(links.column("n"))
                    best = got.field("best").cast(pa.int8())
                    sums[0, 1:] = np.cumsum(n * np.asarray(best, np.int64)[place])
                    sums[1, 1:] = np.cumsum(n * np.asarray(got.field("total"), np.int64)[place])
                every = np.arange(docs.num_rows + 1)
                edges = np.searchsorted(np.asarray(links.column("doc")), every)
                found = np.diff(sums[:, edges], axis=1)
                hashes = docs.column("groups_sha256")
                done = docs.drop_columns(["groups_sha256"])
                done = done.append_column("n_best", pa.array(found[0]))
                done = done.append_column("count_sum", pa.array(found[1]))
                yield from done.append_column("groups_sha256", hashes).to_batches()

    longs = ", ".join(f"{c} long" for c in (*STATISTICS, "n_best", "count_sum"))
    schema = f"id {id_type}, {longs}, groups_sha256 string"
    return map_arrow(met.select("docs", "links", "answers"), run, schema).withColumnRenamed(
        "id", id_column
    )


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align_tokens(table(spark, sf, "documents"))
