"""Token counts: lengths only, by batches balanced by bytes, long texts split where it is safe.

Null text counts as empty; empty text has 0 tokens. Repeated rows are counted each, other
columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from termloom.llm import words as W
from termloom.llm.common import map_arrow, slices_by_bytes, table

GROUP_BYTES = 4 << 20
LONG_BYTES = 1 << 18
TOKEN_LIMIT = 2048
# In byte-level vocabularies a space belongs to the word behind it.
_BEFORE_WORD = regex.compile(r"(?<=\p{L})(?= \p{L})")


def _pieces(text: str, most: int) -> list[str]:
    """Cut a long text between two words that a byte-level pattern never joins."""
    if len(text) <= most:
        return [text]
    cuts, last = [0], 0
    for m in _BEFORE_WORD.finditer(text):
        if m.start() - last >= most:
            cuts.append(m.start())
            last = m.start()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def _words_counter(path: str):
    memo = W.worker_cache(f"lengths:{path}", lambda: W.WordLengths(path))

    def count(texts: pa.Array) -> np.ndarray:
        words, index, counts = W.split_words(texts)
        sums = np.concatenate([[0], np.cumsum(memo.numbers(words)[index])])
        stops = np.cumsum(counts)
        return sums[stops] - sums[stops - counts]

    return count


def _batch_counter(path: str, split_words: bool):
    """Whole texts; long ones are split if a space between letters is a safe boundary."""
    tokenizer = W.worker_cache(f"tokenizer:{path}", lambda: W.load_tokenizer(path))

    def count(texts: pa.Array) -> np.ndarray:
        group = texts.fill_null("").to_pylist()
        cut = [_pieces(t, LONG_BYTES) if split_words else [t] for t in group]
        flat = [p for pieces in cut for p in pieces]
        lengths = [len(e.ids) for e in tokenizer.encode_batch_fast(flat, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, cut)])
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return sums[ends[1:]] - sums[ends[:-1]]

    return count


def _piece_counter(path: str):
    import sentencepiece

    model = W.worker_cache(
        f"pieces:{path}", lambda: sentencepiece.SentencePieceProcessor(model_file=path)
    )

    def count(texts: pa.Array) -> np.ndarray:
        found = model.encode(texts.fill_null("").to_pylist(), num_threads=1)
        return np.array([len(ids) for ids in found], np.int64)

    return count


def counter(path: str):
    """Function from texts to their token counts, for a .json or .model vocabulary."""
    if path.endswith(".model"):
        return _piece_counter(path)
    if W.drops_white_space(path):
        return _words_counter(path)
    tokenizer = W.load_tokenizer(path)
    probe = "ab cd"
    cut = tokenizer.pre_tokenizer.pre_tokenize_str(probe) if tokenizer.pre_tokenizer else []
    return _batch_counter(path, [c[1] for c in cut] == [(0, 2), (2, 5)])


def count_tokens(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = W.DEFAULT_TOKENIZER,
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text."""
    picked = df.select(df[id_column].alias("id"), df[text_column].alias("text"))
    id_type = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(W.tokenizer_path(tokenizer))
        for batch, lengths in slices_by_bytes(batches, "text", GROUP_BYTES):
            tokens = np.asarray(count(batch.column("text")), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(lengths),
                    pa.array(tokens),
                    pa.array(tokens > limit),
                ],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    schema = f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean"
    return map_arrow(picked, run, schema).withColumnRenamed("id", id_column)


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"))
