"""Token ids of white-space words, remembered by the worker.

For a tokenizer that drops white space and never looks across it, a text's ids are the ids
of its words in order, so white space is a safe place to split and a word need only be
encoded once. Words are cut at ASCII white space; anything else, special strings included,
is left to the library.
"""

from __future__ import annotations

import json
import sys
import types
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ENCODE_BYTES = 1 << 20
MEMO_WORDS = 1_200_000
SENTENCE_ENDS = ".!?…。！？"
DEFAULT_TOKENIZER = "word_bpe_49k.json"


def worker_cache(name: str, make: Callable):
    """An object kept for all tasks of this Python worker."""
    holder = sys.modules.setdefault("termloom_worker", types.ModuleType("termloom_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file on this machine; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def drops_white_space(path: str) -> bool:
    """True if a .json tokenizer's first cut removes white space and adds nothing for it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec.get("pre_tokenizer") or {}
    first = steps["pretokenizers"][0] if steps.get("type") == "Sequence" else steps
    normal = spec.get("normalizer") or {}
    parts = normal.get("normalizers", [normal])
    if any(part.get("type") in ("Prepend", "Precompiled") for part in parts):
        return False
    if any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec["added_tokens"]):
        return False
    if first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return True
    pattern = first.get("pattern", {}).get("Regex", "")
    removed = first.get("behavior") == "Removed" and first.get("invert")
    return first.get("type") == "Split" and bool(removed) and "[^\\s" in pattern


def keeps_letters(path: str) -> bool:
    """True if words are lower-cased and letters reach the model as byte symbols, unchanged."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = spec.get("normalizer") or {}
    for part in normal.get("normalizers", [normal] if normal else []):
        white = part.get("type") == "Replace" and part["pattern"] == {"Regex": "\\s+"}
        if part.get("type") not in ("NFC", "Lowercase") and not white:
            return False
    if "Lowercase" not in [part.get("type") for part in normal.get("normalizers", [normal])]:
        return False
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and "|[\\p{L}]+|" in steps[0]["pattern"].get("Regex", "")
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and spec["model"]["type"] == "BPE"
    )


class ByteSymbols(dict):
    """Letter -> the symbols that stand for its bytes, as the library maps them."""

    def __init__(self):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, letter: str) -> str:
        symbols = self[letter] = self.level.pre_tokenize_str(letter)[0][0]
        return symbols


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of some texts, the number of each word in order, and words per text."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    values = lists.flatten()
    some = pc.not_equal(values, "")
    filled = np.asarray(some.cast(pa.uint8()), np.int64)
    edges = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
    before = np.concatenate([[0], np.cumsum(filled)])
    coded = values.filter(some).dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    return words, np.asarray(coded.indices, np.int64), np.diff(before[edges])


def lowered(text: str) -> str | None:
    """The text in lower case where that is sure to be what the library makes of it."""
    if text.isascii():
        return text.lower()
    low = text.lower()
    if low != text and (max(text) >= "\u0180" or "\u0130" in text):
        return None
    return low if unicodedata.is_normalized("NFC", low) else None


class Words(dict):
    """word -> a number; filled by ``learn``, emptied when it grows too large."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load_tokenizer(path)
        self.model = self.tokenizer.model
        self.symbols = ByteSymbols() if keeps_letters(path) else None
        self.reset()

    def reset(self) -> None:
        self.clear()

    def put(self, words: list[bytes], ids: list[list[int]]) -> None:
        raise NotImplementedError

    def put_joined(self, words: list[bytes], cores: list[bytes], tails: list[bytes]) -> None:
        """Words whose ids are those of a core and a sign, which are known."""
        raise NotImplementedError

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, once all are known."""
        self.learn(words)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def learn(self, words: Iterable[bytes]) -> None:
        """Encode the words not known yet.

        As the vocabulary is lower case and letters and signs are cut apart, a run of
        letters has the ids of its lower case, a full stop or comma behind letters has its
        own, and lower-case letters may be given to the model as they are. All else goes
        through the library in batches balanced by bytes.
        """
        every = set(words)
        new = every.difference(self)
        if len(self) + len(new) > MEMO_WORDS:
            self.reset()
            new = every.difference(self)
        letters: dict[bytes, str] = {}
        alike: list[tuple[bytes, bytes]] = []
        joined: list[tuple[bytes, bytes, bytes]] = []
        other: list[bytes] = []
        if self.symbols is None:
            other = list(new)
            new = set()
        for word in new:
            text = word.decode("utf-8")
            low = lowered(text)
            if low is None:
                other.append(word)
            elif low.isalpha():
                core = low.encode("utf-8")
                letters[core] = low
                if core != word:
                    alike.append((word, core))
            elif low[-1] in ".," and low[:-1].isalpha():
                core = low[:-1].encode("utf-8")
                letters[core] = low[:-1]
                joined.append((word, core, word[-1:]))
            else:
                other.append(word)
        for core in self.keys() & letters.keys():
            del letters[core]
        self._from_model(letters)
        self._encode([*other, *{tail for _, _, tail in joined if tail not in self}.difference(other)])
        for word, core in alike:
            self[word] = self[core]
        if joined:
            self.put_joined(*map(list, zip(*joined, strict=True)))

    def _from_model(self, letters: dict[bytes, str]) -> None:
        tokenize, symbols = self.model.tokenize, self.symbols
        found = [
            tokenize(text if text.isascii() else "".join(map(symbols.__getitem__, text)))
            for text in letters.values()
        ]
        self.put(list(letters), [[token.id for token in tokens] for tokens in found])

    def _encode(self, wanted: list[bytes]) -> None:
        start = size = 0
        for at, part in enumerate(wanted):
            size += len(part)
            if size > ENCODE_BYTES or at + 1 == len(wanted):
                batch = wanted[start : at + 1]
                found = self.tokenizer.encode_batch_fast(
                    [w.decode("utf-8") for w in batch], add_special_tokens=False
                )
                self.put(batch, [encoded.ids for encoded in found])
                start, size = at + 1, 0


class WordLengths(Words):
    """word -> how many ids it has."""

    def put(self, words: list[bytes], ids: list[list[int]]) -> None:
        self.update(zip(words, map(len, ids), strict=True))

    def put_joined(self, words: list[bytes], cores: list[bytes], tails: list[bytes]) -> None:
        for word, core, tail in zip(words, cores, tails, strict=True):
            self[word] = self[core] + self[tail]


class Column:
    """Numbers in an array that grows by doubling."""

    def __init__(self, kind: str):
        self.cells = np.zeros(1024, kind)
        self.size = 0

    def extend(self, values) -> None:
        need = self.size + len(values)
        if need > len(self.cells):
            grown = np.zeros(max(need, 2 * len(self.cells)), self.cells.dtype)
            grown[: self.size] = self.cells[: self.size]
            self.cells = grown
        self.cells[self.size : need] = values
        self.size = need


class WordIds(Words):
    """word -> its place in arrays of first ids, lengths and sentence ends.

    The empty word, at place 0, stands for the end of a document and has the id ``end_id``.
    """

    def __init__(self, path: str, end_id: int):
        self.end_id = end_id
        super().__init__(path)

    def reset(self) -> None:
        self.clear()
        self.ids = Column("u4")
        self.first, self.length, self.ends = Column("i8"), Column("i8"), Column("?")
        self.put([b""], [[self.end_id]])

    def put(self, words: list[bytes], ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        self._add(words, lengths, flat)

    def put_joined(self, words: list[bytes], cores: list[bytes], tails: list[bytes]) -> None:
        both = chain.from_iterable(zip(cores, tails, strict=True))
        places = np.fromiter(map(self.__getitem__, both), np.int64, 2 * len(words))
        flat, _, _ = self.stream(places)
        self._add(words, self.length.cells[places].reshape(-1, 2).sum(1), flat)

    def _add(self, words: list[bytes], lengths: np.ndarray, flat: np.ndarray) -> None:
        start = self.first.size
        self.update(zip(words, range(start, start + len(words)), strict=True))
        self.first.extend(self.ids.size + np.cumsum(lengths) - lengths)
        self.length.extend(lengths)
        self.ends.extend([bool(word) and ends_sentence(word) for word in words])
        self.ids.extend(flat)

    def stream(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of known words one after the other, the end of each word, and sentence ends."""
        lengths = self.length.cells[places]
        ends = np.cumsum(lengths)
        shift = self.first.cells[places] - (ends - lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids.cells[np.repeat(shift, lengths) + np.arange(total)]
        return ids, ends, self.ends.cells[places]


def ends_sentence(word: bytes) -> bool:
    """True if the word closes a sentence, brackets and quotation marks aside."""
    last = word[-1]
    if last in b".!?":
        return True
    if last < 128 and last not in b"\"')]":
        return False
    return word.decode("utf-8").rstrip("\"')]»”’")[-1:] in tuple(SENTENCE_ENDS)
