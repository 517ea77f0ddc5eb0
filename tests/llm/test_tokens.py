"""Token counts and packing against the tokenizer itself."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import clashing, documents
from tokenizers import Tokenizer

from termloom.llm import packing, token_counts, words

ODD = [
    None,
    "",
    " \t\n",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>.",
    "don't I'LL It's. x's, 's.",
    "ΣΑΣ σας. ﬁ ǅ İ ſt",
    "a b c\u0085d \x1c é é",
    "中文。日本語！ ok?",
    "." * 300 + " " + ",.,." * 50,
    "word " * 5000,
    "x" * 20000,
]


def odd_documents(seed=1):
    rng = random.Random(seed)
    letters = "abé'ß.,!<|>Σσçñ中 ́\x1c12İǅ\t\nſ…K-"
    made = ["".join(rng.choices(letters, k=rng.randrange(90))) for _ in range(150)]
    return [(i, t) for i, t in enumerate([*ODD, *made])]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, given, name, monkeypatch):
    rows = [*odd_documents(), *[(1000 + i, t) for i, t, _, _ in given]]
    monkeypatch.setattr(token_counts, "LONG_BYTES", 2000)
    df = clashing(documents(spark, rows).repartition(3))
    out = {r["doc_id"]: r for r in token_counts.count_tokens(df, tokenizer=name).collect()}
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        whole = Tokenizer.from_file(path)
        count = lambda t: len(whole.encode(t, add_special_tokens=False).ids)
    for i, text in rows:
        assert out[i]["n_tokens"] == count(text or ""), repr(text[:60])
        assert out[i]["n_bytes"] == len((text or "").encode())
        assert out[i]["over_limit"] == (out[i]["n_tokens"] > 2048)
    assert len(out) == len(rows)


def test_memory_of_words_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(words, "MEMO_WORDS", 50)
    path = public_tokenizers.path("word_bpe_49k.json")
    memo, lengths = words.WordIds(path, 7), words.WordLengths(path)
    rng = random.Random(2)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdEÉé.,", k=4)) for _ in range(20))
        parts, index, counts = words.split_words(pa.array([text]))
        assert counts.tolist() == [len(text.split())]
        stream, _, _ = memo.stream(memo.numbers(parts)[index])
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert stream.tolist() == ids and lengths.numbers(parts)[index].sum() == len(ids)
        assert len(memo) <= 100 and memo[b""] == 0
        assert memo.stream(np.array([0]))[0].tolist() == [7]


def test_packing_is_whole(spark, given, tokenizer):
    rows = [*odd_documents(), *[(1000 + i, t) for i, t, _, _ in given]]
    out = packing.pack(clashing(documents(spark, rows).repartition(2)), with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        joined = []
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == len(joined) and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"]))
            joined += r["ids"]
        assert joined == ids
    padding = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in parts)
        assert [r["offset"] for r in parts] == np.cumsum([0, *[r["length"] for r in parts]])[:-1].tolist()
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding < 0.02 * sum(r["length"] for r in out)


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, [])).collect() == []


def brute_cost(position, penalty, most):
    """Least cost by trying every earlier cut for every cut."""
    cost = [0.0]
    for j in range(1, len(position)):
        least = float("inf")
        for i in range(j):
            length = int(position[j] - position[i])
            if length > most:
                continue
            room = most - length
            if length & (length - 1) == 0 and length >= packing.LEAST_POWER:
                room *= packing.ROOM_SHARE
            least = min(least, cost[i] + room)
        cost.append(least + packing.SEQUENCE_COST + penalty[j])
    return cost[-1]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_best(seed, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_POWER", 8)
    rng = np.random.default_rng(seed)
    most = 64
    ends = np.cumsum(rng.integers(1, 90, 40))
    sentences = np.unique(rng.integers(1, ends[-1], 80))
    position, penalty = packing.candidates(ends, sentences, most)
    assert position[0] == 0 and position[-1] == ends[-1] and (np.diff(position) > 0).all()
    assert np.diff(position).max() <= most
    cuts = packing.choose_cuts(position, penalty, most)
    lengths = np.diff(cuts)
    assert lengths.max() <= most
    exact = (lengths & (lengths - 1) == 0) & (lengths >= packing.LEAST_POWER)
    room = (most - lengths) * np.where(exact, packing.ROOM_SHARE, 1)
    cost = room.sum() + packing.SEQUENCE_COST * len(lengths)
    cost += penalty[np.isin(position, cuts[1:])].sum()
    assert cost == pytest.approx(brute_cost(position, penalty, most))
