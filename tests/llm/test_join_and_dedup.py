"""Near copies, repeated passages and components against brute force."""

import random

import numpy as np
import pytest
from helpers import SCHEMA, clashing, documents, links, removed
from pyspark.sql import functions as F

from termloom.llm import blocks, ngram_join, suffix_dedup
from termloom.llm.components import contract


def variants(seed, groups=12, copies=9):
    """Groups of texts with edits from none to many, short and long, and a shared passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows, number = [], 0
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 30, 120, 400]))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 16])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            joined = rng.choice([" ", "  ", "\n"]).join(text)
            if g % 3 == 0:
                joined += " " + passage
            rows.append((number * 3 + 1, joined if rng.random() < 0.8 else joined.upper()))
            number += 1
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (1004, "ONE two")]
    rng.shuffle(rows)
    return rows


def joined(df):
    out = ngram_join.join_components(df).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_equals_brute_force(spark, seed):
    rows = variants(seed)
    assert joined(documents(spark, rows).repartition(3)) == links(rows)


def test_join_in_small_blocks(spark, monkeypatch):
    """Many blocks and buckets, so that keys and counts cross them."""
    rows = variants(4)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 600)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 64)
    assert joined(clashing(documents(spark, rows).repartition(4))) == links(rows)


def test_join_of_given_documents(spark, given):
    rows = [(i, t) for i, t, _, _ in given]
    assert joined(documents(spark, rows)) == links(rows)


def test_join_compares_all_pairs_left(spark, monkeypatch):
    """Without the rounds before it, the last comparison alone gives the same."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    rows = variants(5)
    assert joined(documents(spark, rows)) == links(rows)


def test_join_of_nothing_and_null_ids(spark):
    assert joined(documents(spark, [])) == {}
    text = "a b c d e f g h"
    out = ngram_join.join_components(documents(spark, [(None, text), (7, text), (9, text)]))
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in out.collect())
    assert got == [(0, 7), (7, 7), (9, 7)]


def test_one_of_each(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (2, text), (3, "x y z"), (3, "x y z"), (None, "p"), (None, "q"), (8, None)]
    out = ngram_join.one_of_each(clashing(documents(spark, rows)))
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(
        [(1, text), (3, "x y z"), (None, "p"), (None, "q"), (8, None)], key=str
    )
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_one_of_each_text_of_an_id(spark):
    """An id's text without a copy stays, whatever the id's other texts are."""
    a, b, c, d = ("a b c d e f g h", "i j k l m n o p", "q r s t u v w x", "1 2 3 4 5 6 7 8")
    rows = [(1, a), (5, a), (5, b), (6, c), (6, d), (6, c.upper()), (7, b), (8, None), (8, "")]
    out = ngram_join.one_of_each(clashing(documents(spark, rows)))
    got = sorted((r["doc_id"], r["text"] or "") for r in out.collect())
    assert got == [(1, a), (5, b), (6, d), (6, c.upper()), (8, "")]


def test_large_group_needs_few_comparisons(spark, monkeypatch):
    """Near copies by the hundred are compared with one of them, not with each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):
        text = list(base)
        text[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(text)))
    seen = []
    whole = ngram_join._linked

    def counted(pairs, nodes):
        seen.append(pairs.count())
        return whole(pairs, nodes)

    monkeypatch.setattr(ngram_join, "_linked", counted)
    assert {c for _, c in joined(documents(spark, rows)).values()} == {0}
    assert sum(seen) < 4 * len(rows)


def test_prefix_never_too_short():
    """Two sets that are similar enough share as many prefix tokens as the shorter choice asks."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = set(rng.choice(200, n, replace=False).tolist())
        y = set(x)
        for token in rng.permutation(list(x))[: int(rng.integers(0, n // 4 + 1))]:
            y.discard(token)
        y |= set(rng.choice(200, int(rng.integers(0, n // 4 + 1))).tolist())
        common = len(x & y)
        if not y or 100 * common < 75 * len(x | y):
            continue
        kx, ky = int(ngram_join.lengthening(len(x))), int(ngram_join.lengthening(len(y)))
        a = ngram_join.first_prefix(np.array(sorted(x)))
        b = ngram_join.first_prefix(np.array(sorted(y)))
        assert len(set(a.tolist()) & set(b.tolist())) >= min(kx, ky)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(1000, i) for i in range(1001, 1200)]  # a star
    edges += [(i, i + 1) for i in range(2000, 2100)]  # a chain
    up = {v: v for e in edges for v in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    found = contract(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert {r["v"]: r["p"] for r in found} == expected


def deduped(df):
    out = suffix_dedup.dedup(df).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out}


def passages(seed, docs=120):
    rng = random.Random(seed)
    letters = "abcdé ñ"
    shared = ["".join(rng.choices(letters, k=rng.choice([30, 49, 50, 51, 90, 300]))) for _ in range(12)]
    rows = []
    for i in range(docs):
        parts = [
            rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.randrange(80)))
            for _ in range(rng.randrange(6))
        ]
        rows.append((i * 2, "".join(parts)))
    rows += [(900, "z" * 200), (901, "z" * 120), (902, "zy" * 80), (903, None), (904, "")]
    rows += [(905, rows[3][1]), (906, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_brute_force(spark, seed):
    rows = passages(seed)
    assert deduped(documents(spark, rows).repartition(3)) == removed(rows)


def test_dedup_in_small_blocks(spark, monkeypatch):
    rows = passages(3)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 900)
    monkeypatch.setattr(suffix_dedup, "GROUP_KEYS", 64)
    monkeypatch.setattr(suffix_dedup, "LEVEL_BATCH", 4)
    monkeypatch.setattr(suffix_dedup, "SLICE", 128)
    assert deduped(clashing(documents(spark, rows).repartition(4))) == removed(rows)


def test_dedup_of_given_documents(spark, given):
    rows = [(i, t) for i, t, _, _ in given]
    assert deduped(documents(spark, rows)) == removed(rows)


def test_dedup_of_nothing_repeats_and_null_ids(spark):
    assert deduped(documents(spark, [])) == {}
    text = "0123456789" * 3 + "abcdefghijklmnopqrstuvwxyz"
    rows = [(None, text), (4, text), (4, text)]
    out = suffix_dedup.dedup(documents(spark, rows)).collect()
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in out)
    assert got == [(4, 0), (4, 0), (99, len(text))]


def test_dedup_text_drops_halved_code_points(spark):
    text = "é" * 40
    rows = [(1, "x" + text), (2, text + "tail")]
    out = suffix_dedup.dedup(documents(spark, rows), extra=["lang", "n_chars"], with_text=True)
    got = {r["doc_id"]: r["kept_text"] for r in out.collect()}
    assert got == {1: "x" + text, 2: "tail"}
    assert set(out.columns) >= {"lang", "n_chars"}


def test_window_keys_meet():
    """Equal windows name the same key wherever they stand, in slices of any size."""
    rng = np.random.default_rng(2)
    window = rng.integers(97, 100, 50).astype(np.uint8)
    keys = set()
    for _ in range(40):
        before, after = (rng.integers(97, 100, int(rng.integers(0, 90))).astype(np.uint8) for _ in "ab")
        data = np.concatenate([before, window, after])
        key, first, last = suffix_dedup.window_runs(data, np.array([len(data)]))
        keys.add(int(key[(first <= len(before)) & (last >= len(before))][0]))
    assert len(keys) == 1


def test_levels_grow_geometrically():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 6000).astype(np.uint8)
    marks = suffix_dedup.rolling(data, suffix_dedup.LENGTH)
    levels = suffix_dedup.Levels(data)
    for i in range(64):
        part = np.arange(i * 80, i * 80 + 80)
        first = levels.add(marks[part], part, np.full(80, i))
        assert (first == i).all()
    sizes = [len(level[0]) for level in levels.levels]
    assert sum(sizes) == 64 * 80 and len(sizes) <= 8
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))


def test_schema_is_kept(spark):
    df = spark.createDataFrame([], SCHEMA).withColumn("more", F.lit(1.5))
    out = suffix_dedup.dedup(df, extra=["more"], with_text=True)
    assert dict(out.dtypes)["more"] == "double" and dict(out.dtypes)["doc_id"] == "bigint"
