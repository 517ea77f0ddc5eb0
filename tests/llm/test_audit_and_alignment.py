"""Filter audit, token alignment and toxicity against brute force and held-out labels."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from helpers import clashing, documents

from termloom.llm import filter_audit, token_alignment, toxicity
from termloom.llm.words import tokenizer_path

# --- filter audit --------------------------------------------------------------------------


def fails(doc, docs):
    """Letters of the filters that a (doc_id, text, source) fails, by plain rules."""
    text = doc[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = ""
    found += "A" if len(words) < 200 else ""
    found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    found += "C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else ""
    found += "D" if re.search(r"[#$%&*|]", text) else ""
    behind = [d for d in docs if (d[1] or "") == text and d[0] is not None]
    found += "E" if any(doc[0] is None or d[0] < doc[0] for d in behind) else ""
    return found


def audited(docs, labels):
    """The rows of the audit by applying each order to each document."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    out = {}
    failed = [(d, fails(d, docs)) for d in docs]
    for part in {d[2] or "" for d in docs}:
        mine = [(d, f) for d, f in failed if (d[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [d for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in mine) - len(gone),
                    sum(f == letter for _, f in mine),
                    sum(d[0] in good for d in gone),
                    sum(d[0] in toxic for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit_rows(df):
    return {tuple(r[:3]): list(r[3:]) for r in df.collect()}


LONG = " ".join(f"word{i}" for i in range(230))
AUDIT_DOCS = [
    (1, None, None),
    (2, "", "a"),
    (3, LONG, "a"),
    (4, LONG, "b"),
    (5, LONG + " #", "b"),
    (6, "same " * 300, "a"),
    (6, "same " * 300, "a"),
    (7, "SAME WORDS", ""),
    (7, LONG, None),
    (None, LONG, "a"),
    (None, "only null id", "a"),
    (None, "only null id", "b"),
    (8, LONG.replace("word", "Wörd "), "ä"),
    (9, "$ A\x85B\x1c " * 100, "ä"),
]
AUDIT_LABELS = [(3, 1, 0), (4, 0, 1), (4, 1, None), (6, 1, 1), (99, 1, 1), (None, 1, 1), (5, None, 1)]


def test_audit_equals_every_order_applied_to_every_document(spark):
    docs = spark.createDataFrame(AUDIT_DOCS, "doc_id long, text string, source string")
    labels = spark.createDataFrame(AUDIT_LABELS, "doc_id long, quality int, toxic int")
    masks = filter_audit.document_masks(clashing(docs).drop("kept"))
    got = audit_rows(filter_audit.audit(filter_audit.mask_cells(masks, labels)))
    assert got == audited(AUDIT_DOCS, AUDIT_LABELS)
    assert len(got) == 600 * 4


def test_audit_of_the_given_tables_equals_brute_force(spark, sf_dir):
    db = duckdb.connect()
    docs = db.execute(f"select doc_id, text, source from '{sf_dir}/documents.parquet'").fetchall()
    labels = db.execute(f"select doc_id, quality, toxic from '{sf_dir}/labels.parquet'").fetchall()
    got = audit_rows(filter_audit.op12_filter_audit(spark, sf_dir))
    assert got == audited(docs, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    masks = filter_audit.document_masks(docs)
    assert filter_audit.audit(filter_audit.mask_cells(masks, labels)).count() == 0


def test_a_very_long_text_is_read_in_slices(monkeypatch):
    text = " ".join(f"w{i % 7000}" for i in range(40000)).encode()
    whole = filter_audit.own_mask(text)
    monkeypatch.setattr(filter_audit, "SLICE", 1000)
    assert filter_audit.own_mask(text) == whole == 2
    assert b" ".join(filter_audit._slices(text)) == text


def test_states_of_all_subsets():
    cells = np.random.default_rng(3).integers(0, 9, (4, 32, 3))
    states = filter_audit.subset_states(cells)
    for active in range(32):
        alive = [m for m in range(32) if not m & active]
        assert (states[:, active] == cells[:, alive].sum(1)).all()


# --- token alignment -----------------------------------------------------------------------


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def aligned(rows):
    """The columns of op11 for (doc_id, text), by plain loops over the libraries' ids."""
    a, b = libraries()
    entries = {number: entry for entry, number in a.get_vocab(True).items()}
    symbols = token_alignment.byte_symbols()

    def spelled_b(piece):
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def ends(spelled):
        at, found = 0, []
        for s in spelled:
            at += len(s)
            found.append(at)
        return found

    out, links, counts = [], [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        in_a = [bytes(symbols[c] for c in entries[t]) for t in ids_a]
        in_b = [spelled_b(b.id_to_piece(t)) for t in ids_b]
        if not text or {b"".join(in_a), b"".join(in_b)} != {f" {text}".encode()}:
            out.append([i, 0, 0, 0, 0, 0, 0, ""])
            links.append([])
            continue
        ends_a, ends_b = ends(in_a), ends(in_b)
        both = sorted(set(ends_a) & set(ends_b))
        mine = [(ids_a[ends_a.index(e)], ids_b[ends_b.index(e)]) for e in both]
        groups, low = [], 0
        for e in both:
            part_a = [str(t) for t, at in zip(ids_a, ends_a, strict=True) if low < at <= e]
            part_b = [str(t) for t, at in zip(ids_b, ends_b, strict=True) if low < at <= e]
            groups.append(",".join(part_a) + "|" + ",".join(part_b))
            low = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append([i, len(ids_a), len(ids_b), len(both), len(mine), 0, 0, digest])
        links.append(mine)
        counts.update(mine)
    highest = Counter()
    for (_, id_b), n in counts.items():
        highest[id_b] = max(highest[id_b], n)
    for row, mine in zip(out, links, strict=True):
        row[5] = sum(counts[pair] == highest[pair[1]] for pair in mine)
        row[6] = sum(counts[pair] for pair in mine)
    return sorted(map(tuple, out), key=repr)


def align_rows(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


ODD_TEXTS = [
    None,
    "",
    " ",
    "  two  spaces   before\nlines\r\n\tand tabs ",
    "special <|endoftext|> and <s> </s> <unk> <0x41> strings",
    "a sign of its own ▁ here",
    "Größe naïve 世界 😀 \u0000    x　y \u0085z",
    "é combining, ﬁ ligature, Ａ wide",
    "don't we'll I'd they've 12345 3.14 !!! ...",
    "x" * 3000,
    "\n\n\n",
]


def test_alignment_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, ODD_TEXTS[3]), (None, "a null id")]
    df = clashing(documents(spark, rows)).repartition(3)
    assert align_rows(token_alignment.align_tokens(df)) == aligned(rows)


def test_alignment_of_random_texts(spark):
    draw = random.Random(11)
    alphabet = ["the", "Wort", " ", "  ", "\n", "é", "世", "'s", "#", "7", "▁", "\r", " ", "don", "."]
    rows = [(i, "".join(draw.choices(alphabet, k=draw.randint(1, 60)))) for i in range(300)]
    got = align_rows(token_alignment.align_tokens(documents(spark, rows).repartition(4)))
    assert got == aligned(rows)


def test_alignment_of_given_documents(spark, given):
    rows = [(i, t) for i, t, _, _ in given if t is None or len(t) < 4000]
    got = align_rows(token_alignment.align_tokens(documents(spark, rows)))
    assert got == aligned(rows)


def test_alignment_of_a_long_text_in_segments(monkeypatch, given):
    """Pieces and segments change nothing, also if a later piece turns the text out wrong."""
    import pyarrow as pa

    longest = max((t for _, t, _, _ in given if t), key=len)
    texts = [t.encode() for t in (longest, "short one", longest + " ▁ " + longest, "", longest)]
    a = token_alignment.ByteLevel(tokenizer_path("byte_bpe_50k.json"))
    b = token_alignment.SentencePieces(tokenizer_path("piece_bpe_32k.model"))
    assert a.cuts_before_space and b.cuts_before_space

    def run():
        cells = token_alignment.align_block(pa.array(range(5)), texts, a, b)
        docs, links = (token_alignment._unpacked(cells[c]) for c in ("docs", "links"))
        by_pair = Counter()
        for d, p, n in zip(*[c.to_pylist() for c in links.columns], strict=True):
            by_pair[d, cells["pairs"][p]] += n
        return docs.to_pylist(), by_pair, dict(zip(cells["pairs"], cells["counts"], strict=True))

    whole = run()
    assert whole[0][2]["n_a"] == 0 < whole[0][0]["n_a"]
    for name, size in (("PIECE_CHARS", 200), ("SEGMENT_CHARS", 700), ("PART_CHARS", 2000)):
        monkeypatch.setattr(token_alignment, name, size)
    monkeypatch.setattr(token_alignment, "JOINED_CHARS", 90)
    assert len(token_alignment.cut(longest, 200)) > 5
    assert " ".join(token_alignment.cut(longest, 200)) == longest
    assert run() == whole


def test_alignment_of_nothing(spark):
    assert token_alignment.align_tokens(documents(spark, []).limit(0)).count() == 0


# --- toxicity ------------------------------------------------------------------------------


def toxic_rows(n):
    draw = random.Random(5)
    words = ["table", "river", "green", "follow", "window", "letter", "stone"]
    bad = ["vileword", "nastyone"]
    rows, marks = [], []
    for i in range(n):
        toxic = i % 5 == 2
        text = draw.choices(words, k=draw.randint(5, 80))
        if toxic:
            text.insert(draw.randrange(len(text)), draw.choice(bad) + draw.choice(["s", "ish", ""]))
        rows.append((i, " ".join(text).capitalize() + "."))
        marks.append((i, 1, int(toxic)))
    return rows, marks


def test_toxicity_on_held_out_rows(spark):
    rows, marks = toxic_rows(600)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(clashing(documents(spark, rows)), labels).collect()
    assert len(found) == 600
    for r in found:
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert 60 < len(held) < 200
    assert all(r.predicted == marks[r.doc_id][2] for r in held)


def test_labels_of_held_out_rows_are_not_seen(spark):
    from zlib import crc32

    rows, marks = toxic_rows(300)
    turned = [(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    schema = "doc_id long, quality int, toxic int"
    first, second = (
        sorted(map(tuple, toxicity.toxicity(documents(spark, rows), m).collect()))
        for m in (spark.createDataFrame(marks, schema), spark.createDataFrame(turned, schema))
    )
    assert first == second


def test_feature_counts_equal_plain_counts(spark):
    rows, marks = toxic_rows(80)
    toxic = {i: t for i, _, t in marks}
    labelled = spark.createDataFrame(
        [(i, t, toxic[i]) for i, t in rows], "id long, text string, toxic int"
    )
    want = Counter()
    for i, text in rows:
        for bucket in set(toxicity.present(text).tolist()):
            want[bucket, toxic[i]] += 1
    got = Counter()
    for r in toxicity.class_counts(labelled.repartition(3)).collect():
        got[r.bucket, 1], got[r.bucket, 0] = r.toxic, r.clean
    assert +got == want


def test_ngrams_of_slices_are_those_of_the_text(monkeypatch):
    text = "Some Words\n\n are here, ÄÖ 世界 " * 40
    whole = toxicity.present(text)
    folded = " " + " ".join(text.lower().split()) + " "
    distinct = {folded[i : i + w] for w in toxicity.WIDTHS for i in range(len(folded) - w + 1)}
    assert len(whole) == len(distinct)  # no two n-grams of this text share a bucket
    monkeypatch.setattr(toxicity, "SLICE", 50)
    assert (toxicity.present(text) == whole).all()
    assert len(toxicity.present("")) == 0


def test_weights_are_the_minimum_of_the_penalised_loss(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 4000)
    draw = np.random.default_rng(1)
    rows = [np.flatnonzero(draw.random(6) < 0.5) for _ in range(80)]
    labels = (draw.random(80) < 0.4).astype(float)
    ratios = draw.normal(0, 1, 6)
    weights, constant = toxicity.fit(rows, labels, np.ones(80), ratios)
    x = np.zeros((80, 6))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r]
    inner = weights / ratios
    error = 1 / (1 + np.exp(-(x @ inner + constant))) - labels
    assert np.abs(x.T @ error + toxicity.PENALTY * inner).max() < 1e-3
    assert abs(error.sum()) < 1e-3


def test_toxicity_of_odd_rows(spark):
    rows, marks = toxic_rows(200)
    odd = [(1000, None), (1001, ""), (1002, " "), (None, "vileword"), (5, rows[5][1]), (1003, "x " * 200000)]
    odd_marks = [(None, 1, 1), (1000, None, None), (2, 0, 0), (7777, 1, 1)]
    labels = spark.createDataFrame(marks + odd_marks, "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(documents(spark, rows + odd), labels).collect()
    assert len(found) == 206
    assert len({r.score for r in found if r.doc_id in (1000, 1001)}) == 1
    assert [r.held_out for r in found if r.doc_id is None] == [False]
    assert len({r.score for r in found if r.doc_id == 5}) == 1


@pytest.mark.parametrize("toxic, score", [(1, 1.0), (0, 0.0), (None, 0.0)])
def test_toxicity_without_both_classes(spark, toxic, score):
    docs = documents(spark, [(1, "a text"), (2, None), (3, "other")])
    labels = spark.createDataFrame([(i, 1, toxic) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert [r.score for r in found] == [score] * 3
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
