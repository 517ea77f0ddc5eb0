"""Handmade documents and brute-force versions of the operators."""

import hashlib
from collections import Counter, defaultdict

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    """Rows of (doc_id, text, lang, source), filled up with nulls, and a count of characters."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    full = [(*r, None if r[1] is None else len(r[1])) for r in full]
    return spark.createDataFrame(full, SCHEMA)


def clashing(df):
    """The same rows with more columns, named like those the operators make inside."""
    from pyspark.sql import functions as F

    for name in ("id", "block", "key", "size", "token", "node", "taken", "_source", "x0", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return (text or "").encode().split()


def links(rows):
    """Number of shingles and smallest reachable id of each (doc_id, text)."""
    sets = {}
    for i, text in rows:
        w = tuple((text or "").encode().lower().split())
        sets[i] = {w[j : j + 5] for j in range(len(w) - 4)} if len(w) >= 5 else ({w} if w else set())
    holders = defaultdict(list)
    for i, tokens in sets.items():
        for token in tokens:
            holders[token].append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, tokens in sets.items():
        common = Counter(j for token in tokens for j in holders[token] if j < i)
        for j, shared in common.items():
            if 100 * shared >= 75 * (len(tokens) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def removed(rows, length=50):
    """n_bytes, n_removed, n_spans, sha256 of what is left for each (doc_id, text)."""
    first = {}
    out = {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if first.setdefault(window, i) < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rule_statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by plain loops."""
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    return (
        len(w),
        sum(c not in WHITE for c in text),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(inside),
    )
