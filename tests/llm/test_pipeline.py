"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from helpers import documents, links, removed, rule_statistics
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termloom.llm.common import table
from termloom.session import pinned

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = pinned(stage(spark, docs, sf_dir), name)
        found[name] = docs
    return found


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(outputs):
    names = list(outputs)
    for name in names[1:-1]:
        assert outputs[name].columns == outputs[""].columns


def test_quality(outputs):
    before, after = dict(pairs(outputs[""])), dict(pairs(outputs["quality_rules"]))
    assert 0 < len(after) < len(before)
    for i, text in after.items():
        n, _, _, _, repeats = rule_statistics(text)
        assert text == before[i] and n >= 20 and 100 * repeats <= 30 * n


def test_near_copies(outputs):
    before = pairs(outputs["quality_rules"])
    expected = {i for i, (_, c) in links(before).items() if i == c}
    assert sorted(i for i, _ in pairs(outputs["ngram_join"])) == sorted(expected)


def test_repeats(outputs):
    before, after = pairs(outputs["ngram_join"]), dict(pairs(outputs["suffix_dedup"]))
    expected = removed(before)
    for i, (n, gone, _, _) in expected.items():
        left = len(after.get(i, "").encode())
        assert n - gone - 6 * expected[i][2] <= left <= n - gone
        assert (i in after) or gone == n
    for r in outputs["suffix_dedup"].collect():
        assert r["n_chars"] == len(r["text"])


def test_mix(outputs):
    before = outputs["suffix_dedup"].collect()
    after = outputs["mixing"].collect()
    size, got = defaultdict(int), Counter()
    for r in before:
        size[r["source"]] += len(r["text"].encode().split())
    for r in after:
        got[r["source"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert abs(sum(got.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(got[s] <= 2 * size[s] for s in size)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2


def test_pack(outputs):
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for i, text in pairs(outputs["mixing"]):
        expected[i] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in outputs["packing"].collect():
        got[r["doc_id"]] += r["length"]
    assert got == expected


def test_run_is_the_stages(spark, sf_dir, outputs):
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.columns == outputs["packing"].columns
    total = F.sum("length")
    assert run.agg(total).first()[0] == outputs["packing"].agg(total).first()[0]


def test_odd_rows_pass(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text, None, None), (None, text), (3, None)]
    docs = documents(spark, rows).withColumn("block", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), name)
        assert docs.columns[-1] == "block"
    assert STAGE["packing"](spark, docs, sf_dir).count() >= 1


def test_empty_table(spark, sf_dir):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = pinned(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
