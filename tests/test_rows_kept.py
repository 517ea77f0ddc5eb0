"""No operator loses rows for entities outside the catalog or for late attempts."""

import pytest
from pyspark.sql import functions as F

from termloom.operators import pairs, search, verdicts
from termloom.operators.classify import pair_features
from termloom.plans.linking import ngram_encoder


@pytest.fixture()
def catalog(spark):
    rows = [("a", "alpha", 0), ("b", "beta", 1), ("c", "gamma", 2), ("d", "delta", 3)]
    return spark.createDataFrame(rows, "entity_id string, rep_text string, ordinal long")


@pytest.fixture()
def mentions(spark):
    rows = [(str(i), f"m{i}", "c", e) for i, e in enumerate(["a", "b", "z", "z", "y", "d"])]
    return spark.createDataFrame(rows, "pmid string, mention string, cui string, mondo_id string")


def test_every_row_has_negatives(mentions, catalog):
    got = pairs.negative_pairs(mentions, catalog, k=3).collect()
    by_mention = {}
    for r in got:
        by_mention.setdefault(r["mention"], []).append(r["entity_id"])
    assert len(got) == 6 * 3 and len(by_mention) == 6
    assert all(len(set(e)) == 3 for e in by_mention.values())
    assert "a" not in by_mention["m0"] and "d" not in by_mention["m5"]


def test_row_outside_draws_from_all(spark, mentions, catalog):
    got = pairs.negative_pairs(mentions.where("mondo_id = 'z'"), catalog, k=4).collect()
    assert sorted(r["entity_id"] for r in got) == sorted("abcd" * 2)


def test_every_candidate_is_scored(spark, catalog):
    encode = ngram_encoder()
    queries = encode(spark.createDataFrame([(1, "alpha"), (2, "zeta")], "query_id long, t string"), "query_id", "t")
    vectors = encode(catalog, "entity_id", "rep_text")
    given = spark.createDataFrame(
        [(1, "a"), (1, "zeta"), (2, "zeta"), (2, "b"), (3, "a")], "query_id long, entity_id string"
    )
    scored = search.score_candidates(queries, vectors, given, encoder=encode).collect()
    score = {(r["query_id"], r["entity_id"]): r["score"] for r in scored}
    assert len(scored) == 5 and score[1, "a"] == pytest.approx(1) and score[2, "zeta"] == pytest.approx(1)
    assert score[3, "a"] is None
    plain = search.search_candidates(queries, vectors, given, 10).collect()
    last = {(r["query_id"], r["entity_id"]): r["rank"] for r in plain}
    assert len(plain) == 5 and last[1, "zeta"] == 2 and last[2, "zeta"] == 2


def test_every_pair_has_a_row_of_features(spark, catalog):
    encode = ngram_encoder()
    given = spark.createDataFrame([("alpha", "a"), ("alpha", "z")], "mention string, entity_id string")
    spoken = given.select("mention").distinct().withColumn("t", F.col("mention"))
    featured = pair_features(given, encode(spoken, "mention", "t"), encode(catalog, "entity_id", "rep_text"))
    assert sorted(r["features"] is None for r in featured.collect()) == [False, True]


def test_every_request_is_resolved(spark):
    rows = [
        (1, 3, True, "late"),
        (2, 0, False, "boom"), (2, 5, True, "fine"),
        (3, 0, False, "x"), (3, 1, False, "y"), (3, 2, False, "429"),
        (4, 0, False, "x"), (4, 1, True, "good"),
    ]
    attempts = spark.createDataFrame(rows, "request_id long, attempt int, ok boolean, text string")
    few = {r["request_id"]: r for r in verdicts.resolve_attempts(attempts).collect()}
    every = {r["request_id"]: r for r in verdicts.resolve_attempts(attempts, retries=None).collect()}
    assert set(few) == set(every) == {1, 2, 3, 4}
    assert (few[1]["text"], few[1]["attempts"]) == (verdicts.NO_RESPONSE, 0)
    assert few[2]["text"] == "ERROR: boom" and few[3]["text"] == verdicts.RETRIES_EXCEEDED
    assert (every[1]["text"], every[2]["text"], every[4]["text"]) == ("late", "fine", "good")
    assert (every[2]["attempts"], every[2]["wait_seconds"]) == (6, 1.0)
    assert few[3]["wait_seconds"] == 1 + 2 + 8
