"""All candidates under the shared-term classifier against scoring all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import shared_terms


def brute(mentions, entities, weights, k):
    out = {}
    for m, m_terms, m_own in mentions:
        scored = []
        for e, e_terms, e_own in entities:
            logit = m_own + e_own
            for t in sorted(set(m_terms or ()) & set(e_terms or ())):
                logit += weights.get(t, 0.0)
            scored.append((-logit, e))
        for rank, (logit, e) in enumerate(sorted(scored)[:k], 1):
            out[m, rank] = (e, -logit)
    return out


def ranked(spark, mentions, entities, weights, k):
    m = spark.createDataFrame(mentions, "mention string, terms array<string>, own double")
    e = spark.createDataFrame(entities, "entity_id long, terms array<string>, own double")
    w = spark.createDataFrame(list(weights.items()), "term string, weight double")
    found = shared_terms.rank_by_shared_terms(m, e, w, k).collect()
    return {(r.mention, r["rank"]): (r.entity_id, r.logit) for r in found}


def example(seed, n_entities=150, own=(-2, -1, 0, 1)):
    draw = random.Random(seed)
    terms = [f"t{i}" for i in range(30)]
    weights = {t: draw.choice([-1.5, -0.25, 0.0, 0.5, 1.0, 2.0]) for t in terms[:-3]}

    def some():
        return draw.sample(terms, min(len(terms), int(draw.expovariate(0.25))))

    mentions = [(f"m{i}", some(), draw.choice((0.0, 0.5))) for i in range(12)]
    mentions += [("none", None, 0.0), ("empty", [], 1.0), ("unknown", ["x", "y"], 0.0)]
    entities = [(i, some(), float(draw.choice(own))) for i in range(n_entities)]
    return mentions, entities + [(n_entities, None, 0.0)], weights


@pytest.mark.parametrize("seed, own", [(1, (-2, -1, 0, 1)), (2, (0,))])
def test_every_entity_competes(spark, monkeypatch, seed, own):
    for name, size in (("BLOCK", 4), ("SHARD", 16), ("FIRST", 2), ("GROWTH", 3), ("PART", 5)):
        monkeypatch.setattr(shared_terms, name, size)
    mentions, entities, weights = example(seed, own=own)
    assert ranked(spark, mentions, entities, weights, 4) == brute(mentions, entities, weights, 4)


def test_entities_at_the_top_that_share_unwanted_terms(spark, monkeypatch):
    """The top of the catalog is pulled down, so the search goes on below it."""
    monkeypatch.setattr(shared_terms, "FIRST", 2)
    mentions = [("m", ["bad"], 0.0)]
    entities = [(i, ["bad"] if i < 40 else ["other"], 5.0 - i / 64) for i in range(60)]
    expected = brute(mentions, entities, {"bad": -9.0}, 3)
    assert ranked(spark, mentions, entities, {"bad": -9.0}, 3) == expected
    assert expected["m", 1][0] == 40


def test_fewer_entities_than_asked_for_and_none(spark):
    mentions = [("m", ["a"], 0.0), ("n", ["b"], 0.0)]
    entities = [(1, ["a"], 0.0), (2, ["b"], 0.0)]
    assert ranked(spark, mentions, entities, {"a": 1.0}, 5) == brute(mentions, entities, {"a": 1.0}, 5)
    assert ranked(spark, mentions, [], {"a": 1.0}, 5) == {}
    assert ranked(spark, [], entities, {"a": 1.0}, 5) == {}


def test_only_part_of_a_long_list_is_read(spark):
    """A frequent term of little weight: the floor keeps most of its postings out."""
    entities = [(i, ["the", f"rare{i}"], -i / 1024) for i in range(2000)]
    e = spark.createDataFrame(entities, "entity_id long, terms array<string>, own double")
    mentions = [(f"m{i}", ["the", f"rare{i}"], 0.0) for i in range(1500, 1510)]
    m = spark.createDataFrame(mentions, "mention string, terms array<string>, own double")
    weights = {"the": 0.125} | {f"rare{i}": 4.0 for i in range(2000)}
    w = spark.createDataFrame(list(weights.items()), "term string, weight double")
    postings = shared_terms._postings(e, w)
    cells = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(v).alias("weight")) for t, v in (("the", 0.125),)])
    floors = m.select("mention", "own", cells.alias("cells"), F.lit(0.0).alias("floor"))
    read = shared_terms._reached(floors, postings).groupBy("mention").count().collect()
    assert all(r["count"] <= 130 for r in read)  # own >= -0.125
    assert ranked(spark, mentions, entities, weights, 3) == brute(mentions, entities, weights, 3)


def test_fitted_classifier_over_all_candidates(spark):
    words = ["heart", "attack", "acute", "lung", "chronic", "pain", "left", "of"]
    draw = random.Random(7)
    catalog = [(i, " ".join(draw.sample(words, 3))) for i in range(25)]
    pairs = []
    for _ in range(120):
        i, text = draw.choice(catalog)
        mention = " ".join(draw.sample(words, draw.randint(1, 4)))
        pairs.append((mention, text, float(len(set(mention.split()) & set(text.split())) >= 2)))
    train = spark.createDataFrame(pairs, "mention string, rep_text string, label double")
    model = shared_terms.fit_shared_term_classifier(train, max_iter=20)
    entities = spark.createDataFrame(catalog, "entity_id long, rep_text string")
    mentions = train.select("mention")
    found = shared_terms.rank_all_candidates(model, mentions, entities, 4).collect()
    every = mentions.distinct().join(entities, F.lit(True))
    want = {(r.mention, r.entity_id): r.score for r in shared_terms.score_given_pairs(model, every).collect()}
    assert len(found) == 4 * mentions.distinct().count()
    for r in found:
        assert abs(r.score - want[r.mention, r.entity_id]) < 1e-9
    for mention in {r.mention for r in found}:
        best = sorted((v for (m, _), v in want.items() if m == mention), reverse=True)[:4]
        mine = sorted((r.score for r in found if r.mention == mention), reverse=True)
        assert all(abs(a - b) < 1e-9 for a, b in zip(best, mine, strict=True))
