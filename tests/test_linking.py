"""Search, encoding, metrics, pairs and binary scores on handmade rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.functions.vectors import l2_normalise
from termloom.operators import catalog as cat
from termloom.operators import classify, evaluate, pairs
from termloom.operators.encode import encode_ngrams, encode_with, ngram_matrix
from termloom.operators.ranking import rank_of_truth, rank_verdicts, ranked_lists, top_k
from termloom.operators.search import search, search_candidates, search_mentions, search_one
from termloom.plans.linking import VectorLinker, vector_catalog
from termloom.plans.training import train_pair_classifier
from termloom.sources import sinks


def vectors(spark, matrix, name):
    data = [(f"{name}{i:04d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(data, f"{name}_id string, embedding array<double>")


def brute_force(q, e, k):
    hits = set()
    for i, row in enumerate(q):
        scored = [(-sum(a * b for a, b in zip(row, v)), f"entity{j:04d}") for j, v in enumerate(e)]
        for rank, (score, entity) in enumerate(sorted(scored)[:k], 1):
            hits.add((f"query{i:04d}", entity, -score, rank))
    return hits


@pytest.mark.parametrize("options", [{}, {"block_rows": 40}, {"block_rows": 7}])
def test_search_is_exact_with_ties(spark, options):
    """Small whole numbers give many equal scores, and copies give equal vectors."""
    rng = np.random.default_rng(0)
    e = rng.integers(-2, 3, (90, 5))
    e[30:60] = e[3]
    q = np.vstack([rng.integers(-2, 3, (59, 5)), np.zeros((1, 5))])
    queries = vectors(spark, q, "query")
    catalog = vectors(spark, e, "entity")
    if options:
        options = {**options, "broadcast_bytes": 0}
    hits = search(queries, catalog, 10, **options)
    assert {tuple(r) for r in hits.collect()} == brute_force(q, e, 10)


def test_search_close_scores(spark):
    """Scores that differ below float32 precision keep their double order."""
    base = np.array([0.6, 0.8])
    e = np.array([base + np.array([i * 1e-12, 0.0]) for i in range(50)])
    catalog, query = vectors(spark, e, "entity"), vectors(spark, [base], "query")
    for limit in (0, 1 << 20):
        hits = search(query, catalog, 3, broadcast_bytes=limit).orderBy("rank").collect()
        assert [r.entity_id for r in hits] == ["entity0049", "entity0048", "entity0047"]


def test_search_of_very_long_and_very_short_vectors(spark):
    e = [[1e30, 0], [1e-30, 1e-30], [0, 2e30], [-1e30, 1]]
    q = [[1e30, 1e30], [1e-30, 0]]
    hits = search(vectors(spark, q, "query"), vectors(spark, e, "entity"), 3)
    assert {tuple(r) for r in hits.collect()} == brute_force(q, e, 3)


def test_search_few_entries_null_and_single(spark):
    catalog = vectors(spark, [[1, 0], [0, 1]], "entity")
    queries = vectors(spark, [[1, 0]], "query").union(
        spark.createDataFrame([("none", None)], "query_id string, embedding array<double>")
    )
    assert search(queries, catalog, 5).count() == 2
    single = [tuple(r) for r in search_one(catalog, [1.0, 0.0], 5).collect()]
    assert single == [("entity0000", 1.0), ("entity0001", 0.0)]
    for limit in (0, 1 << 20):
        assert search(queries.where("false"), catalog, 5, broadcast_bytes=limit).count() == 0
        assert search(queries, catalog.where("false"), 5, broadcast_bytes=limit).count() == 0


def test_small_catalog_is_searched_without_a_shuffle(spark):
    catalog = vectors(spark, [[1, 0], [0, 1]], "entity")
    plan = search(catalog.withColumnRenamed("entity_id", "query_id"), catalog, 1)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "Exchange" not in text


def test_search_rejects_bad_vectors(spark):
    ragged = spark.createDataFrame(
        [("a", [1.0, 2.0, 3.0]), ("b", [1.0])], "entity_id string, embedding array<double>"
    )
    with pytest.raises(Exception, match="differ in length"):
        search(vectors(spark, [[1, 0]], "query"), ragged, 1).collect()


def test_candidates_restrict_the_search(spark, rows):
    catalog = vectors(spark, [[1, 0], [0, 1], [1, 1]], "entity")
    queries = vectors(spark, [[2, 1]], "query")
    wanted = spark.createDataFrame(
        [("query0000", "entity0000"), ("query0000", "entity0001"), ("query0000", "entity0001")],
        "query_id string, entity_id string",
    )
    got = rows(search_candidates(queries, catalog, wanted, 5), "entity_id", "score", "rank")
    assert got == [("entity0000", 2.0, 1), ("entity0001", 1.0, 2)]


def test_repeated_mentions_share_one_search(spark, rows):
    catalog = vectors(spark, [[1, 0], [0, 1]], "entity")
    table = spark.createDataFrame([("a",), ("a",), ("b",)], "mention string")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "mention string, embedding array<double>")
    hits = search_mentions(table, vecs, catalog, 1)
    assert rows(hits, "mention", "entity_id") == [("a", "entity0000"), ("b", "entity0001")]
    assert evaluate.fan_out(table, hits).count() == 3


def test_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(l2_normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def ngrams(text, dim, n=3):
    counts = {}
    for word in text.lower().split():
        framed = f"<{word}>"
        for i in range(max(len(framed) - n + 1, 1)):
            h = 0
            for c in (list(framed[i : i + n]) + [None] * n)[:n]:
                h = (h * 1000003 + (ord(c) if c else 0)) % 2147483647
            counts[h % dim] = counts.get(h % dim, 0) + 1
    return counts


@pytest.mark.parametrize("n", [2, 3, 4])
def test_encoder_reads_whole_texts(spark, n):
    texts = ["Flu", "é ü x", "", "   ", "word " * 500 + "last", "a\tb\nc"]
    counts = ngram_matrix([t.lower() for t in texts], 16, n, None)
    got = [{b: c for b, c in enumerate(row) if c} for row in counts.tolist()]
    assert got == [ngrams(t, 16, n) for t in texts]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "id int, text string")
    encoded = {r.id: r.embedding for r in encode_ngrams(df, "id", "text", 16, n).collect()}
    assert encoded[2] == encoded[9] == [0.0] * 16
    assert math.isclose(sum(x * x for x in encoded[4]), 1.0)
    assert encoded[0] == pytest.approx((counts[0] / np.linalg.norm(counts[0])).tolist())
    cut = ngram_matrix(["a b", "\u0130x"], 16, n, 1)
    assert {b: c for b, c in enumerate(cut[0]) if c} == ngrams("a", 16, n)


def test_encoder_moves_no_rows(spark):
    df = spark.createDataFrame([(1, "some text")], "id int, text string")
    plan = encode_ngrams(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_encoder_hook_runs_in_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            assert len(texts) <= 4
            sizes.add(1)
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    df = spark.range(10).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t")).coalesce(1)
    got = {r.id: r.embedding for r in encode_with(df, "id", "t", load, 4).collect()}
    assert sizes.value == 3
    assert got[3] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])


def test_encoder_is_loaded_once_per_worker(spark, tmp_path):
    """Many tasks, texts of all lengths: a load per worker, batches of like lengths, own order."""
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass

        def encode(texts):
            lengths = [len(t or "") for t in texts]
            assert max(lengths) - min(lengths) <= 40
            return np.array([[n, 1.0] for n in lengths])

        return encode

    text = F.when(F.col("id") % 50 != 0, F.repeat(F.lit("x"), (F.col("id") * 37 % 200).cast("int")))
    df = spark.range(0, 2000, 1, 40).select("id", text.alias("t"))
    got = {r.id: r.embedding for r in encode_with(df, "id", "t", load, 8).collect()}
    for i in range(2000):
        n = 0 if i % 50 == 0 else i * 37 % 200
        assert got[i] == pytest.approx([n / math.hypot(n, 1), 1 / math.hypot(n, 1)])
    workers = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert len(workers) == len(set(workers)) < 40


# --- metrics -----------------------------------------------------------------------------


def test_hits_and_mrr(spark):
    truth = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "query_id int, entity_id string"
    )
    places = {1: 1, 2: 3, 3: 10, 4: 11}
    right = {1: "a", 2: "b", 3: "c", 4: "d"}
    ranked = spark.createDataFrame(
        [(q, right[q] if r == places[q] else f"x{r}", r) for q in places for r in range(1, 12)],
        "query_id int, entity_id string, rank int",
    )
    got = {r.metric: r.value for r in evaluate.evaluate_hits_and_mrr(truth, ranked.where("rank <= 10")).collect()}
    assert got == pytest.approx(
        {"Hits@1": 0.2, "Hits@3": 0.4, "Hits@5": 0.4, "Hits@10": 0.6, "MRR": (1 + 1 / 3 + 0.1) / 5}
    )
    nothing = evaluate.evaluate_hits_and_mrr(truth.where("false"), ranked).collect()
    assert [r.value for r in nothing] == [None] * 5
    assert rank_of_truth(ranked, truth).where("query_id = 5").first()["rank"] is None


def test_metrics_by_mention_weigh_rows(spark):
    """One mention, two truths, unequal row counts."""
    table = spark.createDataFrame([("m", "a")] * 3 + [("m", "b")] + [("n", "a")], "mention string, entity_id string")
    ranked = spark.createDataFrame(
        [("m", "a", 1), ("m", "b", 2)], "mention string, entity_id string, rank int"
    )
    got = {r.metric: r.value for r in evaluate.evaluate_by_mention(table, ranked).collect()}
    assert got == pytest.approx({"Hits@1": 0.6, "Hits@5": 0.8, "Hits@10": 0.8, "MRR": 3.5 / 5})


def test_comparison_table(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("a", "MRR", 0.5), ("a", "Hits@10", 1.0), ("b", "Hits@1", 0.25)],
        "model string, metric string, value double",
    )
    table = evaluate.comparison_table(metrics)
    assert table.columns == ["model", "Hits@1", "Hits@10", "MRR"]
    assert sorted(tuple(r) for r in table.collect()) == [("a", 0.0, 1.0, 0.5), ("b", 0.25, 0.0, 0.0)]
    document = sinks.results_document(metrics).first()[0]
    assert document == '{"a":{"Hits@10":1.0,"MRR":0.5},"b":{"Hits@1":0.25}}'


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(10000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("query_id"),
        F.col("id").alias("entity_id"),
        (F.col("id") % 11).cast("double").alias("score"),
    )
    ranked = top_k(df, 4)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    best = sorted(
        (-(i % 11), i) for i in range(10000) if i % 3 == 0 or i % 50 == 0
    )[:4]
    hits = ranked.where("query_id = 0").orderBy("rank").collect()
    assert [r.entity_id for r in hits] == [i for _, i in best]
    lists = ranked_lists(ranked).where("query_id = 0").first().hits
    assert [h["rank"] for h in lists] == [1, 2, 3, 4]


def test_verdict_ranking_keeps_candidate_order(spark):
    df = spark.createDataFrame(
        [(1, "c", 0, False), (1, "a", 1, True), (1, "b", 2, None), (1, "d", 3, True)],
        "query_id int, entity_id string, ordinal int, is_equivalent boolean",
    )
    order = [r.entity_id for r in rank_verdicts(df, 4).orderBy("rank").collect()]
    assert order == ["a", "d", "c", "b"]


# --- pairs -------------------------------------------------------------------------------


@pytest.mark.parametrize("entities", [1, 2, 3, 4, 20])
def test_negatives(spark, entities):
    table = spark.range(400).select(
        F.col("id").cast("string").alias("pmid"),
        F.col("id").cast("string").alias("mention"),
        F.lit("c").alias("cui"),
        F.concat(F.lit("E"), F.col("id") % entities).alias("mondo_id"),
    )
    catalog = cat.build_catalog(table, "shortest")
    drawn = pairs.negative_pairs(table, catalog)
    by_row = {}
    for r in drawn.collect():
        by_row.setdefault(r.mention, []).append(r.entity_id)
    expected = min(3, entities - 1)
    assert len(by_row) == (400 if expected else 0)
    for mention, chosen in by_row.items():
        assert len(set(chosen)) == len(chosen) == expected
        assert f"E{int(mention) % entities}" not in chosen
    again = pairs.negative_pairs(table.repartition(5), catalog)
    assert again.exceptAll(drawn).isEmpty()


def test_negatives_are_uniform(spark):
    table = spark.range(20000).select(
        *[F.col("id").cast("string").alias(c) for c in ("pmid", "mention", "cui")],
        F.concat(F.lit("E"), F.col("id") % 10).alias("mondo_id"),
    )
    counts = pairs.negative_pairs(table, cat.build_catalog(table)).groupBy("entity_id").count()
    for r in counts.collect():
        assert abs(r["count"] - 6000) < 400


def test_positive_pairs_keep_duplicates(spark, rows):
    table = spark.createDataFrame([("flu", "E1"), ("flu", "E1"), ("cold", "E2")], "mention string, mondo_id string")
    catalog = spark.createDataFrame([("E1", "flu")], "entity_id string, rep_text string")
    got = rows(pairs.positive_pairs(table, catalog), "input", "label")
    assert got == [("cold [SEP] E2", 1.0), ("flu [SEP] flu", 1.0), ("flu [SEP] flu", 1.0)]


# --- binary scores -----------------------------------------------------------------------


def scored(spark, data):
    return spark.createDataFrame(data, "score double, label double")


def brute_auc(data):
    positive = [s for s, y in data if y == 1]
    negative = [s for s, y in data if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(positive, negative))
    return wins / (len(positive) * len(negative))


def test_auc_and_curve(spark):
    rng = np.random.default_rng(1)
    data = [(float(s), float(y)) for s, y in zip(rng.integers(0, 9, 200) / 9, rng.integers(0, 2, 200))]
    df = scored(spark, data)
    auc = classify.roc_auc(df).first().auc
    assert auc == pytest.approx(brute_auc(data))
    flipped = classify.roc_auc(df.withColumn("score", -F.col("score"))).first().auc
    assert auc + flipped == pytest.approx(1.0)
    points = sorted((r.fpr, r.tpr) for r in classify.roc_curve(df).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert len(points) == len({s for s, _ in data}) + 1
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(auc)


def test_auc_of_one_class_is_null(spark):
    df = scored(spark, [(0.1, 1.0), (0.9, 1.0)])
    assert classify.roc_auc(df).first().auc is None
    assert {r.fpr for r in classify.roc_curve(df).collect()} == {None}


def test_report_threshold_and_missing_class(spark):
    df = scored(spark, [(0.5, 1.0), (0.51, 1.0), (0.2, 0.0), (0.9, 0.0)])
    report = {r["row"]: r for r in classify.classification_report(df).collect()}
    assert report["1.0"].precision == 0.5 and report["1.0"].recall == 0.5
    assert report["accuracy"].f1 == 0.5 and report["accuracy"].support == 4
    lone = {r["row"]: r for r in classify.classification_report(scored(spark, [(0.1, 1.0)])).collect()}
    assert lone["0.0"].support == 0 and lone["0.0"].recall == 0.0 and lone["1.0"].precision == 0.0
    assert classify.classification_report(df.where("false")).count() == 0


def test_classifier_links(spark):
    """Misspelt names of distinct entities: the fitted ranker finds their entity."""
    names = ["diabetes", "influenza", "asthma", "malaria", "rabies", "psoriasis", "epilepsy", "measles"]
    data = [
        (str(i * 10 + j), text, f"C{i}", f"E{i}")
        for i, name in enumerate(names)
        for j, text in enumerate([name, name + "s", name.upper(), "acute " + name, name + " type"])
    ]
    table = spark.createDataFrame(data, "pmid string, mention string, cui string, mondo_id string")
    out = train_pair_classifier(table, table)
    metrics = {r.metric: r.value for r in out["linker"].evaluate(table, (1, 3)).collect()}
    assert metrics["Hits@1"] > 0.8
    assert out["auc"].first().auc > 0.9
    predicted = out["linker"].predict_batch(table, 3)
    given = out["linker"].score_candidates(predicted.select("mention", "entity_id"))
    same = predicted.join(given.withColumnRenamed("score", "s"), ["mention", "entity_id"])
    assert same.count() == predicted.count()
    assert same.where("abs(score - s) > 1e-9").count() == 0


def test_vector_linker(spark):
    table = spark.createDataFrame(
        [("1", "influenza", "E1"), ("2", "Influenza", "E1"), ("3", "asthma", "E2")],
        "pmid string, mention string, mondo_id string",
    )
    linker = VectorLinker(vector_catalog(table))
    assert linker.search("influensa", 1).first().entity_id == "E1"
    metrics = {r.metric: r.value for r in linker.evaluate(table).collect()}
    assert metrics["Hits@1"] == 1.0
    info = sinks.catalog_metadata(linker.catalog, "trigram", None, "mode").first()
    assert (info.embedding_dim, info.num_entities) == (64, 2)


def test_equal_pairs_are_fitted_once_with_their_count(spark):
    """The fit on counted rows is the fit on all rows, the penalty included."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    cells = [([1.0, 2.0], 1.0, 7), ([1.0, 2.0], 0.0, 2), ([0.5, -1.0], 0.0, 9), ([3.0, 0.0], 1.0, 1)]
    few = spark.createDataFrame(cells, "features array<double>, label double, n long")
    every = few.select("features", "label", F.explode(F.expr("sequence(1L, n)"))).drop("col")
    plain = LogisticRegression(featuresCol="x", regParam=0.3, maxIter=100, tol=1e-10).fit(
        every.select(array_to_vector("features").alias("x"), "label")
    )
    for rows, count in ((every, None), (few, "n")):
        model = classify.fit_vector_classifier(rows, 100, 0.3, count)
        assert list(model.coefficients) == pytest.approx(list(plain.coefficients), abs=1e-4)
        assert model.intercept == pytest.approx(plain.intercept, abs=1e-4)
    counted, _ = classify.counted_rows(every, ["features", "label"], 0.3)
    assert counted.count() == 4 and counted.agg(F.sum("_n")).first()[0] == 19


def test_training_holds_different_pairs_only(spark):
    data = [(str(i), f"m{i % 3}", "C", f"E{i % 3}") for i in range(300)]
    table = spark.createDataFrame(data, "pmid string, mention string, cui string, mondo_id string")
    out = train_pair_classifier(table, table)
    assert out["training"].count() <= 9 and out["training"].agg(F.sum("n")).first()[0] == 900
    assert out["scored_dev"].count() == 900 and out["scored_dev"].where("score is null").count() == 0
