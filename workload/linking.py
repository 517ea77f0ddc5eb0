"""Vectors, search, ranking, evaluation and the pair classifier."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from termloom.functions.vectors import l2_normalise
from termloom.operators import catalog as cat
from termloom.operators import classify, evaluate, pairs, shared_terms
from termloom.operators.encode import encode_with
from termloom.operators.pivots import PivotIndex
from termloom.operators.ranking import rank_of_truth, ranked_lists, top_k
from termloom.operators.search import search, search_candidates, search_mentions, search_one
from termloom.plans.linking import VectorLinker, evaluate_vectors, ngram_encoder, vector_catalog
from termloom.plans.evaluation import evaluate_rankers
from termloom.plans.training import PairClassifierLinker, score_features, train_pair_classifier
from termloom.operators.ordering import exact_split
from termloom.plans.preparation import ROW_COLUMNS
from termloom.session import pinned
from workload import standins as s
from workload.preparation import _TWO_MODELS, two_models
from workload.registry import query

_RANKED = s.ranked_sql()
_TRUTH = _RANKED + f""", truth AS (
  SELECT q.vec_id AS query_id, CAST({s.VECTOR_ENTITY} AS BIGINT) AS entity_id, r.rank
  FROM embeddings q LEFT JOIN ranked r
  ON r.query_id = q.vec_id AND r.entity_id = r.own AND r.rank <= 10)"""
_ALL_PAIRS = """pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS entity_id, list_dot_product(
    CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a, embeddings b),
hits AS (SELECT *, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, entity_id) AS INTEGER) AS rank FROM pairs)"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns or ("score",)})


class SetWeights:
    """A classifier whose weights are set, so that its values can be compared."""

    coefficients = [(i % 7 - 2) / 4.0 for i in range(1, 65)]
    intercept = -1.0


# --- search ------------------------------------------------------------------------------


@query(
    "v2_l2_normalise",
    """WITH scaled AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]),
        lambda x: x * (vec_id + 1)) AS v FROM embeddings),
      cells AS (SELECT vec_id, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM scaled)
    SELECT vec_id, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM cells""",
)
def v2(spark, sf):
    vectors = s.table(spark, sf, "embeddings")
    longer = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    cells = vectors.select("vec_id", l2_normalise(longer).alias("v")).select(
        "vec_id", F.posexplode("v").alias("i", "x")
    )
    return _rounded(cells.withColumn("i", F.col("i").cast("long")), "x")


@query(
    "v3_search_batch",
    f"WITH {_ALL_PAIRS} SELECT query_id, entity_id, round(score, 6) AS score, rank "
    "FROM hits WHERE rank <= 10",
)
def v3(spark, sf):
    """Ten best of all vectors for every vector."""
    vectors = s.table(spark, sf, "embeddings")
    return _rounded(search(vectors, vectors, 10, query="vec_id", entity="vec_id"))


@query(
    "v3_search_small_blocks",
    f"WITH {_ALL_PAIRS} SELECT query_id, entity_id, round(score, 6) AS score, rank "
    "FROM hits WHERE rank <= 10",
)
def v3_blocks(spark, sf):
    """The same search over several blocks on each side."""
    vectors = s.table(spark, sf, "embeddings")
    blocks = {"block_rows": 200, "broadcast_bytes": 0}
    return _rounded(search(vectors, vectors, 10, query="vec_id", entity="vec_id", **blocks))


@query(
    "v3_search_pivots",
    f"WITH {_ALL_PAIRS} SELECT query_id, entity_id, round(score, 6) AS score, rank "
    "FROM hits WHERE rank <= 10",
)
def v3_pivots(spark, sf):
    """The same search over many small blocks around pivots; blocks are skipped by their bound."""
    vectors = s.table(spark, sf, "embeddings")
    index = PivotIndex(vectors, "vec_id", block_rows=16)
    return _rounded(index.search(vectors, 10, query="vec_id"))


@query(
    "v3_search_single",
    f"WITH {_ALL_PAIRS} SELECT entity_id, round(score, 6) AS score FROM hits "
    "WHERE rank <= 10 AND query_id = (SELECT min(vec_id) FROM embeddings)",
)
def v3_single(spark, sf):
    vectors = s.table(spark, sf, "embeddings")
    first = vectors.agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]
    return _rounded(search_one(vectors, first, 10, entity="vec_id"))


@query(
    "j3_score_all_pairs",
    f"WITH {_RANKED} SELECT query_id, entity_id, round(score, 6) AS score FROM ranked WHERE rank <= 10",
)
def j3(spark, sf):
    """Every query is scored against every prototype; the ten best come out."""
    queries, prototypes = s.queries_and_prototypes(spark, sf)
    return _rounded(search(queries, prototypes, 10)).drop("rank")


@query(
    "j4_given_candidates",
    f"""WITH {_RANKED}, owners AS (SELECT vec_id AS query_id, {s.VECTOR_ENTITY} AS own FROM embeddings),
      asked AS (SELECT query_id, own AS entity_id FROM owners
        UNION ALL SELECT query_id, own // 100 * 100 + (own + 1) % 10 FROM owners)
    SELECT query_id, entity_id, round(score, 6) AS score, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY score DESC NULLS LAST, entity_id) AS INTEGER) AS rank
    FROM asked LEFT JOIN ranked USING (query_id, entity_id)""",
)
def j4(spark, sf):
    queries, prototypes = s.queries_and_prototypes(spark, sf)
    candidates = queries.select(
        "query_id", F.explode(F.array("own", F.expr("own div 100 * 100 + (own + 1) % 10"))).alias("entity_id")
    )
    return _rounded(search_candidates(queries, prototypes, candidates, 10))


_OUTSIDE = (
    s.MODE_CATALOG
    + """, known AS (SELECT entity_id, rep_text FROM catalog WHERE ordinal % 3 <> 0),
spoken AS (SELECT DISTINCT mention FROM mentions),
given AS (SELECT DISTINCT mention, mondo_id AS entity_id FROM mentions),
named AS (SELECT DISTINCT entity_id, coalesce(rep_text, entity_id) AS rep_text
  FROM given LEFT JOIN known USING (entity_id)), """
    + s.encoded("spoken", "mention", "mention", "mv")
    + ", "
    + s.encoded("named", "entity_id", "rep_text", "ev")
    + """, scored AS (SELECT mention, entity_id, list_sum(list_transform(range(1, 65),
      lambda i: m.vec[i] * e.vec[i])) AS score
    FROM given JOIN mv_vec m ON m.k = mention JOIN ev_vec e ON e.k = entity_id)"""
)


@query(
    "j4_candidates_outside_catalog",
    f"""WITH {_OUTSIDE} SELECT mention, entity_id, round(score, 6) AS score, CAST(row_number() OVER (
      PARTITION BY mention ORDER BY score DESC, entity_id) AS INTEGER) AS rank FROM scored""",
)
def j4_outside(spark, sf):
    """True pairs as candidates of a catalog that lacks every third entity."""
    rows, linker = _linker(spark, sf)
    part = linker.catalog.where("ordinal % 3 <> 0")
    pairs_given = rows.select(F.col("mention").alias("query_id"), F.col("mondo_id").alias("entity_id"))
    vectors = linker.encode_mentions(rows).withColumnRenamed("mention", "query_id")
    hits = search_candidates(vectors, part, pairs_given, 1 << 30, ngram_encoder())
    return _rounded(hits.withColumnRenamed("query_id", "mention"))


@query("j5_truth_attach", f"WITH {_TRUTH} SELECT query_id, entity_id, rank FROM truth")
def j5(spark, sf):
    queries, prototypes = s.queries_and_prototypes(spark, sf)
    return rank_of_truth(search(queries, prototypes, 10), s.truth(spark, sf))


@query(
    "p6_valid_hits",
    f"WITH {_RANKED} SELECT query_id, count(*) AS hits FROM ranked GROUP BY query_id",
)
def p6(spark, sf):
    """Fewer entries than k: only real hits come out."""
    queries, prototypes = s.queries_and_prototypes(spark, sf)
    hits = search(queries, prototypes, 1000)
    return hits.groupBy("query_id").agg(F.count("entity_id").alias("hits"))


_MENTION_HITS = (
    s.MODE_CATALOG
    + ", spoken AS (SELECT DISTINCT mention FROM mentions), "
    + s.encoded("spoken", "mention", "mention", "mv")
    + ", "
    + s.encoded("catalog", "entity_id", "rep_text", "ev")
    + """, mention_hits AS (
  SELECT mention, entity_id, score, CAST(row_number() OVER (
    PARTITION BY mention ORDER BY score DESC, entity_id) AS INTEGER) AS rank
  FROM (SELECT m.k AS mention, e.k AS entity_id, list_sum(list_transform(
      range(1, 65), lambda i: m.vec[i] * e.vec[i])) AS score FROM mv_vec m, ev_vec e))"""
)


def _linker(spark, sf):
    rows = pinned(s.mentions(spark, sf))
    return rows, VectorLinker(pinned(vector_catalog(rows)))


@query(
    "v5_predict_mentions",
    f"WITH {_MENTION_HITS} SELECT mention, entity_id, round(score, 6) AS score, rank "
    "FROM mention_hits WHERE rank <= 10",
)
def v5(spark, sf):
    rows, linker = _linker(spark, sf)
    return _rounded(linker.predict_batch(rows, 10))


@query(
    "j6_fan_out",
    f"WITH {_MENTION_HITS} SELECT pmid, mention, cui, entity_id, rank "
    "FROM mentions JOIN mention_hits USING (mention) WHERE rank <= 3",
)
def j6(spark, sf):
    rows, linker = _linker(spark, sf)
    return linker.predict_rows(rows, 3).select("pmid", "mention", "cui", "entity_id", "rank")


@query(
    "v1_encoder_hook",
    """WITH points AS (SELECT doc_id, unicode(unnest(string_split(text, ''))) % 32 AS bucket FROM documents),
      cells AS (SELECT doc_id, bucket, count(*) AS n FROM points GROUP BY ALL)
    SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM cells""",
)
def v1_hook(spark, sf):
    """A user's encoder, run batch-wise: here code point counts as a stand-in model."""

    def load():
        import numpy as np

        def encode(texts):
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
            cell = np.repeat(np.arange(len(texts)) * 32, lengths) + points % 32
            return np.bincount(cell, minlength=32 * len(texts)).reshape(-1, 32).astype(float)

        return encode

    vectors = encode_with(s.table(spark, sf, "documents"), "doc_id", "text", load)
    cells = vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "x"))
    kept = cells.where("x <> 0").withColumn("bucket", F.col("bucket").cast("long"))
    return _rounded(kept, "x")


# --- ranking and evaluation --------------------------------------------------------------


@query(
    "o1_top_k",
    """SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC,
        l_orderkey, l_partkey, l_linenumber) AS INTEGER) AS rank FROM lineitem) WHERE rank <= 10""",
)
def o1(spark, sf):
    items = s.table(spark, sf, "lineitem")
    ties = ["l_orderkey", "l_partkey", "l_linenumber"]
    ranked = top_k(items, 10, "l_suppkey", "l_extendedprice", ties)
    return ranked.select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query(
    "o1_ranked_lists",
    f"WITH {_RANKED} SELECT query_id, string_agg(entity_id, ',' ORDER BY rank) AS hits "
    "FROM ranked WHERE rank <= 10 GROUP BY query_id",
)
def o1_lists(spark, sf):
    queries, prototypes = s.queries_and_prototypes(spark, sf)
    lists = ranked_lists(search(queries, prototypes, 10))
    ids = F.transform("hits", lambda h: h["entity_id"].cast("string"))
    return lists.select("query_id", F.array_join(ids, ",").alias("hits"))


@query("o6_rank_of_truth", f"WITH {_TRUTH} SELECT rank, count(*) AS n FROM truth GROUP BY rank")
def o6(spark, sf):
    queries, prototypes = s.queries_and_prototypes(spark, sf)
    ranks = rank_of_truth(search(queries, prototypes, 10), s.truth(spark, sf))
    return ranks.groupBy("rank").agg(F.count("*").alias("n"))


@query("a7_hits_at_k", f"WITH {_TRUTH} SELECT * FROM ({s.metrics_sql('truth')})")
def a7(spark, sf):
    queries, prototypes = s.queries_and_prototypes(spark, sf)
    return _rounded(evaluate_vectors(queries, prototypes, s.truth(spark, sf)), "value")


@query(
    "a8_mrr",
    f"""WITH {_ALL_PAIRS}, firsts AS (
      SELECT query_id, min(CASE WHEN e.label = q.label AND query_id <> entity_id THEN rank END) AS rank
      FROM hits JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = entity_id
      WHERE rank <= 10 GROUP BY query_id)
    SELECT 'MRR' AS metric, round(avg(coalesce(1 / rank, 0)), 6) AS value FROM firsts""",
)
def a8(spark, sf):
    """MRR at 10 of the first other vector that has the query's label."""
    vectors = s.table(spark, sf, "embeddings")
    hits = search(vectors, vectors, 10, query="vec_id", entity="vec_id")
    labels = vectors.select(F.col("vec_id").alias("entity_id"), "label")
    named = hits.where("query_id <> entity_id").join(labels, "entity_id")
    ranked = named.select("query_id", F.col("label").alias("entity_id"), "rank")
    truth = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("entity_id"))
    metrics = evaluate.evaluate_hits_and_mrr(truth, ranked)
    return _rounded(metrics.where("metric = 'MRR'"), "value")


@query(
    "a9_metrics_by_mention",
    f"""WITH {_MENTION_HITS}, ranks AS (
      SELECT m.mention, h.rank FROM mentions m LEFT JOIN mention_hits h
      ON h.mention = m.mention AND h.entity_id = m.mondo_id AND h.rank <= 10)
    SELECT * FROM ({s.metrics_sql('ranks', (1, 5, 10))})""",
)
def a9(spark, sf):
    rows, linker = _linker(spark, sf)
    return _rounded(linker.evaluate(rows), "value")


@query("u2_metric_names", f"WITH {_TWO_MODELS} SELECT DISTINCT metric FROM metrics")
def u2(spark, sf):
    return evaluate.metric_names(two_models(spark, sf))


@query("u3_append_models", f"WITH {_TWO_MODELS} SELECT model, metric, value FROM metrics")
def u3(spark, sf):
    return two_models(spark, sf)


@query(
    "r1_comparison_table",
    f"""WITH {_TWO_MODELS} SELECT model,
      max(CASE WHEN metric = 'Hits@1' THEN value ELSE 0 END) AS "Hits@1",
      max(CASE WHEN metric = 'Hits@10' THEN value ELSE 0 END) AS "Hits@10",
      max(CASE WHEN metric = 'Hits@3' THEN value ELSE 0 END) AS "Hits@3",
      max(CASE WHEN metric = 'Hits@5' THEN value ELSE 0 END) AS "Hits@5",
      max(CASE WHEN metric = 'MRR' THEN value ELSE 0 END) AS "MRR"
    FROM metrics GROUP BY model""",
)
def r1(spark, sf):
    return evaluate.comparison_table(two_models(spark, sf))


def _ranker_sql(name: str, hits: str, picked: str = "") -> str:
    """Truth ranks and metrics of one ranker whose hits are (mention, entity_id, rank)."""
    return f"""{name}_ranks AS (SELECT m.mention, h.rank FROM mentions m LEFT JOIN {hits} h
  ON h.mention = m.mention AND h.entity_id = m.mondo_id AND h.rank <= 10 {picked})"""


_WEIGHTED_HITS = """weighted AS (
  SELECT mention, entity_id, row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity_id) AS rank
  FROM (SELECT m.k AS mention, e.k AS entity_id, 1 / (1 + exp(-(list_dot_product(list_transform(m.vec,
    lambda x, i: x * (i % 7 - 2) / 4.0), e.vec) - 1))) AS score FROM mv_vec m, ev_vec e))"""
_ANSWERED_HITS = """asked AS (SELECT mention, entity_id, ordinal FROM (
    SELECT DISTINCT mention, mondo_id AS entity_id FROM mentions) JOIN catalog USING (entity_id)),
gpt_hits AS (SELECT mention, entity_id, row_number() OVER (PARTITION BY mention
  ORDER BY CASE WHEN (length(mention) + ordinal) % 2 = 0 THEN 0 ELSE 1 END, ordinal) AS rank FROM asked),
gemini_hits AS (SELECT mention, entity_id, row_number() OVER (PARTITION BY mention
  ORDER BY CASE WHEN (length(mention) + ordinal) % 3 = 0 THEN 0 ELSE 1 END, ordinal) AS rank FROM asked)"""
_RANKERS = {"vectors": "mention_hits", "classifier": "weighted", "gpt": "gpt_hits", "gemini": "gemini_hits"}
_ALL_RANKERS = ", ".join(
    [_MENTION_HITS, _WEIGHTED_HITS, _ANSWERED_HITS, *[_ranker_sql(n, h) for n, h in _RANKERS.items()]]
)


@query(
    "r1_comparison_all_rankers",
    f"WITH {_ALL_RANKERS}, metrics AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS model, * FROM ({s.metrics_sql(n + '_ranks')})" for n in _RANKERS
    )
    + """) SELECT model,
      max(CASE WHEN metric = 'Hits@1' THEN value END) AS "Hits@1",
      max(CASE WHEN metric = 'Hits@10' THEN value END) AS "Hits@10",
      max(CASE WHEN metric = 'Hits@3' THEN value END) AS "Hits@3",
      max(CASE WHEN metric = 'Hits@5' THEN value END) AS "Hits@5",
      max(CASE WHEN metric = 'MRR' THEN value END) AS "MRR"
    FROM metrics GROUP BY model""",
)
def r1_all(spark, sf):
    """Vectors, a classifier with set weights, and the recorded answers of two models."""
    rows, linker = _linker(spark, sf)
    classifier = PairClassifierLinker(SetWeights(), linker.catalog, linker.encoder)
    asked = (
        rows.select("mention", F.col("mondo_id").alias("entity_id"))
        .distinct()
        .join(linker.catalog.select("entity_id", "ordinal"), "entity_id")
    )
    code = F.length("mention") + F.col("ordinal")

    def answers(divisor, tries):
        text = F.when(code % divisor == 0, "Yes, the same.").otherwise("No.")
        failed = [F.struct(F.lit(i).alias("attempt"), F.lit(False).alias("ok"), F.lit("quota").alias("text")) for i in range(tries)]
        last = F.struct(F.lit(tries).alias("attempt"), F.lit(True).alias("ok"), text.alias("text"))
        return asked.select("mention", "entity_id", "ordinal", F.inline(F.array(*failed, last)))

    recorded = {"gpt": answers(2, 0), "gemini": answers(3, 1)}
    metrics = evaluate_rankers(rows, {"vectors": linker, "classifier": classifier}, recorded)
    return evaluate.comparison_table(metrics.withColumn("value", F.round("value", 6)))


# --- binary scores -----------------------------------------------------------------------


_REPORT = s.SCORES + """, marked AS (
  SELECT label, CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END AS predicted FROM scores),
classes AS (SELECT DISTINCT label AS class FROM marked UNION SELECT DISTINCT predicted FROM marked),
sums AS (
  SELECT class, count(CASE WHEN label = class AND predicted = class THEN 1 END) AS tp,
    count(CASE WHEN predicted = class THEN 1 END) AS found,
    count(CASE WHEN label = class THEN 1 END) AS support FROM marked, classes GROUP BY class),
pr AS (SELECT *, CASE WHEN found = 0 THEN 0 ELSE tp / found END AS p,
  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r FROM sums),
prf AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM pr),
report AS (
  SELECT CASE WHEN class = 1 THEN '1.0' ELSE '0.0' END AS "row", p AS precision, r AS recall,
    f AS f1, support FROM prf
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support),
    sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM prf
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM prf
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM prf)"""


@query(
    "a13_classification_report",
    f'WITH {_REPORT} SELECT "row", round(precision, 6) AS precision, round(recall, 6) AS recall, '
    "round(f1, 6) AS f1, support FROM report",
)
def a13(spark, sf):
    report = classify.classification_report(s.binary_scores(spark, sf))
    return _rounded(report, "precision", "recall", "f1")


_ROC = s.SCORES + """, by_score AS (
  SELECT score, count(CASE WHEN label = 1 THEN 1 END) AS pos,
    count(CASE WHEN label <> 1 THEN 1 END) AS neg FROM scores GROUP BY score),
running AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp,
  sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS q
  FROM by_score)"""


@query(
    "a14_roc_curve",
    f"WITH {_ROC} SELECT CAST(round(score, 6) AS DOUBLE) AS threshold, round(fp / q, 6) AS fpr, "
    "round(tp / p, 6) AS tpr FROM running UNION ALL SELECT NULL, 0.0, 0.0",
)
def a14(spark, sf):
    return _rounded(classify.roc_curve(s.binary_scores(spark, sf)), "threshold", "fpr", "tpr")


@query(
    "a15_auc",
    f"WITH {_ROC} SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM running",
)
def a15(spark, sf):
    return _rounded(classify.roc_auc(s.binary_scores(spark, sf)), "auc")


# --- pair classifier ---------------------------------------------------------------------


def _train_dev(spark, sf):
    rows = pinned(exact_split(pinned(s.mentions(spark, sf)), ROW_COLUMNS))
    return rows.where("split = 'train'"), rows.where("split = 'dev'")


# Rows and pairs of the training and the dev split; a row has min(3, entities - 1) negatives.
_SUPPORT = s.SPLIT + """, support AS (
  SELECT split, count(*) AS positives,
    count(*) * least(3, count(DISTINCT mondo_id) - 1) AS negatives,
    count(DISTINCT mention) AS mentions, count(DISTINCT mondo_id) AS entities,
    count(DISTINCT mention || '|' || mondo_id) AS links FROM split_rows GROUP BY split)"""


@query(
    "m1_fit_classifier",
    f"""WITH {_SUPPORT} SELECT 1.0::DOUBLE AS label, positives AS support, TRUE AS converged
      FROM support WHERE split = 'train'
    UNION ALL SELECT 0.0, negatives, TRUE FROM support WHERE split = 'train'""",
)
def m1(spark, sf):
    """Supports of the training pairs, and whether the fitted loss has no slope left.

    At the optimum the mean of (probability - label) * feature is balanced by the penalty
    on the standardised coefficient, for every feature and for the intercept.
    """
    train, dev = _train_dev(spark, sf)
    fitted = train_pair_classifier(train, dev)
    training, model = fitted["training"], fitted["model"]
    scored = pinned(score_features(model, training.withColumn("x", F.col("features"))), "scored")
    error = F.col("score") - F.col("label")
    cells = scored.select(error.alias("error"), "n", F.posexplode("x").alias("j", "x"))
    # Every row stands for n pairs.
    n, x = F.col("n"), F.col("x")
    sums = cells.groupBy("j").agg(
        F.sum("n").alias("n"),
        F.sum(n * F.col("error") * x).alias("slope"),
        F.sum(n * F.col("error")).alias("bias"),
        F.sum(n * x).alias("x"),
    )
    means = sums.select("j", (x / n).alias("mean"))
    spread = cells.join(F.broadcast(means), "j").groupBy("j").agg(
        F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))).alias("squares")
    )
    slopes = sums.join(spread, "j").select(
        "j",
        (F.col("slope") / n).alias("slope"),
        F.try_divide("squares", n - 1).alias("var"),
        (F.col("bias") / n).alias("bias"),
    )
    weights = spark.createDataFrame(
        [(j, float(w)) for j, w in enumerate(model.coefficients)], "j int, w double"
    )
    reg = model.getOrDefault("regParam")
    left = F.abs(F.col("slope") + reg * F.col("var") * F.col("w"))
    # Scaled as the optimiser sees the feature; a constant feature has no slope.
    scaled = F.when(F.col("var") > 0, left / F.sqrt("var")).otherwise(0.0)
    worst = slopes.join(weights, "j").agg(
        F.greatest(F.max(scaled), F.max(F.abs("bias"))).alias("worst")
    )
    converged = F.lit(worst.first()["worst"] < 1e-3)
    return scored.groupBy("label").agg(F.sum("n").alias("support")).withColumn("converged", converged)


@query(
    "m2_score_pairs",
    f"""WITH {_SUPPORT} SELECT 1.0::DOUBLE AS label, positives AS pairs, positives AS agreeing
      FROM support WHERE split = 'dev'
    UNION ALL SELECT 0.0, negatives, negatives FROM support WHERE split = 'dev'""",
)
def m2(spark, sf):
    """Dev pairs, and those whose score is the sigmoid of weights times word counts, by hand."""
    train, dev = _train_dev(spark, sf)
    size = 1 << 12
    training = pairs.labelled_pairs(train, cat.build_catalog(train, "shortest"))
    fitted = classify.fit_text_classifier(training, features=size)
    dev_pairs = pairs.labelled_pairs(dev, cat.build_catalog(dev, "shortest"))
    dev_pairs = pinned(dev_pairs.groupBy("input", "label").agg(F.count("*").alias("n")), "pairs")
    scored = classify.score_pairs(fitted, dev_pairs)
    *words, last = fitted.stages
    counted = dev_pairs.select("input").distinct()
    for stage in words:
        counted = stage.transform(counted)
    cells = counted.select("input", F.posexplode(vector_to_array("_features")).alias("j", "x"))
    weights = spark.createDataFrame(
        [(j, float(w)) for j, w in enumerate(last.coefficients.toArray())], "j int, w double"
    )
    logit = F.coalesce(F.sum(F.col("x") * F.col("w")), F.lit(0.0)) + F.lit(float(last.intercept))
    by_hand = cells.where("x <> 0").join(weights, "j").groupBy("input").agg(logit.alias("logit"))
    same = F.abs(F.col("score") - 1 / (1 + F.exp(-F.col("logit")))) < 1e-9
    return (
        scored.join(by_hand, "input", "left")
        .groupBy("label")
        .agg(F.sum("n").alias("pairs"), F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("agreeing"))
    )


@query(
    "v4_score_all_candidates",
    f"""WITH {_SUPPORT}, dev AS (SELECT *, (SELECT entities FROM support WHERE split = 'train') AS n
      FROM support WHERE split = 'dev')
    SELECT CAST(unnest(range(1, least(5, n) + 1)) AS INTEGER) AS rank, mentions AS n, mentions AS agreeing
    FROM dev UNION ALL SELECT 0, links, links FROM dev""",
)
def v4(spark, sf):
    """Five best entities per mention under the fitted classifier.

    Per rank the mentions, and those whose score is that of the pair scored alone. Rank 0
    counts the true pairs, and those that are in the list or score no more than its end.
    """
    train, dev = _train_dev(spark, sf)
    linker = train_pair_classifier(train, dev)["linker"]
    hits = pinned(linker.predict_batch(dev, 5), "hits")
    alone = linker.score_candidates(hits.select("mention", "entity_id"))
    alone = alone.withColumnRenamed("score", "alone")
    same = F.abs(F.col("score") - F.col("alone")) < 1e-9
    ranks = (
        hits.join(alone, ["mention", "entity_id"])
        .groupBy("rank")
        .agg(F.count("*").alias("n"), F.count_if(same).alias("agreeing"))
    )
    true = dev.select("mention", F.col("mondo_id").alias("entity_id")).distinct()
    ends = hits.groupBy("mention").agg(F.min("score").alias("end"))
    listed = hits.select("mention", "entity_id", F.lit(True).alias("listed"))
    judged = (
        linker.score_candidates(true)
        .join(ends, "mention")
        .join(listed, ["mention", "entity_id"], "left")
    )
    # An entity that no training row names is no catalog entry.
    known = linker.entity_vectors.select("entity_id", F.lit(True).alias("known"))
    judged = judged.join(known, "entity_id", "left")
    right = (
        F.col("known").isNull()
        | F.coalesce("listed", F.lit(False))
        | (F.col("score") <= F.col("end") + 1e-12)
    )
    total = judged.agg(F.count("*").alias("n"), F.count_if(right).alias("agreeing"))
    return ranks.unionByName(total.withColumn("rank", F.lit(0)))


@query(
    "v4_weighted_search",
    f"""WITH {_MENTION_HITS.split(", mention_hits AS")[0]}, scored AS (
      SELECT m.k AS mention, e.k AS entity_id, 1 / (1 + exp(-(list_dot_product(list_transform(m.vec,
        lambda x, i: x * (i % 7 - 2) / 4.0), e.vec) - 1))) AS score FROM mv_vec m, ev_vec e)
    SELECT mention, entity_id, round(score, 6) AS score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY mention ORDER BY score DESC, entity_id)
        AS INTEGER) AS rank FROM scored) WHERE rank <= 5""",
)
def v4_weighted(spark, sf):
    """The classifier ranking with set weights, so that the values can be compared."""

    rows, linker = _linker(spark, sf)
    vectors = linker.encode_mentions(rows)
    return _rounded(classify.score_all_candidates(SetWeights(), vectors, linker.catalog, 5))


def _words_sql(name, key, source):
    return f"""{name} AS (SELECT {key} AS k, list_distinct(list_filter(regexp_split_to_array(lower(text),
      '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS ws FROM {source})"""


@query(
    "v4_shared_terms",
    f"""WITH {_words_sql("asked", "item_id", "benchmark")}, {_words_sql("held", "doc_id", "documents")},
      a AS (SELECT k, unnest(ws) AS w FROM asked), b AS (SELECT k, unnest(ws) AS w FROM held),
      common AS (SELECT a.k AS m, b.k AS e, sum(CASE WHEN length(a.w) = 4 THEN -1
          ELSE length(a.w) * length(a.w) END / 8.0) AS s FROM a JOIN b ON a.w = b.w GROUP BY ALL),
      scored AS (SELECT asked.k AS mention, held.k AS entity_id,
          (coalesce(len(asked.ws), 0) % 3) / 4.0 - coalesce(len(held.ws), 0) / 64.0
          + coalesce(s, 0) AS logit
        FROM asked CROSS JOIN held LEFT JOIN common ON m = asked.k AND e = held.k)
    SELECT mention, entity_id, CAST(logit AS DOUBLE) AS logit, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY mention ORDER BY logit DESC, entity_id)
        AS INTEGER) AS rank FROM scored) WHERE rank <= 5""",
)
def v4_shared_terms(spark, sf):
    """Every benchmark item ranks all documents by the words they share, with set weights."""

    def with_terms(name, key, own):
        rows = s.table(spark, sf, name)
        terms = F.coalesce(shared_terms.distinct_words(F.col("text")), F.array().cast("array<string>"))
        return rows.select(F.col(key), terms.alias("terms")).withColumn("own", own)

    n = F.size("terms")
    mentions = pinned(with_terms("benchmark", "item_id", (n % 3) / 4)).withColumnRenamed("item_id", "mention")
    entities = with_terms("documents", "doc_id", -n / 64).withColumnRenamed("doc_id", "entity_id")
    words = mentions.select(F.explode("terms").alias("term")).distinct()
    length = F.length("term")
    weights = words.withColumn("weight", F.when(length == 4, -1).otherwise(length * length) / 8)
    return shared_terms.rank_by_shared_terms(mentions, entities, weights, 5)
