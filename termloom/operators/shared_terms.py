"""All candidates under a classifier that looks at the terms a mention and an entity share.

The logit of a pair is what the mention brings, plus what the entity brings, plus a weight for
each term of both. Every entity of the catalog competes, also one that shares no term, yet no
table of pairs is made: postings of a term are ordered by what their entities bring, in blocks
with their highest value, and a mention reads of each list only the part that can still
matter.

With the mention's terms of positive weight in rising order, an entity whose last one among them is t
scores at most ``mention + entity + sum of the weights up to t``. Against the floor, the k-th best
score of a first few candidates, that bound tells how far down the list of t a new entity can be. An
entity that shares no such term scores at most ``mention + entity``; those are taken from the
top of the catalog, ever further down while the bound asks for it.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.vectors import sigmoid
from termloom.operators.ranking import top_k
from termloom.session import pinned

BLOCK = 256  # postings with one highest value
SHARD = 1 << 16  # postings of a term that are ordered together
FIRST = 16  # entities of the top of the catalog that every mention is scored with
GROWTH = 8
PART = 1024  # entities of the top that are met at once
_MARGIN = 1e-9  # sums of weights may be rounded otherwise in a bound than in a score


def distinct_words(text: Column) -> Column:
    """Lower-case words of a text, each once."""
    words = F.split(F.lower(text), r"[ \t\n\x0b\f\r]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


# --- fit -----------------------------------------------------------------------------------


def pair_terms(mention: Column, text: Column) -> Column:
    """Features of a pair: words of the mention, of the entity, and of both."""
    m, e = distinct_words(mention), distinct_words(text)

    def named(words: Column, side: str) -> Column:
        return F.transform(words, lambda w: F.concat(F.lit(side), w))

    return F.concat(named(m, "m:"), named(e, "e:"), named(F.array_intersect(m, e), "b:"))


def fit_shared_term_classifier(
    pairs: DataFrame, features: int = 1 << 18, max_iter: int = 50, reg: float = 1e-4
) -> PipelineModel:
    """Logistic regression on ``pair_terms`` of (mention, rep_text, label)."""
    ready = pairs.select(pair_terms(F.col("mention"), F.col("rep_text")).alias("_terms"), "label")
    stages = [
        HashingTF(inputCol="_terms", outputCol="_features", numFeatures=features),
        LogisticRegression(
            featuresCol="_features",
            labelCol="label",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            predictionCol="_predicted",
            maxIter=max_iter,
            regParam=reg,
        ),
    ]
    return Pipeline(stages=stages).fit(ready)


def score_given_pairs(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Add ``score``, the probability of each given (mention, rep_text)."""
    ready = pairs.withColumn("_terms", pair_terms(F.col("mention"), F.col("rep_text")))
    return model.transform(ready).select(
        *pairs.columns, vector_to_array("_probability")[1].alias("score")
    )


def term_weights(model: PipelineModel, terms: DataFrame) -> DataFrame:
    """(side, term, weight) for the sides m, e and b of every different ``term``."""
    sides = F.explode(F.array(*[F.lit(s) for s in "meb"])).alias("side")
    named = terms.select("term").distinct().select(sides, "term")
    named = named.withColumn("_terms", F.array(F.concat("side", F.lit(":"), "term")))
    intercept = float(model.stages[-1].intercept)
    raw = vector_to_array("_raw")[1] - F.lit(intercept)
    return model.transform(named).select("side", "term", raw.alias("weight"))


def rank_all_candidates(
    model: PipelineModel, mentions: DataFrame, catalog: DataFrame, k: int = 5
) -> DataFrame:
    """Top-k entities of the whole catalog per distinct mention, as ``rank_by_shared_terms`` gives them.

    ``mentions`` holds (mention), ``catalog`` (entity_id, rep_text).
    """
    m = mentions.select("mention").distinct().withColumn("terms", distinct_words(F.col("mention")))
    e = catalog.select("entity_id", distinct_words(F.col("rep_text")).alias("terms"))
    every = m.select(F.explode("terms").alias("term")).unionByName(
        e.select(F.explode("terms").alias("term"))
    )
    weights = pinned(term_weights(model, every), "weights")
    intercept = F.lit(float(model.stages[-1].intercept))
    shared = weights.where("side = 'b'").select("term", "weight")
    ranked = rank_by_shared_terms(
        _with_own(m, "mention", weights.where("side = 'm'"), intercept),
        _with_own(e, "entity_id", weights.where("side = 'e'"), F.lit(0.0)),
        shared,
        k,
    )
    return ranked.select("mention", "entity_id", "logit", sigmoid(F.col("logit")).alias("score"), "rank")


def _with_own(rows: DataFrame, key: str, weights: DataFrame, start: Column) -> DataFrame:
    """(key, terms, own): the weights of a row's own terms added up in their order."""
    cells = rows.select(key, F.explode("terms").alias("term")).join(weights, "term")
    listed = cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("w"))
    total = F.aggregate("w", start, lambda acc, x: acc + x["weight"])
    return rows.join(listed, key, "left").select(key, "terms", F.coalesce(total, start).alias("own"))


# --- rank ----------------------------------------------------------------------------------


def rank_by_shared_terms(
    mentions: DataFrame, entities: DataFrame, shared: DataFrame, k: int = 5
) -> DataFrame:
    """Top-k of all entities per mention: (mention, entity_id, logit, rank).

    ``mentions`` is (mention, terms, own) and ``entities`` (entity_id, terms, own), both with
    unique ids and different terms per row; ``shared`` is (term, weight), one row per term. The
    logit is the sum of both ``own`` and the weights of shared terms, added in the order of the
    terms; equal logits rank by id. Ranks follow the logit, which tells pairs apart whose
    probabilities are rounded to the same number.
    """
    e = entities.select("entity_id", F.col("own").cast("double").alias("own"), "terms")
    e = pinned(e, "entities")
    weighed = mentions.select("mention", F.explode("terms").alias("term"))
    weighed = weighed.join(shared, "term").where("weight <> 0")
    cells = weighed.groupBy("mention").agg(
        F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("cells")
    )
    m = mentions.select("mention", F.col("own").cast("double").alias("own"))
    m = pinned(m.join(cells, "mention", "left"), "mentions")

    size, top = e.count(), FIRST + k
    listed = _top_entities(e, top)
    postings = _postings(e, shared)
    first = _attached(m, listed, top).unionByName(_heads(m, postings, k))
    scored = pinned(_scores(first, m, e), "scored")
    reached = _reached(_floors(m, scored, k), postings)
    later = reached.join(scored, ["mention", "entity_id"], "left_anti")
    scored = pinned(scored.unionByName(_scores(later, m, e)), "scored")

    # Entities that share no term of positive weight: further down the catalog if need be.
    while top < size:
        last = listed.orderBy("own", F.col("entity_id").desc()).first()
        floors = _floors(m, scored, k)
        most = F.col("own") + F.lit(last["own"])
        done = (F.col("floor") > most) | (
            (F.col("floor") == most) & (F.col("kth") <= F.lit(last["entity_id"]))
        )
        left = pinned(floors.where(~F.coalesce(done, F.lit(False))), "open")
        if left.isEmpty():
            break
        top = min(size, top * GROWTH)
        further = _top_entities(e, top)
        added = _attached(left, further.join(listed, "entity_id", "left_anti"), top)
        added = added.join(scored, ["mention", "entity_id"], "left_anti")
        scored = pinned(scored.unionByName(_scores(added, m, e)), "scored")
        listed = further
    return top_k(scored, k, "mention", "logit")


def _top_entities(e: DataFrame, n: int) -> DataFrame:
    best = e.orderBy(F.col("own").desc(), "entity_id").limit(n)
    return pinned(best.select("entity_id", "own"), "top")


def _attached(m: DataFrame, listed: DataFrame, n: int) -> DataFrame:
    """Mentions with each of the at most ``n`` entities of a list that they asked for."""
    parts = -(-n // PART)
    lists = listed.groupBy(F.pmod(F.xxhash64("entity_id"), F.lit(parts)).alias("part")).agg(
        F.collect_list("entity_id").alias("ids")
    )
    wide = m.select("mention", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = wide.withColumn("part", F.col("part").cast("long")).join(lists, "part")
    return met.select("mention", F.explode("ids").alias("entity_id"))


def _postings(e: DataFrame, shared: DataFrame) -> DataFrame:
    """(term, shard, block, highest, entries) of the terms with a positive weight.

    The entities of a term, in shards of about SHARD, are ordered by what they bring and cut into
    blocks; ``entries`` holds that with its sign turned, and the id.
    """
    cells = e.select(F.explode("terms").alias("term"), "entity_id", "own")
    wanted = shared.where("weight > 0").select("term")
    counts = cells.groupBy("term").agg(F.ceil(F.count("*") / F.lit(SHARD)).alias("shards"))
    cells = cells.join(wanted.join(counts, "term"), "term")
    shard = F.pmod(F.xxhash64("entity_id"), F.col("shards")).cast("int")
    place = Window.partitionBy("term", "shard").orderBy(F.col("own").desc(), "entity_id")
    numbered = cells.withColumn("shard", shard).withColumn(
        "block", F.floor((F.row_number().over(place) - 1) / F.lit(BLOCK)).cast("int")
    )
    entry = F.struct((-F.col("own")).alias("turned"), "entity_id")
    blocks = numbered.groupBy("term", "shard", "block").agg(
        F.max("own").alias("highest"), F.sort_array(F.collect_list(entry)).alias("entries")
    )
    return pinned(blocks, "postings")


def _heads(m: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """The best entities of the lists of a mention's terms."""
    terms = m.select("mention", F.explode("cells").alias("c")).where("c.weight > 0")
    heads = postings.where("shard = 0 and block = 0")
    heads = heads.select("term", F.slice("entries", 1, k).alias("best"))
    met = terms.select("mention", F.col("c.term").alias("term")).join(heads, "term")
    return met.select("mention", F.explode("best.entity_id").alias("entity_id"))


def _scores(candidates: DataFrame, m: DataFrame, e: DataFrame) -> DataFrame:
    """(mention, entity_id, logit) of each different candidate."""
    pairs = candidates.select("mention", "entity_id").distinct()
    pairs = pairs.join(e.withColumnRenamed("own", "of_entity"), "entity_id")
    pairs = pairs.join(m.withColumnRenamed("own", "of_mention"), "mention")
    both = F.filter("cells", lambda c: F.array_contains("terms", c["term"]))
    start = F.col("of_mention") + F.col("of_entity")
    logit = F.coalesce(F.aggregate(both, start, lambda acc, c: acc + c["weight"]), start)
    return pairs.select("mention", "entity_id", logit.alias("logit"))


def _floors(m: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """Mentions with the logit and id of their k-th best entity so far; null if there are fewer."""
    best = top_k(scored, k, "mention", "logit").where(F.col("rank") == k)
    best = best.select("mention", F.col("logit").alias("floor"), F.col("entity_id").alias("kth"))
    return m.join(best, "mention", "left")


def _reached(floors: DataFrame, postings: DataFrame) -> DataFrame:
    """Entities of the postings that their bound lets reach a mention's floor.

    The blocks of a list fall in their highest value, so a mention needs the first few of each; it
    is joined with those only, by term, shard and block.
    """
    # Sums of the positive weights up to each term, in rising order.
    positive = F.filter("cells", lambda c: c["weight"] > 0)
    rising = F.array_sort(F.transform(positive, lambda c: F.struct(c["weight"], c["term"])))
    listed = floors.withColumn("terms", rising).where(F.size("terms") > 0)
    listed = listed.select("*", F.posexplode("terms").alias("at", "t"))
    before = Window.partitionBy("mention").orderBy("at")
    bound = F.sum("t.weight").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = listed.select("mention", F.col("t.term").alias("term"), "own", "floor", bound.alias("bound"))
    least = F.col("floor") - F.col("own") - F.col("bound")
    margin = F.lit(_MARGIN) * (1 + F.abs("floor") + F.abs("own") + F.col("bound"))
    least = F.coalesce(least - margin, F.lit(float("-inf")))

    lists = postings.groupBy("term", "shard").agg(
        F.sort_array(F.collect_list("highest"), asc=False).alias("highest")
    )
    asked = asked.select("mention", "term", least.alias("least")).join(lists, "term")
    needed = F.size(F.filter("highest", lambda h: h >= F.col("least")))
    keys = ["term", "shard"]
    asked = asked.select("mention", *keys, "least", needed.alias("needed")).where("needed > 0")
    asked = asked.select(
        "mention", *keys, "least", F.explode(F.sequence(F.lit(0), F.col("needed") - 1)).alias("block")
    )
    met = asked.join(postings.select(*keys, "block", "entries"), [*keys, "block"])
    entry = met.select("mention", "least", F.explode("entries").alias("x"))
    return entry.where(-F.col("x.turned") >= F.col("least")).select(
        "mention", F.col("x.entity_id").alias("entity_id")
    )
