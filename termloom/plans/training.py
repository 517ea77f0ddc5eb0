"""Pair classifier: labelled pairs, fit, dev scores, all-candidate ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.ml.functions import array_to_vector, vector_to_array

from termloom.operators.catalog import build_catalog
from termloom.operators.classify import (
    classification_report,
    fit_vector_classifier,
    pair_features,
    roc_auc,
    score_all_candidates,
)
from termloom.operators.evaluate import evaluate_by_mention, fan_out
from termloom.operators.pairs import labelled_pairs
from termloom.operators.search import Encoder, with_outside_vectors
from termloom.plans.linking import ngram_encoder
from termloom.session import pinned


@dataclass
class PairClassifierLinker:
    """Ranks all catalog entries with a fitted pair classifier."""

    model: LogisticRegressionModel
    entity_vectors: DataFrame
    encoder: Encoder

    def predict_batch(self, rows: DataFrame, top_k: int = 5) -> DataFrame:
        """(mention, entity_id, score, rank), every distinct mention ranked once."""
        distinct = rows.select("mention").distinct().select("mention", F.col("mention").alias("text"))
        vectors = pinned(self.encoder(distinct, "mention", "text"), "vectors")
        return score_all_candidates(self.model, vectors, self.entity_vectors, top_k)

    def predict_rows(self, rows: DataFrame, top_k: int = 5) -> DataFrame:
        return fan_out(rows, self.predict_batch(rows, top_k))

    def score_candidates(self, pairs: DataFrame) -> DataFrame:
        """Probability of given (mention, entity_id) pairs.

        An entity outside the catalog is scored by its id.
        """
        distinct = pairs.select("mention").distinct().select("mention", F.col("mention").alias("text"))
        vectors = self.encoder(distinct, "mention", "text")
        entities = with_outside_vectors(pairs, self.entity_vectors, self.encoder)
        return score_features(self.model, pair_features(pairs, vectors, entities))

    def predict(self, mention: str, top_k: int = 5) -> DataFrame:
        """(entity_id, score, rank) of one mention text."""
        row = self.entity_vectors.sparkSession.createDataFrame([(mention,)], "mention string")
        return self.predict_batch(row, top_k).drop("mention")

    def evaluate(self, rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
        truth = rows.select("mention", F.col("mondo_id").alias("entity_id"))
        return evaluate_by_mention(truth, self.predict_batch(rows, max(ks)), ks)


def score_features(model: LogisticRegressionModel, featured: DataFrame) -> DataFrame:
    """Replace ``features`` by ``score``, the probability of class 1."""
    kept = [c for c in featured.columns if c != "features"]
    ready = featured.withColumn("_x", array_to_vector("features"))
    return model.transform(ready).select(
        *kept, vector_to_array(F.col(model.getProbabilityCol()))[1].alias("score")
    )


def train_pair_classifier(
    train: DataFrame,
    dev: DataFrame,
    rule: str = "shortest",
    negatives: int = 3,
    seed: int = 42,
    encoder: Encoder | None = None,
) -> dict[str, object]:
    """Fit on the training pairs and report on the dev pairs.

    The dev pairs come from a catalog of their own mentions, as the training pairs do. ``training``
    has a row for each different features and label, and the number ``n`` of its pairs.
    """
    encode = encoder or ngram_encoder()

    def featured(rows: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs, and the features of each different one with the number ``n`` of its rows."""
        pairs = labelled_pairs(rows, catalog, negatives, seed)
        counted = pairs.groupBy("mention", "entity_id", "label").agg(F.count("*").alias("n"))
        counted = pinned(counted, "pairs")
        distinct = counted.select("mention").distinct()
        vectors = encode(distinct.withColumn("text", F.col("mention")), "mention", "text")
        entities = encode(catalog, "entity_id", "rep_text")
        vectors = pair_features(counted, vectors, with_outside_vectors(counted, entities, encode))
        return pairs, vectors

    catalog = build_catalog(train, rule)
    _, vectors = featured(train, catalog)
    # Pairs of equal features are one row with their number: read once per optimiser step.
    training = vectors.groupBy("features", "label").agg(F.sum("n").alias("n"))
    training = pinned(training, "training")
    model = fit_vector_classifier(training, count="n")
    dev_pairs, vectors = featured(dev, build_catalog(dev, rule))
    known = score_features(model, vectors).select("mention", "entity_id", "label", "score")
    known = pinned(known.withColumnsRenamed({c: f"_{c}" for c in known.columns}), "scores")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("mention", "entity_id", "label")]
    scored = dev_pairs.join(known, same, "left")
    scored = pinned(scored.select(*dev_pairs.columns, F.col("_score").alias("score")), "scored")
    linking_vectors = encode(build_catalog(train, "mode"), "entity_id", "rep_text")
    return {
        "model": model,
        "training": training,
        "scored_dev": scored,
        "auc": roc_auc(scored),
        "report": classification_report(scored),
        "linker": PairClassifierLinker(model, pinned(linking_vectors, "catalog"), encode),
    }
