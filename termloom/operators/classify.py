"""Pair classifier and binary-score evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.vectors import hadamard
from termloom.operators.ordering import with_running_sums
from termloom.operators.search import search
from termloom.session import pinned

THRESHOLD = 0.5


def confusion(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rows per (label, predicted); a score above the threshold predicts 1.0."""
    predicted = (F.col(score) > THRESHOLD).cast("double")
    return scored.groupBy(
        F.col(label).cast("double").alias("label"), predicted.alias("predicted")
    ).agg(F.count("*").alias("n"))


def classification_report(
    scored: DataFrame, score: str = "score", label: str = "label"
) -> DataFrame:
    """Precision, recall, f1 and support per class, accuracy, macro and weighted averages.

    Long form (row, precision, recall, f1, support); an empty denominator gives 0. Classes
    that occur neither as label nor as prediction have no row.
    """
    counts = confusion(scored, score, label)
    per_class = (
        counts.select(
            F.explode(F.array_distinct(F.array("label", "predicted"))).alias("class"),
            "label",
            "predicted",
            "n",
        )
        .groupBy("class")
        .agg(
            _n((F.col("label") == F.col("class")) & (F.col("predicted") == F.col("class"))).alias("tp"),
            _n(F.col("predicted") == F.col("class")).alias("found"),
            _n(F.col("label") == F.col("class")).alias("support"),
        )
    )
    precision, recall = _ratio(F.col("tp"), F.col("found")), _ratio(F.col("tp"), F.col("support"))
    classes = per_class.select(
        F.col("class").cast("string").alias("row"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2.0 * precision * recall, precision + recall).alias("f1"),
        "support",
        "tp",
    )
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    overall = classes.agg(
        _ratio(F.sum("tp"), total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in names],
        total.alias("support"),
    ).where("support is not null")

    def summary(row: str, columns: list[str]) -> Column:
        values = [F.col(c).alias(m) for m, c in zip(names, columns)]
        return F.struct(F.lit(row).alias("row"), *values, F.col("support"))

    averages = overall.select(
        F.inline(
            F.array(
                summary("accuracy", ["accuracy"] * 3),
                summary("macro avg", [f"macro_{m}" for m in names]),
                summary("weighted avg", [f"weighted_{m}" for m in names]),
            )
        )
    )
    return classes.drop("tp").unionByName(averages)


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _score_counts(scored: DataFrame, score: str, label: str) -> DataFrame:
    positive = F.count_if(F.col(label) == 1)
    return scored.groupBy(F.col(score).alias("score")).agg(
        positive.alias("pos"), (F.count("*") - positive).alias("neg")
    )


def roc_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, fpr, tpr), one point per distinct score from the highest, after (0, 0).

    The starting point has a null threshold. Rates are null when a class is missing.
    """
    counts = _score_counts(scored, score, label)
    running = with_running_sums(counts, [F.col("score").desc()], {"tp": "pos", "fp": "neg"})

    def point(threshold: Column, fp: Column, tp: Column) -> Column:
        return F.struct(
            threshold.cast("double").alias("threshold"),
            F.try_divide(fp, F.col("fp_total")).alias("fpr"),
            F.try_divide(tp, F.col("tp_total")).alias("tpr"),
        )

    own = point(F.col("score"), F.col("fp"), F.col("tp"))
    origin = point(F.lit(None), F.lit(0.0), F.lit(0.0))
    highest = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return running.select(F.inline(F.when(highest, F.array(origin, own)).otherwise(F.array(own))))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact trapezoid area under the ROC curve, ties included; null for a single class."""
    counts = _score_counts(scored, score, label)
    running = with_running_sums(counts, [F.col("score").desc()], {"tp": "pos"})
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return running.agg(
        F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def log_loss(score: str = "score", label: str = "label") -> Column:
    """Mean validation log loss as an aggregate, with scores kept away from 0 and 1."""
    p = F.greatest(F.least(F.col(score), F.lit(1 - 1e-15)), F.lit(1e-15))
    return -F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))


# --- classifier on the pair text ---------------------------------------------------------


def fit_text_classifier(
    pairs: DataFrame, features: int = 1 << 18, max_iter: int = 50, reg: float = 1e-4
) -> PipelineModel:
    """Logistic regression on hashed words of ``input``; one logit per pair.

    Equal pairs are one row with their count as weight.
    """
    counted, reg = counted_rows(pairs, ["input", "label"], reg)
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="input", outputCol="_words", pattern=r"\s+"),
            HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
            LogisticRegression(
                featuresCol="_features",
                labelCol="label",
                probabilityCol="_probability",
                rawPredictionCol="_raw",
                predictionCol="_predicted",
                weightCol="_n",
                maxIter=max_iter,
                regParam=reg,
            ),
        ]
    ).fit(counted)


def counted_rows(
    rows: DataFrame, columns: Sequence[str], reg: float, count: str | None = None
) -> tuple[DataFrame, float]:
    """Distinct rows of ``columns`` with their number as ``_n``, and the penalty to fit them with.

    ``count`` names a column with the number of rows that a row stands for. Spark divides the
    squared deviations of weighted rows by W - sum(w^2) / W where single rows have n - 1; the
    penalty, which counts in standard deviations, is scaled so that both fits have one optimum.
    """
    number = F.count("*") if count is None else F.sum(count)
    counted = pinned(rows.groupBy(*columns).agg(number.cast("double").alias("_n")), "counted")
    total, squares = counted.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("_n"))).first()
    if not total or total <= 1:
        return counted, reg
    return counted, reg * max(total - squares / total, 0.0) / (total - 1)


def score_pairs(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Add ``score``, the probability of an equivalent pair."""
    scored = model.transform(pairs)
    return scored.select(*pairs.columns, vector_to_array("_probability")[1].alias("score"))


# --- classifier on the product of the two text vectors -----------------------------------


def pair_features(
    pairs: DataFrame,
    mention_vectors: DataFrame,
    entity_vectors: DataFrame,
    mention: str = "mention",
) -> DataFrame:
    """Attach the element-wise product of mention and entity vector as ``features``.

    Every pair comes out; without either vector its features are null.
    """
    m = mention_vectors.select(mention, F.col("embedding").alias("_m"))
    e = entity_vectors.select("entity_id", F.col("embedding").alias("_e"))
    product = hadamard(F.col("_m"), F.col("_e"))
    joined = pairs.join(e, "entity_id", "left").join(m, mention, "left")
    return joined.select(*pairs.columns, product.alias("features"))


def fit_vector_classifier(
    featured: DataFrame, max_iter: int = 50, reg: float = 1e-4, count: str | None = None
) -> LogisticRegressionModel:
    """Logistic regression on the vector product: a learned weighted inner product.

    Equal rows are one row with their count as weight; ``count`` names a column with the number of
    pairs that a row stands for.
    """
    counted, reg = counted_rows(featured, ["features", "label"], reg, count)
    rows = counted.select(array_to_vector("features").alias("_x"), "label", "_n")
    return LogisticRegression(
        featuresCol="_x", labelCol="label", weightCol="_n", maxIter=max_iter, regParam=reg
    ).fit(rows)


def score_all_candidates(
    model: LogisticRegressionModel,
    mention_vectors: DataFrame,
    entity_vectors: DataFrame,
    k: int = 5,
    mention: str = "mention",
    **search_options: int,
) -> DataFrame:
    """Top-k entities per mention over the whole catalog, scored by the fitted classifier.

    The logit of a pair is the inner product of the weighted mention vector with the
    entity vector plus a constant, so the exact blocked search ranks all candidates and
    no table of pairs is built. Equal scores rank by id, also where their logits differ.
    """
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    weighted = mention_vectors.select(
        mention, hadamard(F.col("embedding"), weights).alias("embedding")
    )
    link = logistic(float(model.intercept))
    hits = search(weighted, entity_vectors, k, query=mention, link=link, **search_options)
    return hits.withColumnRenamed("query_id", mention)


def logistic(intercept: float) -> Callable[[np.ndarray], np.ndarray]:
    """Probability from an inner product."""

    def link(products: np.ndarray) -> np.ndarray:
        # The exp of the C library, one value at a time: numpy's differs in the last place, and
        # with it which scores are equal.
        powers = [math.exp(min(-x, 709.0)) for x in (products + intercept).ravel().tolist()]
        return 1.0 / (1.0 + np.array(powers, float).reshape(products.shape))

    return link
