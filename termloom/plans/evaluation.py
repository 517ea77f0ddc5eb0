"""All rankers in one evaluation: linkers and recorded answers of language models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.evaluate import evaluate_by_mention, union_models
from termloom.operators.verdicts import RATE_LIMIT_PARTS, RETRIES
from termloom.plans.verdict_ranking import rank_attempts

ANSWER_SCHEMA = (
    "mention string, entity_id string, ordinal long, attempt int, ok boolean, text string"
)


class Linker(Protocol):
    def evaluate(self, rows: DataFrame, ks: tuple[int, ...]) -> DataFrame: ...


def answers_ranking(
    answers: DataFrame, k: int = 10, model: str = "gpt", retries: int | None = RETRIES
) -> DataFrame:
    """Attempts per (mention, entity_id) to hits (mention, entity_id, score, rank).

    A model without rules of its own for rate limits takes those of the first.
    """
    request = F.xxhash64("mention", "entity_id")
    keyed = answers.withColumn("request_id", F.struct("mention", "entity_id", request))
    requests = keyed.groupBy("request_id").agg(
        F.first("mention").alias("query_id"),
        F.first("entity_id").alias("entity_id"),
        F.min("ordinal").alias("ordinal"),
    )
    rules = model if model in RATE_LIMIT_PARTS else "gpt"
    attempts = keyed.select("request_id", "attempt", "ok", "text")
    ranked = rank_attempts(attempts, requests, k, rules, retries)
    return ranked.select(F.col("query_id").alias("mention"), "entity_id", "score", "rank")


def evaluate_rankers(
    rows: DataFrame,
    linkers: Mapping[str, Linker],
    answers: Mapping[str, DataFrame],
    ks: Sequence[int] = (1, 3, 5, 10),
    retries: int | None = RETRIES,
) -> DataFrame:
    """(model, metric, value) of every linker and of every model's recorded answers.

    ``rows`` is (mention, mondo_id); ``answers`` maps a model to a table as ANSWER_SCHEMA.
    """
    truth = rows.select("mention", F.col("mondo_id").alias("entity_id"))
    results = {name: linker.evaluate(rows, tuple(ks)) for name, linker in linkers.items()}
    for model, table in answers.items():
        ranked = answers_ranking(table, max(ks), model, retries)
        results[model] = evaluate_by_mention(truth, ranked, tuple(ks))
    return union_models(results)
