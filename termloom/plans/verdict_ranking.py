"""Ranking by recorded yes/no answers of a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from termloom.operators.evaluate import evaluate_hits_and_mrr
from termloom.operators.ranking import rank_verdicts
from termloom.operators.verdicts import RETRIES, parse_verdicts, resolve_attempts


def rank_attempts(
    attempts: DataFrame,
    requests: DataFrame,
    k: int = 10,
    model: str = "gpt",
    retries: int | None = RETRIES,
) -> DataFrame:
    """Attempt log to ranked lists.

    ``attempts`` is (request_id, attempt, ok, text); ``requests`` maps a request to
    (query_id, entity_id, ordinal).
    """
    answers = parse_verdicts(resolve_attempts(attempts, "request_id", model, retries))
    verdicts = requests.join(answers, "request_id", "left")
    return rank_verdicts(verdicts, k)


def evaluate_verdict_ranking(
    attempts: DataFrame,
    requests: DataFrame,
    truth: DataFrame,
    k: int = 10,
    model: str = "gpt",
    retries: int | None = RETRIES,
) -> DataFrame:
    return evaluate_hits_and_mrr(truth, rank_attempts(attempts, requests, k, model, retries))
