"""Ranked lists per query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    scored: DataFrame,
    k: int = 10,
    query: str | Sequence[str] = "query_id",
    score: str = "score",
    tie: str | Sequence[str] = "entity_id",
) -> DataFrame:
    """Best ``k`` rows per query, score descending, ties by ``tie``.

    Spark turns the filtered ``row_number`` into a limit on each side of the shuffle, so
    at most ``k`` rows per query and task are exchanged, however hot a query is.
    """
    keys = [query] if isinstance(query, str) else list(query)
    ties = [tie] if isinstance(tie, str) else list(tie)
    window = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def ranked_lists(ranked: DataFrame, query: str = "query_id") -> DataFrame:
    """One row per query with its (at most k) hits in rank order."""
    hits = F.sort_array(F.collect_list(F.struct("rank", "entity_id", "score")))
    return ranked.groupBy(query).agg(hits.alias("hits"))


def rank_of_truth(
    ranked: DataFrame, truth: DataFrame, query: str = "query_id", entity: str = "entity_id"
) -> DataFrame:
    """Every query with the first rank of its true entity, null when it is absent."""
    best = ranked.groupBy(query, entity).agg(F.min("rank").alias("rank"))
    return truth.select(query, entity).join(best, [query, entity], "left")


def verdict_scores(verdicts: DataFrame, flag: str = "is_equivalent") -> DataFrame:
    """1.0 for an equivalent pair, 0.0 otherwise and for failures."""
    return verdicts.withColumn("score", F.coalesce(F.col(flag).cast("double"), F.lit(0.0)))


def rank_verdicts(
    verdicts: DataFrame,
    k: int = 10,
    query: str = "query_id",
    tie: str | Sequence[str] = "ordinal",
    flag: str = "is_equivalent",
) -> DataFrame:
    """Rank by verdict; equal scores keep candidate order."""
    return top_k(verdict_scores(verdicts, flag), k, query, "score", tie)
