"""Hits@K, MRR and model comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.ranking import rank_of_truth


def _metric_columns(ks: Sequence[int], weight: Column) -> list[Column]:
    rank = F.col("rank")
    total = F.sum(weight)
    hits = [
        F.try_divide(F.sum(F.when(rank <= k, weight).otherwise(F.lit(0))), total).alias(f"Hits@{k}")
        for k in ks
    ]
    gain = F.coalesce(weight / rank, F.lit(0.0))
    return [*hits, F.try_divide(F.sum(gain), total).alias("MRR")]


def _long(wide: DataFrame, group: Sequence[str]) -> DataFrame:
    names = [c for c in wide.columns if c not in group]
    return wide.unpivot(list(group), names, "metric", "value")


def metrics_from_ranks(
    ranks: DataFrame,
    ks: Sequence[int] = (1, 3, 5, 10),
    group: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Long metrics from one truth rank per query; a null rank counts as a miss.

    Without queries the values are null.
    """
    rows = F.lit(1) if weight is None else F.col(weight)
    wide = ranks.groupBy(*group).agg(*_metric_columns(ks, rows))
    return _long(wide, group)


def evaluate_hits_and_mrr(
    truth: DataFrame,
    ranked: DataFrame,
    ks: Sequence[int] = (1, 3, 5, 10),
    query: str = "query_id",
    entity: str = "entity_id",
) -> DataFrame:
    """Hits@K over all queries of ``truth`` and MRR over the ranks in ``ranked``."""
    return metrics_from_ranks(rank_of_truth(ranked, truth, query, entity), ks)


def evaluate_by_mention(
    rows: DataFrame,
    ranked: DataFrame,
    ks: Sequence[int] = (1, 5, 10),
    mention: str = "mention",
    entity: str = "entity_id",
) -> DataFrame:
    """The same metrics when one ranked list per distinct mention serves many rows.

    Rows are counted per (mention, truth) and the counts weigh the metrics, so the ranked
    lists are never copied out to the rows. Lists are cut at the largest K.
    """
    counted = rows.groupBy(mention, entity).agg(F.count("*").alias("n"))
    cut = ranked.where(F.col("rank") <= max(ks))
    best = cut.groupBy(mention, entity).agg(F.min("rank").alias("rank"))
    return metrics_from_ranks(counted.join(best, [mention, entity], "left"), ks, weight="n")


def fan_out(rows: DataFrame, ranked: DataFrame, mention: str = "mention") -> DataFrame:
    """Hits of each distinct mention, attached to every row that has it."""
    return rows.join(ranked, mention)


def union_models(results: dict[str, DataFrame]) -> DataFrame:
    """Append metric sets of several models under a ``model`` column."""
    tagged = [df.withColumn("model", F.lit(name)) for name, df in results.items()]
    return reduce(DataFrame.unionByName, tagged).select("model", "metric", "value")


def metric_names(metrics: DataFrame) -> DataFrame:
    """Distinct metric names."""
    return metrics.select("metric").distinct()


def comparison_table(metrics: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per model, one column per metric name in sorted order; missing is 0."""
    grouped = metrics.groupBy("model")
    pivoted = grouped.pivot("metric", sorted(names)) if names else grouped.pivot("metric")
    return pivoted.agg(F.first("value")).fillna(0.0)
