"""Entity catalog: one representative text per entity, and its ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import hash_int
from termloom.operators.ordering import with_global_rank


def mention_counts(
    mentions: DataFrame, entity: str = "mondo_id", mention: str = "mention"
) -> DataFrame:
    """(entity_id, mention, n): the mentions of every entity as counted rows."""
    return mentions.groupBy(F.col(entity).alias("entity_id"), F.col(mention).alias("mention")).agg(
        F.count("*").alias("n")
    )


def mention_lists(
    mentions: DataFrame, entity: str = "mondo_id", mention: str = "mention", chunk_size: int = 1000
) -> DataFrame:
    """Mentions of an entity as counted, sorted lists, in parts of about ``chunk_size``.

    An entity with many distinct mentions spreads over many parts, so no row or task
    holds an unbounded list; the parts together are the whole list.
    """
    counted = mention_counts(mentions, entity, mention)
    parts = counted.groupBy("entity_id").agg(
        F.ceil(F.count("*") / chunk_size).cast("long").alias("_parts")
    )
    placed = counted.join(parts, "entity_id").withColumn(
        "part", hash_int(F.col("mention"), 8) % F.col("_parts")
    )
    return placed.groupBy("entity_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("mention", "n"))).alias("mentions")
    )


def representative_by_mode(
    mentions: DataFrame, entity: str = "mondo_id", mention: str = "mention"
) -> DataFrame:
    """Most frequent mention per entity; ties take the smallest mention."""
    return (
        mention_counts(mentions, entity, mention)
        .groupBy("entity_id")
        .agg(F.min_by("mention", F.struct(-F.col("n"), "mention")).alias("rep_text"))
    )


def representative_by_length(
    mentions: DataFrame, entity: str = "mondo_id", mention: str = "mention"
) -> DataFrame:
    """Shortest mention per entity in code points; ties take the smallest mention.

    Distinct pairs first: a hash aggregate that shrinks the rows before the string-valued
    ``min_by``, which Spark can only run sorted.
    """
    distinct = mentions.select(
        F.col(entity).alias("entity_id"), F.col(mention).alias("mention")
    ).distinct()
    return distinct.groupBy("entity_id").agg(
        F.min_by("mention", F.struct(F.length("mention"), "mention")).alias("rep_text")
    )


_RULES = {"mode": representative_by_mode, "shortest": representative_by_length}


def build_catalog(
    mentions: DataFrame,
    rule: str = "mode",
    entity: str = "mondo_id",
    mention: str = "mention",
) -> DataFrame:
    """(entity_id, rep_text, ordinal), ordinals dense from 0 along the entity id."""
    return with_global_rank(_RULES[rule](mentions, entity, mention), ["entity_id"], "ordinal")


def candidate_list(mentions: DataFrame, entity: str = "mondo_id") -> DataFrame:
    """Distinct entity ids with their ordinal."""
    ids = mentions.select(F.col(entity).alias("entity_id")).distinct()
    return with_global_rank(ids, ["entity_id"], "ordinal")


def candidate_text(
    candidates: DataFrame, catalog: DataFrame, entity: str = "entity_id"
) -> DataFrame:
    """Add ``rep_text``, falling back to the id for entities outside the catalog."""
    texts = catalog.select(F.col("entity_id").alias(entity), F.col("rep_text").alias("_text"))
    return candidates.join(texts, entity, "left").select(
        *candidates.columns, F.coalesce("_text", F.col(entity).cast("string")).alias("rep_text")
    )
