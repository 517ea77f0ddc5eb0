"""Labelled training pairs: positives, and negatives sampled without a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import hash_int
from termloom.functions.vectors import bind

# Pair text separator, default number of negatives.
SEPARATOR = " [SEP] "
NEGATIVES = 3


def pair_text(mention: Column, text: Column) -> Column:
    return F.concat(mention, F.lit(SEPARATOR), text)


def _own_entity(rows: DataFrame, catalog: DataFrame, entity: str) -> DataFrame:
    own = catalog.select(
        F.col("entity_id").alias(entity),
        F.col("rep_text").alias("own_text"),
        F.col("ordinal").alias("own"),
    )
    return rows.join(own, entity, "left")


def positive_pairs(
    rows: DataFrame, catalog: DataFrame, entity: str = "mondo_id", mention: str = "mention"
) -> DataFrame:
    """Every row with the text of its own entity, label 1.0; duplicates stay.

    A row whose entity is outside the catalog is paired with the id itself.
    """
    texts = catalog.select(F.col("entity_id").alias(entity), "rep_text")
    text = F.coalesce("rep_text", F.col(entity).cast("string"))
    return rows.join(texts, entity, "left").select(
        F.col(mention).alias("mention"),
        F.col(entity).alias("entity_id"),
        text.alias("rep_text"),
        pair_text(F.col(mention), text).alias("input"),
        F.lit(1.0).alias("label"),
    )


def row_draws(row_text: Column, k: int, seed: int) -> Column:
    """``k`` pseudo-random longs of a row, from md5 of its text and the draw number."""
    numbered = [F.concat_ws("|", F.lit(str(seed)), row_text, F.lit(str(i + 1))) for i in range(k)]
    return F.array(*[hash_int(text) for text in numbered])


def draw_others(own: Column, total: Column, draws: Column, k: int) -> Column:
    """``min(k, total - 1)`` distinct ordinals below ``total``, never ``own``, uniform.

    Floyd's subset draw over the ``total - 1`` other ordinals; ordinals from ``own`` up
    are shifted by one to skip it. A null ``own`` has ``total`` others and no shift.
    """
    others = total - F.when(own.isNull(), 0).otherwise(1)
    size = F.least(F.lit(k).cast("long"), others)
    none = F.array().cast("array<bigint>")

    turns = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1)).otherwise(none)

    def subset(numbers: Column) -> Column:
        def step(picked: Column, i: Column) -> Column:
            upper = others - size + i
            drawn = F.get(numbers, i.cast("int")) % (upper + 1)
            fresh = F.when(F.array_contains(picked, drawn), upper).otherwise(drawn)
            return F.concat(picked, F.array(fresh))

        return F.aggregate(turns, none, step)

    return F.transform(bind(draws, subset), lambda p: p + F.when(p >= own, 1).otherwise(0))


def negative_pairs(
    rows: DataFrame,
    catalog: DataFrame,
    k: int = NEGATIVES,
    seed: int = 42,
    entity: str = "mondo_id",
    mention: str = "mention",
    row_columns: Sequence[str] = ("pmid", "mention", "cui", "mondo_id"),
) -> DataFrame:
    """``k`` sampled wrong entities per row, label 0.0.

    A row whose entity is outside the catalog draws from the whole catalog.
    ``row_columns`` identify a row and seed its draws. Work and shuffle are rows times k:
    drawn ordinals are uniform, so the join back to the catalog is balanced.
    """
    total = catalog.select(F.count("*")).scalar()
    row_text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in row_columns])
    owned = _own_entity(rows, catalog, entity).select(
        F.col(mention).alias("mention"),
        "own",
        total.alias("total"),
        row_draws(row_text, k, seed).alias("draws"),
    )
    others = draw_others(F.col("own"), F.col("total"), F.col("draws"), k)
    drawn = owned.select("mention", F.explode(others).alias("ordinal"))
    return drawn.join(catalog.select("entity_id", "rep_text", "ordinal"), "ordinal").select(
        "mention",
        "entity_id",
        "rep_text",
        pair_text(F.col("mention"), F.col("rep_text")).alias("input"),
        F.lit(0.0).alias("label"),
    )


def labelled_pairs(
    rows: DataFrame,
    catalog: DataFrame,
    k: int = NEGATIVES,
    seed: int = 42,
    entity: str = "mondo_id",
    mention: str = "mention",
    row_columns: Sequence[str] = ("pmid", "mention", "cui", "mondo_id"),
) -> DataFrame:
    """Positive and negative pairs together."""
    return positive_pairs(rows, catalog, entity, mention).unionByName(
        negative_pairs(rows, catalog, k, seed, entity, mention, row_columns)
    )
