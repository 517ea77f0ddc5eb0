"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts, epochs.

Every row gets a random key from its id. Rows are range-sorted by source and key, prefix sums
of their sizes are taken across the sorted chunks, and each source is cut at its budget; a
budget above the source's size takes whole epochs first.

Null text has size 0. Null is a source of its own and comes last. Rows with one id have one
key; equal keys are ordered by id and size, in ``mixed_rows`` then by a hash of the row, so rows
that change places are equal and do not change the result. Sources of size 0 have target 0. An
empty table gives an empty one; other columns are ignored by ``take`` and carried by ``mixed_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import WORD_PATTERN, table
from termloom.operators.ordering import with_global_rank, with_running_sums
from termloom.session import pinned

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 17
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0))


def random_key(id_column: Column, seed: int = SEED) -> Column:
    """60 random bits from the id, the same on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(
    sources: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """Add ``target`` to one row per source with ``source`` and ``source_size``.

    What a source cannot take is shared among the others by weight until none is above
    ``most`` times its size. That is a common level per weight: with sources in the order of
    (limit / weight), those up to the level are full and the rest get level * weight.
    """
    ranked = with_global_rank(sources, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")
    )
    rows = ranked.withColumn("_weight", weight).withColumn(
        "_limit", F.lit(float(most)) * F.col("source_size")
    )
    rows = rows.withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    sums = with_running_sums(rows, ["_ratio", "_rank"], {"_limits": "_limit", "_weights": "_weight"})
    left = F.lit(share / most) * F.col("_limits_total") - (F.col("_limits") - F.col("_limit"))
    level = left / (F.col("_weights_total") - (F.col("_weights") - F.col("_weight")))
    sums = sums.withColumn("_level", level).withColumn("_full", F.col("_ratio") <= F.col("_level"))
    common = sums.where(~F.col("_full")).agg(F.max("_level")).first()[0]
    open_target = F.col("_weight") * F.lit(common if common is not None else 0.0)
    return sums.select(
        "source",
        "source_size",
        F.when(F.col("_full"), F.col("_limit")).otherwise(open_target).alias("target"),
    )


def _small(sources: DataFrame) -> DataFrame:
    """One row per source: sent to the tasks if they are few, joined by key otherwise."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def take(
    df: DataFrame,
    size: Column,
    id_column: str = "doc_id",
    source_column: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
    tie: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """How much the mix takes of every row, and where each source is cut.

    ``tie`` orders rows of equal key, id and size.

    The first table has ``id``, ``source``, ``size``, ``key``, ``source_size``, ``target`` and
    ``taken``. The second has a row per source: ``epochs`` taken whole, and the key, id, size, tie
    and part of the row at which the last epoch ends, and how many equal rows are ``whole`` before.
    """
    ties = {} if tie is None else {"tie": tie}
    rows = pinned(
        df.select(
            df[id_column].alias("id"),
            df[source_column].alias("source"),
            size.alias("size"),
            random_key(df[id_column], seed).alias("key"),
            *[column.alias(name) for name, column in ties.items()],
        ),
        "sizes",
    )
    sources = pinned(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ends = with_running_sums(sources, ["source"], {"_end": "source_size"}).select(
        F.col("source").alias("_source"), (F.col("_end") - F.col("source_size")).alias("_start")
    )
    targets = source_targets(sources, weights, share, most)
    targets = targets.join(ends, targets["source"].eqNullSafe(ends["_source"])).drop("source")
    budget = F.least(
        F.floor(F.col("target") + 0.5), F.floor(F.lit(float(most)) * F.col("source_size"))
    )
    targets = pinned(
        targets.withColumn("_budget", budget)
        .withColumn(
            "epochs",
            F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(0),
        )
        .withColumn("_rest", F.col("_budget") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    summed = with_running_sums(rows, ["source", "key", "id", "size", *ties], {"_run": "size"})
    joined = summed.join(_small(targets), summed["source"].eqNullSafe(targets["_source"]))
    before = F.col("_run") - F.col("size") - F.col("_start")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - before))
    joined = joined.withColumn("_part", part)
    taken = joined.select(
        "id",
        "source",
        "size",
        "key",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("_part")).cast("long").alias("taken"),
    )
    last = joined.where((before <= F.col("_rest")) & (before + F.col("size") > F.col("_rest")))
    place = F.struct("key", "id", "size", *ties)
    at = last.groupBy("source").agg(F.min(F.struct("key", "id", "size", *ties, "_part")).alias("cut"))
    if ties:
        at = pinned(at, "cuts")
        ends_at = at.select(F.col("source").alias("_cut_source"), "cut")
        met = joined.join(_small(ends_at), joined["source"].eqNullSafe(ends_at["_cut_source"]))
        same = F.struct(*[F.col(f"cut.{c}").alias(c) for c in ("key", "id", "size", *ties)])
        whole = met.where((place == same) & (before + F.col("size") <= F.col("_rest")))
        whole = whole.groupBy("source").agg(F.count("*").alias("whole"))
        whole = whole.withColumnRenamed("source", "_cut_source")
        at = at.join(whole, at["source"].eqNullSafe(whole["_cut_source"]), "left").select(
            "source", "cut", F.coalesce("whole", F.lit(0)).alias("whole")
        )
    else:
        at = at.withColumn("whole", F.lit(0))
    cuts = targets.join(at, targets["_source"].eqNullSafe(at["source"]), "left").select(
        F.col("_source").alias("source"), "epochs", "cut", "whole"
    )
    return taken, cuts


def mixed_rows(
    df: DataFrame,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    **options,
) -> DataFrame:
    """The mix itself: every row as often as its source's epochs take it.

    The row at which a source is cut keeps its first words. Rows are compared with the cut of
    their source where they are; only texts at a cut are shuffled.
    """
    # JSON for what has no hash of its own; the hash decides only between rows of one id and size.
    hashed = [
        F.to_json(F.struct(df[c])) if kind.startswith(("map", "array", "struct")) else df[c]
        for c, kind in df.dtypes
    ]
    tie = F.xxhash64(*hashed)
    size = n_words(df[text_column])
    _, cuts = take(df, size, id_column, source_column, tie=tie, **options)
    cuts = cuts.withColumnRenamed("source", "cut_source")
    # The row as one column, so that its names cannot meet those used here.
    packed = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        random_key(df[id_column], options.get("seed", SEED)).alias("key"),
        df[id_column].alias("id"),
        df[source_column].alias("source"),
        df[text_column].alias("text"),
        size.alias("size"),
        tie.alias("tie"),
    )
    joined = packed.join(_small(cuts), packed["source"].eqNullSafe(cuts["cut_source"]))
    names = ("key", "id", "size", "tie")
    here = F.struct(*names)
    cut = F.struct(*[F.col(f"cut.{c}").alias(c) for c in names])
    none = F.lit(None).cast("long")
    # A source with no cut is taken in whole epochs only.
    more = F.coalesce((here < cut).cast("int"), F.lit(0))
    copies = F.array_repeat(none, (F.col("epochs") + more).cast("int"))
    out = joined.select("row", "text", F.explode(copies).alias("words"))
    # Rows equal to the cut are one row here: some are whole once more, one is cut.
    part = F.col("cut._part")
    last = F.concat(
        F.array_repeat(none, F.col("whole").cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    at = joined.where(here == cut).groupBy("source").agg(
        F.first(F.struct("row", "text", last.alias("words"))).alias("at")
    )
    out = out.unionByName(at.select("at.row", "at.text", F.explode("at.words").alias("words")))
    text = F.when(F.col("words").isNull(), F.col("text")).otherwise(
        leading_words(F.col("text"), F.col("words"))
    )
    return out.select(
        *[(text if c == text_column else F.col("row")[c]).alias(c) for c in df.columns]
    )


def leading_words(text: Column, count: Column) -> Column:
    """The text's first ``count`` words, one space apart."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), F.lit(1))
    return F.array_join(F.slice(words, F.lit(1), count.cast("int")), " ")


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    taken, _ = take(documents, n_words(documents["text"]))
    return taken.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken"
    )


OP1_SQL = f"""
WITH rows AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)
              AS BIGINT) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM sources
), limits AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS ratio
  FROM weighed
), sums AS (
  SELECT *,
         sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - most
           AS most_before,
         sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - weight
           AS weight_before,
         sum(most) OVER () AS all_most, sum(weight) OVER () AS all_weight
  FROM limits
), levels AS (
  SELECT *, (0.75::DOUBLE * all_most - most_before) / (all_weight - weight_before) AS level
  FROM sums
), targets AS (
  SELECT source, source_size,
         CASE WHEN ratio <= level THEN most
              ELSE weight * (SELECT max(level) FROM levels WHERE ratio > level) END AS target
  FROM levels
), budgets AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 2 * source_size) AS budget FROM targets
), ordered AS (
  SELECT r.doc_id, r.source, r.size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         CAST(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) - r.size AS earlier
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size
            + greatest(0, least(size, budget - epochs * source_size - earlier)) AS BIGINT) AS taken
FROM ordered
"""
