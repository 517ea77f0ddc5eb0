"""From annotated lines to a deduplicated mention table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import strip

# Markers of the annotated text format.
COMMENT_MARK = "###"
TITLE_MARK = "|t|"
ABSTRACT_MARK = "|a|"
CONCEPT_PREFIX = "UMLS:"
FIELDS = ("pmid", "start", "end", "mention", "semantic_type", "concept_ref")


def is_annotation(line: Column) -> Column:
    """Title and abstract marks disqualify a line wherever they stand, mentions included."""
    return (
        ~line.startswith(COMMENT_MARK)
        & line.contains("\t")
        & ~line.contains(TITLE_MARK)
        & ~line.contains(ABSTRACT_MARK)
    )


def annotation_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.where(is_annotation(F.col(column)))


def parse_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """Split stripped lines on tabs; short lines go, extra fields are ignored.

    The one-element explode keeps later filters on the fields from being pushed below the
    split, which would strip and split every line once per filter.
    """
    fields = lines.select(F.explode(F.array(F.split(strip(F.col(column)), "\t"))).alias("f"))
    return fields.where(F.size("f") >= len(FIELDS)).select(
        *[F.col("f")[i].alias(name) for i, name in enumerate(FIELDS)]
    )


def concept_rows(fields: DataFrame, prefix: str = CONCEPT_PREFIX) -> DataFrame:
    """Keep references with the prefix and remove every occurrence of it."""
    return fields.where(F.col("concept_ref").startswith(prefix)).withColumn(
        "cui", F.replace("concept_ref", F.lit(prefix), F.lit(""))
    )


def annotations(lines: DataFrame, column: str = "value") -> DataFrame:
    """All line rules together: (pmid, mention, cui), duplicates kept."""
    rows = concept_rows(parse_fields(annotation_lines(lines, column), column))
    return rows.select("pmid", "mention", "cui")


def attach_entities(
    mentions: DataFrame, mapping: DataFrame, key: str = "cui"
) -> DataFrame:
    """Inner join with a mapping that is unique on ``key``.

    The mapping's size is unknown here, so no broadcast is forced: Spark broadcasts it
    below its size threshold and otherwise shuffles, splitting a hot key at run time.
    """
    return mentions.join(mapping, key)


def mention_table(annotated: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct (pmid, mention, cui, mondo_id).

    As the mapping is unique on cui, removing duplicates before the join gives the same
    rows; that shuffle spreads on the whole row, and the join carries fewer rows.
    """
    distinct = annotated.select("pmid", "mention", "cui").dropDuplicates()
    return attach_entities(distinct, mapping).select("pmid", "mention", "cui", "mondo_id")


def coverage(annotated: DataFrame, mapping: DataFrame, key: str = "cui") -> DataFrame:
    """References in total, references with a mapping, and their ratio in percent."""
    per_key = annotated.groupBy(key).agg(F.count("*").alias("n"))
    known = mapping.select(key, F.lit(True).alias("known"))
    joined = per_key.join(known, key, "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    mapped = F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))
    return joined.agg(
        total.alias("total_entities"),
        mapped.alias("mapped_entities"),
        F.try_divide(mapped * 100.0, total).alias("coverage_pct"),
    )


def split_report(df: DataFrame) -> DataFrame:
    """Rows and percentage of each split."""
    counts = df.groupBy("split").agg(F.count("*").alias("n"))
    # One row per split reaches this window.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("split", "n", (F.col("n") * 100.0 / total).alias("pct"))


def shared_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` on both sides: what a random split leaks."""
    return left.select(column).intersect(right.select(column))
