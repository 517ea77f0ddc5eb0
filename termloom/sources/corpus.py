"""Readers for annotated text, concept mappings and mention tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import strip

# Column layout of the saved mention tables.
MENTION_SCHEMA = "pmid string, mention string, cui string, mondo_id string"


def file_order() -> Column:
    """Position of a line: file, then block, then row within the block.

    Only the relative order matters, so it holds however files are packed into tasks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Annotated corpus, one row per line in column ``value``."""
    return spark.read.text(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Two-field tab-separated mapping; the last line of a repeated key wins.

    Blank lines are skipped, any other line without exactly two fields fails the job.
    """
    fields = F.split(strip(F.col("value")), "\t")
    checked = F.when(F.size(fields) == 2, fields).otherwise(
        F.raise_error(F.concat(F.lit("not a mapping line: "), F.col("value")))
    )
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    pairs = lines.select(checked.alias("f"), file_order().alias("version")).select(
        F.col("f")[0].alias("cui"), F.col("f")[1].alias("mondo_id"), "version"
    )
    return latest_mapping(pairs, "cui", "mondo_id", "version")


def latest_mapping(df: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """Keep the value of the highest version per key."""
    return df.groupBy(key).agg(F.max_by(value, version).alias(value))


def strict_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mapping without versions: equal duplicates merge, conflicting ones fail the job."""
    conflict = F.concat(F.lit("conflicting values for key "), F.col(key).cast("string"))
    return (
        df.groupBy(key)
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .select(
            key,
            F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
            .otherwise(F.raise_error(conflict))
            .alias(value),
        )
    )


def read_mentions(spark: SparkSession, path: str, with_order: bool = False) -> DataFrame:
    """Mention CSV with a header and RFC quotes; texts such as ``NA`` stay text."""
    df = (
        spark.read.schema(MENTION_SCHEMA)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return df.withColumn("file_order", file_order()) if with_order else df
