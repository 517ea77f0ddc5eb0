"""Annotated corpus and mapping in, deduplicated and split mention table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.operators.ordering import exact_split
from termloom.operators.prepare import annotations, coverage, mention_table, split_report
from termloom.session import pinned
from termloom.sources.corpus import read_lines, read_mapping
from termloom.sources.sinks import read_splits, write_splits

ROW_COLUMNS = ("pmid", "mention", "cui", "mondo_id")


def split_mentions(lines: DataFrame, mapping: DataFrame, seed: int = 42) -> DataFrame:
    """Mention table with an exact, reproducible 80/10/10 ``split`` column.

    The table is pinned once, since finding the cuts reads it twice before the labels.
    """
    table = pinned(mention_table(annotations(lines), mapping), "mentions")
    return exact_split(table, ROW_COLUMNS, seed)


def prepare(
    spark: SparkSession,
    corpus_path: str,
    mapping_path: str,
    out_path: str,
    seed: int = 42,
    fmt: str = "csv",
) -> dict[str, DataFrame]:
    """Run the whole preparation and return its coverage and split reports."""
    lines = read_lines(spark, corpus_path)
    mapping = read_mapping(spark, mapping_path)
    write_splits(split_mentions(lines, mapping, seed), out_path, fmt)
    return {
        "coverage": coverage(annotations(lines), mapping),
        "splits": split_report(read_splits(spark, out_path, fmt)),
    }
