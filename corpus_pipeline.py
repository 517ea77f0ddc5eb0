"""Documents to packed sequences: filter, drop copies, remove repeats, mix, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from termloom.llm.common import table
from termloom.session import pinned, use_local_dir

# Workers that ran other stages before have less memory left for a block or a group.
BLOCK_BYTES = 1 << 20
GROUP_KEYS = 1 << 17


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep."""
    return quality_rules.kept_rows(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of linked documents."""
    use_local_dir(spark)
    return ngram_join.one_of_each(docs, block_bytes=BLOCK_BYTES)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of earlier documents; a text of which nothing is left goes."""
    use_local_dir(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"column_{i}_of_documents" for i, c in enumerate(others)}
    found = suffix_dedup.dedup(
        docs.withColumnsRenamed(names),
        extra=list(names.values()),
        with_text=True,
        block_bytes=BLOCK_BYTES,
        group_keys=GROUP_KEYS,
    )
    found = found.where((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    cells = {c: F.col(name) for c, name in names.items()}
    cells |= {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    n_chars = F.length("kept_text").cast("long")
    cells["n_chars"] = F.when(F.col("n_removed") > 0, n_chars).otherwise(cells["n_chars"])
    return found.select(*[cells[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's share takes it; the last one cut to fit."""
    use_local_dir(spark)
    mixed = mixing.mixed_rows(docs)
    n_chars = F.length("text").cast("long")
    return mixed.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a document that the mix repeats is packed as often."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_copies),
    ("suffix_dedup", repeats),
    ("mixing", mix),
    ("packing", pack),
]

# A forest of random splits and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
