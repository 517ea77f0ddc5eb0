"""Writers and readers for splits, catalogs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.sources.corpus import MENTION_SCHEMA

METADATA_SCHEMA = (
    "model_name string, embedding_dim int, num_entities long, max_length int, "
    "normalization string, indexing_method string"
)


def write_splits(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per split, so a reader of one split lists only its own files."""
    writer = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
        # Keep surrounding blanks and tell empty text from a missing value.
        writer = writer.option("ignoreLeadingWhiteSpace", False)
        writer = writer.option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""')
    writer.format(fmt).save(path)


def read_splits(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(f"{MENTION_SCHEMA}, split string")
    if fmt == "csv":
        reader = reader.option("header", True).option("quote", '"').option("escape", '"')
    return reader.format(fmt).load(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Entity, text and vector in one keyed table; nothing depends on row position."""
    catalog.write.mode("overwrite").parquet(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalog_metadata(
    catalog: DataFrame, model_name: str, max_length: int | None, indexing_method: str
) -> DataFrame:
    """One row that describes a catalog."""
    return catalog.agg(
        F.lit(model_name).alias("model_name"),
        F.max(F.size("embedding")).alias("embedding_dim"),
        F.count("*").alias("num_entities"),
        F.lit(max_length).cast("int").alias("max_length"),
        F.lit("L2").alias("normalization"),
        F.lit(indexing_method).alias("indexing_method"),
    )


def write_metadata(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).json(path)


def results_by_model(metrics: DataFrame) -> DataFrame:
    """One row per model with a metric map; a model has a handful of metrics."""
    entries = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return metrics.groupBy("model").agg(F.map_from_entries(entries).alias("metrics"))


def results_document(metrics: DataFrame) -> DataFrame:
    """The nested model -> metric -> value document as one JSON string."""
    sorted_models = F.sort_array(F.collect_list(F.struct("model", "metrics")))
    models = F.map_from_entries(
        F.transform(
            sorted_models, lambda e: F.struct(e["model"], F.map_from_entries(e["metrics"]))
        )
    )
    return _with_sorted_metrics(metrics).agg(F.to_json(models).alias("document"))


def _with_sorted_metrics(metrics: DataFrame) -> DataFrame:
    """(model, metrics) with the metrics as an array, which sorts, then as a map."""
    entries = F.sort_array(F.collect_list(F.struct("metric", "value")))
    return metrics.groupBy("model").agg(entries.alias("metrics"))


def write_results(metrics: DataFrame, path: str) -> None:
    results_by_model(metrics).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Back to long form (model, metric, value)."""
    nested = spark.read.schema("model string, metrics map<string,double>").json(path)
    return nested.select("model", F.explode("metrics").alias("metric", "value"))


def write_verdicts(records: DataFrame, metrics: DataFrame, path: str) -> None:
    """Detailed verdict output: the metric record and the predictions, side by side."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    records.write.mode("overwrite").json(f"{path}/predictions")
