"""Accumulate verdicts from a stream of answers, with recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.operators.verdicts import parse_verdicts, verdict_metrics
from termloom.streaming.triggers import AVAILABLE_NOW


PART_RECORDS = 100  # a part of the partial results is closed after so many records


def distinct_answers(
    responses: DataFrame,
    request: Sequence[str],
    sent_at: str | None = None,
    delay: str = "1 hour",
) -> DataFrame:
    """Answers of a stream, one per ``request``, also when one comes again in a later batch.

    The requests seen are keyed state. Without ``sent_at`` they are kept for good; with that
    time column, a request is forgotten once the stream is ``delay`` past its answer, so the state
    stays bounded, and an answer that is later than that is left out.
    """
    if sent_at is None:
        return responses.dropDuplicates(list(request))
    return responses.withWatermark(sent_at, delay).dropDuplicatesWithinWatermark(list(request))


def write_verdict_stream(
    responses: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    part_records: int = PART_RECORDS,
) -> StreamingQuery:
    """Parse answers as they come and append them to files; a restart continues.

    A task closes a file after ``part_records`` records, so only its last one is smaller. Files are
    listed in the sink's log when their batch is committed; those of an aborted batch are never read.
    """
    return (
        parse_verdicts(responses)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("maxRecordsPerFile", part_records)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def write_verdict_totals(
    responses: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Running totals per model; each batch writes its totals to its own folder.

    A retried batch replaces its folder. ``verdict_totals`` reads the latest. Of an answer that is
    sent again, count one by ``distinct_answers``.
    """
    records = parse_verdicts(responses).withColumnRenamed("is_equivalent", "correct")

    def write(totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        verdict_metrics(records)
        .writeStream.foreachBatch(write)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def verdict_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals after the latest batch."""
    totals = spark.read.parquet(path)
    latest = totals.agg(F.max("batch_id")).first()[0]
    return totals.where(F.col("batch_id") == latest).drop("batch_id")
