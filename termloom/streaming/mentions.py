"""Link a stream of mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from termloom.plans.linking import VectorLinker
from termloom.session import pinned, work_scope
from termloom.streaming.triggers import AVAILABLE_NOW


def link_stream(
    mentions: DataFrame,
    linker: VectorLinker,
    path: str,
    checkpoint: str,
    top_k: int = 10,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the hits of every micro-batch of (query_id, mention) below ``path``.

    Ranking windows are not allowed on streams, so each batch is ranked as a table. Its
    output folder is named by the batch id and replaced on a retry, which makes the sink
    idempotent. The linker's catalog is made ready once, before the first batch. By default
    runs over what is available, then stops.
    """

    linker.index()

    def link(batch: DataFrame, batch_id: int) -> None:
        with work_scope(batch.sparkSession):
            hits = linker.predict_rows(pinned(batch, "batch"), top_k)
            hits.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        mentions.writeStream.foreachBatch(link)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def linked(spark, path: str) -> DataFrame:
    """All hits written so far."""
    return spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))
