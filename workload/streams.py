"""Streaming jobs, run to the end over files derived from the given tables.

Each result is compared with the SQL of the same work on the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.session import pinned, work_path
from termloom.streaming.losses import current_history, fold_stream
from termloom.streaming.mentions import link_stream, linked
from termloom.streaming.verdicts import (
    distinct_answers,
    verdict_totals,
    write_verdict_stream,
    write_verdict_totals,
)
from termloom.plans.linking import VectorLinker, vector_catalog
from workload import standins as s
from workload.linking import _MENTION_HITS
from workload.registry import query

_BATCHES = 3


def _as_stream(spark, df, *order):
    """Write ``df`` as files in order, and read them as a stream of ``_BATCHES`` batches or few more.

    A file holds that share of the rows at most, and the files of a large table are those of its range
    partitions, whose number the session sets, so that no task writes or reads a whole batch.
    """
    path = work_path(spark, "source")
    rows = max(-(-df.count() // _BATCHES), 1)
    df.repartitionByRange(*order).write.option("maxRecordsPerFile", rows).parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    source = spark.readStream.schema(df.schema)
    return source.option("maxFilesPerTrigger", max(files // _BATCHES, 1)).parquet(path)


@query(
    "t1_link_stream",
    f"""WITH {_MENTION_HITS} SELECT pmid, mention, cui, entity_id, rank
    FROM mentions JOIN mention_hits USING (mention) WHERE rank <= 3""",
)
def t1(spark, sf):
    rows = pinned(s.mentions(spark, sf))
    linker = VectorLinker(pinned(vector_catalog(rows)))
    out = work_path(spark, "links")
    stream = _as_stream(spark, rows, "pmid")
    link_stream(stream, linker, out, work_path(spark, "offsets"), 3).awaitTermination()
    return linked(spark, out).select("pmid", "mention", "cui", "entity_id", "rank")


@query("t2_fold_stream", f"WITH {s.LOSS} SELECT * FROM history")
def t2(spark, sf):
    """Events reach the stream by value, not by time, so many are late."""
    stream = _as_stream(spark, s.loss_events(spark, sf), F.coalesce("loss", "eval_loss"))
    out = work_path(spark, "history")
    # Places are spread over all runs here, so a wide segment still holds few events, of many
    # sessions.
    offsets = work_path(spark, "offsets")
    fold_stream(stream, out, offsets, width=1 << 16, spread=16).awaitTermination()
    return current_history(spark, out)


@query(
    "t3_verdict_stream",
    f"WITH {s.VERDICTS} SELECT index, is_equivalent, md5(text) AS explanation FROM verdicts",
)
def t3(spark, sf):
    stream = _as_stream(spark, s.answers(spark, sf), "index")
    out = work_path(spark, "verdicts")
    write_verdict_stream(stream, out, work_path(spark, "offsets")).awaitTermination()
    done = spark.read.parquet(out)
    return done.select("index", "is_equivalent", F.md5("explanation").alias("explanation"))


_TOTALS = f"""WITH {s.VERDICTS} SELECT mention AS model, count(*) AS total_samples,
      count(CASE WHEN is_equivalent THEN 1 END) AS correct_predictions,
      count(CASE WHEN starts_with(text, 'ERROR') THEN 1 END) AS errors
    FROM verdicts GROUP BY mention"""


@query("t3_repeated_answers", _TOTALS)
def t3_repeated(spark, sf):
    """Two thirds of the answers come again in a later batch; totals count each once."""
    answers = s.answers(spark, sf).withColumnRenamed("mention", "model")
    later = answers.select(F.max("index") + 1).scalar()
    sent = answers.withColumn("sent", F.col("index"))
    for again in (1, 2):
        copies = answers.where(F.col("index") % 3 == again)
        sent = sent.unionByName(copies.withColumn("sent", F.col("index") + again * later))
    stream = distinct_answers(_as_stream(spark, sent, "sent"), ["index"])
    out = work_path(spark, "totals")
    write_verdict_totals(stream, out, work_path(spark, "offsets")).awaitTermination()
    totals = verdict_totals(spark, out)
    return totals.select("model", "total_samples", "correct_predictions", "errors")


@query("t3_verdict_totals", _TOTALS)
def t3_totals(spark, sf):
    answers = s.answers(spark, sf).withColumnRenamed("mention", "model")
    stream = _as_stream(spark, answers, "index")
    out = work_path(spark, "totals")
    write_verdict_totals(stream, out, work_path(spark, "offsets")).awaitTermination()
    totals = verdict_totals(spark, out)
    return totals.select("model", "total_samples", "correct_predictions", "errors")


@query(
    "s10_partial_results",
    f"WITH {s.VERDICTS} SELECT index, is_equivalent FROM verdicts",
)
def s10(spark, sf):
    """Stop after the first files, add the rest, and continue from the checkpoint."""
    answers = pinned(s.answers(spark, sf))
    middle = answers.select(F.expr("percentile_approx(index, 0.5)")).scalar()
    source, out, offsets = (work_path(spark, n) for n in ("source", "verdicts", "offsets"))
    for part in (answers.where(F.col("index") <= middle), answers.where(F.col("index") > middle)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(answers.schema).parquet(source)
        write_verdict_stream(stream, out, offsets).awaitTermination()
    return spark.read.parquet(out).select("index", "is_equivalent")
