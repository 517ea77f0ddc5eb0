"""Verdicts of a language model, training logs and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import catalog as cat
from termloom.operators import classify, runs, verdicts
from termloom.operators.ordering import with_global_rank
from termloom.operators.ranking import rank_verdicts, verdict_scores
from termloom.plans.verdict_ranking import rank_attempts
from termloom.session import pinned, work_path
from termloom.sources import sinks
from workload import standins as s
from workload.linking import _REPORT, _ROC, _rounded
from workload.registry import query

# --- requests ----------------------------------------------------------------------------


def _prompt_sql(template: str) -> str:
    pieces = [piece.replace("'", "''") for piece in template.split("%s")]
    return f"'{pieces[0]}' || mention || '{pieces[1]}' || rep_text || '{pieces[2]}'"


_REQUESTS = s.MODE_CATALOG + f""", requests AS (
  SELECT pmid || '/' || cui || '/' || mention AS query_id, entity_id, ordinal // 10 + 1 AS batch,
    unnest(['gpt', 'gemini']) AS model, unnest([{_prompt_sql(verdicts.TEMPLATES["gpt"])},
      {_prompt_sql(verdicts.TEMPLATES["gemini"])}]) AS prompt
  FROM mentions JOIN catalog ON mondo_id = entity_id)"""


@query(
    "l1_request_table",
    f"WITH {_REQUESTS} SELECT query_id, entity_id, batch, model, md5(prompt) AS prompt FROM requests",
)
def l1(spark, sf):
    """One prompt per true pair and model."""
    rows = s.mentions(spark, sf)
    candidates = rows.select(
        F.concat_ws("/", "pmid", "cui", "mention").alias("query_id"),
        "mention",
        F.col("mondo_id").alias("entity_id"),
    )
    requests = verdicts.request_table(candidates, cat.build_catalog(rows), batch_size=10)
    return requests.withColumn("prompt", F.md5("prompt"))


# --- answers -----------------------------------------------------------------------------


@query(
    "l2_verdict_parse",
    f"WITH {s.VERDICTS} SELECT index, is_equivalent, md5(text) AS explanation FROM verdicts",
)
def l2(spark, sf):
    parsed = verdicts.parse_verdicts(s.answers(spark, sf))
    return parsed.select("index", "is_equivalent", F.md5("explanation").alias("explanation"))


@query(
    "l3_assemble_text",
    """WITH lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p
      FROM documents)
    SELECT doc_id, md5(CASE WHEN len(p) = 0 THEN 'ERROR: Empty response content' ELSE
      regexp_replace(array_to_string(p, ' '), '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g')
    END) AS text FROM lines""",
)
def l3(spark, sf):
    """The lines of a document as answer parts; empty lines are null parts."""
    docs = s.table(spark, sf, "documents")
    parts = F.transform(F.split("text", "\n"), lambda p: F.when(p != "", p))
    return docs.select("doc_id", F.md5(verdicts.assemble_text(parts)).alias("text"))


@query(
    "l4_resolve_attempts",
    f"WITH {s.RESOLVED} SELECT request_id, md5(text) AS text, attempts, "
    "CAST(wait_seconds AS DOUBLE) AS wait_seconds FROM answered",
)
def l4(spark, sf):
    return verdicts.resolve_attempts(s.attempts(spark, sf)).withColumn("text", F.md5("text"))


@query(
    "l4_resolve_attempts_all",
    f"WITH {s.resolved_sql(None, s.GEMINI_LIMITED, 5)} SELECT request_id, md5(text) AS text, attempts, "
    "CAST(wait_seconds AS DOUBLE) AS wait_seconds FROM answered",
)
def l4_all(spark, sf):
    """Every recorded attempt counts, under the second model's rules."""
    resolved = verdicts.resolve_attempts(s.attempts(spark, sf), model="gemini", retries=None)
    return resolved.withColumn("text", F.md5("text"))


@query(
    "l5_failure_backoff_gemini",
    f"""WITH {s.ATTEMPTS} SELECT request_id, attempt, CASE WHEN ok THEN 'none'
      WHEN {s.GEMINI_LIMITED} THEN 'rate_limit' ELSE 'other' END AS failure,
      CAST({s.GEMINI_WAIT} AS DOUBLE) AS wait_seconds FROM attempts""",
)
def l5_gemini(spark, sf):
    rows = verdicts.with_backoff(s.attempts(spark, sf), "gemini")
    return rows.select("request_id", "attempt", "failure", "wait_seconds")


@query(
    "l5_failure_backoff",
    f"""WITH {s.ATTEMPTS} SELECT request_id, attempt, CASE WHEN ok THEN 'none'
      WHEN {s.RATE_LIMITED} THEN 'rate_limit' ELSE 'other' END AS failure,
      CAST({s.WAIT} AS DOUBLE) AS wait_seconds FROM attempts""",
)
def l5(spark, sf):
    rows = verdicts.with_backoff(s.attempts(spark, sf))
    return rows.select("request_id", "attempt", "failure", "wait_seconds")


@query(
    "l6_verdict_score",
    f"WITH {s.VERDICTS} SELECT index, CAST(is_equivalent AS INTEGER)::DOUBLE AS score FROM verdicts",
)
def l6(spark, sf):
    scored = verdict_scores(verdicts.parse_verdicts(s.answers(spark, sf)))
    return scored.select("index", "score")


def _records(spark, sf):
    """Answers to half of the rows are missing: those without a quality label."""
    rows = s.table(spark, sf, "documents").select(
        F.col("doc_id").alias("index"),
        F.col("lang").alias("mention"),
        F.col("source").alias("true_mondo"),
    )
    labelled = s.table(spark, sf, "labels").select(F.col("doc_id").alias("index"))
    responses = s.answers(spark, sf).join(labelled, "index", "left_semi")
    return verdicts.verdict_records(rows, responses)


_RECORDS = s.VERDICTS + """, records AS (
  SELECT v.index, v.mention, v.true_mondo, CASE WHEN l.doc_id IS NULL THEN FALSE
    ELSE is_equivalent END AS prediction, CASE WHEN l.doc_id IS NULL
    THEN 'ERROR: No response generated' ELSE text END AS explanation
  FROM verdicts v LEFT JOIN labels l ON l.doc_id = v.index)"""


@query(
    "l7_verdict_records",
    f"WITH {_RECORDS} SELECT index, mention, true_mondo, prediction, md5(explanation) AS explanation, "
    "prediction AS correct FROM records",
)
def l7(spark, sf):
    return _records(spark, sf).withColumn("explanation", F.md5("explanation"))


@query(
    "o8_input_order",
    f"WITH {_RECORDS} SELECT index, prediction, row_number() OVER (ORDER BY index) - 1 AS position "
    "FROM records",
)
def o8(spark, sf):
    """The position comes from the order that the rows are written in."""
    return with_global_rank(_records(spark, sf).select("index", "prediction"), ["index"])


@query(
    "s9_verdict_sink",
    f"""WITH {_RECORDS}, totals AS (SELECT count(*) AS total_samples,
      count(CASE WHEN prediction THEN 1 END) AS correct_predictions,
      count(CASE WHEN starts_with(explanation, 'ERROR') THEN 1 END) AS errors FROM records)
    SELECT index, mention, true_mondo, prediction, md5(explanation) AS explanation,
      prediction AS correct, totals.*, round(correct_predictions / total_samples, 6) AS accuracy,
      round(errors / total_samples, 6) AS error_rate FROM records, totals""",
)
def s9(spark, sf):
    """Predictions and the metric record, both read back; each row carries the one record."""
    path = work_path(spark, "verdicts")
    records = _records(spark, sf)
    metrics = verdicts.verdict_metrics(records.withColumn("model", F.lit("gpt")))
    sinks.write_verdicts(records, metrics, path)
    back = spark.read.schema(records.schema).json(f"{path}/predictions")
    record = spark.read.schema(metrics.schema).json(f"{path}/metrics").drop("model").first()
    back = back.withColumns({name: F.lit(record[name]) for name in record.asDict()})
    return _rounded(back.withColumn("explanation", F.md5("explanation")), "accuracy", "error_rate")


_METRICS = _RECORDS + """, metrics AS (
  SELECT mention AS model, count(*) AS total_samples,
    count(CASE WHEN prediction THEN 1 END) AS correct_predictions,
    count(CASE WHEN starts_with(explanation, 'ERROR') THEN 1 END) AS errors
  FROM records GROUP BY mention)"""


def _metrics(spark, sf):
    """One metric record per language, in the place of the model."""
    return verdicts.verdict_metrics(_records(spark, sf).withColumnRenamed("mention", "model"))


@query(
    "a10_verdict_accuracy",
    f"WITH {_METRICS} SELECT model, round(correct_predictions / total_samples, 6) AS accuracy FROM metrics",
)
def a10(spark, sf):
    return _rounded(_metrics(spark, sf).select("model", "accuracy"), "accuracy")


@query(
    "a11_error_rate",
    f"WITH {_METRICS} SELECT model, errors, round(errors / total_samples, 6) AS error_rate FROM metrics",
)
def a11(spark, sf):
    return _rounded(_metrics(spark, sf).select("model", "errors", "error_rate"), "error_rate")


@query(
    "a12_verdict_metrics",
    f"WITH {_METRICS} SELECT *, round(correct_predictions / total_samples, 6) AS accuracy, "
    "round(errors / total_samples, 6) AS error_rate FROM metrics",
)
def a12(spark, sf):
    return _rounded(_metrics(spark, sf), "accuracy", "error_rate")


@query(
    "o7_verdict_ranking",
    f"""WITH {s.VERDICTS} SELECT query_id, entity_id, score, rank FROM (
      SELECT true_mondo AS query_id, index AS entity_id, is_equivalent::INTEGER::DOUBLE AS score,
        CAST(row_number() OVER (PARTITION BY true_mondo ORDER BY is_equivalent DESC, index)
        AS INTEGER) AS rank FROM verdicts) WHERE rank <= 10""",
)
def o7(spark, sf):
    """Documents ranked within their source, equal verdicts in candidate order."""
    answered = verdicts.parse_verdicts(s.answers(spark, sf)).select(
        F.col("true_mondo").alias("query_id"),
        F.col("index").alias("entity_id"),
        F.col("index").alias("ordinal"),
        "is_equivalent",
    )
    ranked = rank_verdicts(answered, 10)
    return ranked.select("query_id", "entity_id", "score", "rank")


@query(
    "o7_ranking_from_attempts",
    f"""WITH {s.RESOLVED}, judged AS (
      SELECT c_nationkey AS query_id, c_custkey AS entity_id, CASE WHEN text IS NULL
        OR starts_with(text, 'ERROR') THEN 0.0
        WHEN starts_with(upper(text), 'YES') THEN 1.0 ELSE 0.0 END AS score
      FROM customer LEFT JOIN answered ON request_id = c_custkey)
    SELECT query_id, entity_id, CAST(score AS DOUBLE) AS score, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id)
      AS INTEGER) AS rank FROM judged) WHERE rank <= 10""",
)
def o7_attempts(spark, sf):
    """Attempt log to ranked lists: customers as requests, ranked within their nation."""
    requests = s.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.col("c_nationkey").alias("query_id"),
        F.col("c_custkey").alias("entity_id"),
        F.col("c_custkey").alias("ordinal"),
    )
    ranked = rank_attempts(s.attempts(spark, sf), requests, 10)
    return ranked.select("query_id", "entity_id", "score", "rank")


# --- loss log ----------------------------------------------------------------------------


@query(
    "j8_last_train_loss",
    f"WITH {s.LOSS} SELECT run, session, seq, epoch, train_loss, val_loss FROM evals",
)
def j8(spark, sf):
    return runs.evaluations(s.loss_events(spark, sf))


@query(
    "j8_last_train_loss_one_run",
    f"WITH {s.loss_sql(chr(39) + 'all' + chr(39))} "
    "SELECT run, session, seq, epoch, train_loss, val_loss FROM evals",
)
def j8_one_run(spark, sf):
    """The same with every event in a single run."""
    return runs.evaluations(s.loss_events(spark, sf, one_run=True))


@query(
    "j8_last_train_loss_sparse_order",
    f"WITH {s.loss_sql(chr(39) + 'all' + chr(39), s.FAR_SEQ)} "
    "SELECT run, session, seq, epoch, train_loss, val_loss FROM evals",
)
def j8_sparse(spark, sf):
    """A single run with a few events far behind all others."""
    events = s.loss_events(spark, sf, one_run=True)
    return runs.evaluations(events.withColumn("seq", F.expr(s.FAR_SEQ.replace("event_id", "seq"))))


@query(
    "o12_epoch_upsert",
    f"WITH {s.LOSS} SELECT run, epoch, train_loss, val_loss FROM history",
)
def o12(spark, sf):
    return runs.upsert_epochs(runs.evaluations(s.loss_events(spark, sf)))


@query("r2_fold_loss_log", f"WITH {s.LOSS} SELECT * FROM history")
def r2(spark, sf):
    return runs.fold_loss_log(s.loss_events(spark, sf))


@query(
    "p7_complete_rows",
    f"WITH {s.LOSS} SELECT * FROM history WHERE train_loss IS NOT NULL AND val_loss IS NOT NULL",
)
def p7(spark, sf):
    return runs.complete_rows(runs.fold_loss_log(s.loss_events(spark, sf)))


@query(
    "r3_gap_series",
    f"WITH {s.LOSS} SELECT *, round(val_loss - train_loss, 6) AS gap FROM history "
    "WHERE train_loss IS NOT NULL AND val_loss IS NOT NULL",
)
def r3(spark, sf):
    return _rounded(runs.gap_series(runs.fold_loss_log(s.loss_events(spark, sf))), "gap")


@query(
    "o9_chronological",
    f"WITH {s.LOSS} SELECT *, row_number() OVER (ORDER BY run, epoch) - 1 AS position FROM history",
)
def o9(spark, sf):
    history = runs.fold_loss_log(s.loss_events(spark, sf))
    return with_global_rank(history, ["run", "epoch", "train_loss", "val_loss"])


@query(
    "a16_gap_statistics",
    f"WITH {s.LOSS} SELECT run, round(avg(val_loss - train_loss), 6) AS mean_gap, "
    "round(stddev_pop(val_loss - train_loss), 6) AS std_gap FROM history "
    "WHERE train_loss IS NOT NULL AND val_loss IS NOT NULL GROUP BY run",
)
def a16(spark, sf):
    stats = runs.gap_statistics(runs.fold_loss_log(s.loss_events(spark, sf)))
    return _rounded(stats, "mean_gap", "std_gap")


@query(
    "a17_history_summary",
    f"WITH {s.LOSS} SELECT run, count(*) AS epochs, min(epoch) AS first_epoch, "
    "max(epoch) AS last_epoch, arg_max_null(train_loss, epoch) AS final_train_loss "
    "FROM history GROUP BY run",
)
def a17(spark, sf):
    return runs.history_summary(runs.fold_loss_log(s.loss_events(spark, sf)))


@query("a19_best_epoch", f"WITH {s.BEST} SELECT * FROM best")
def a19(spark, sf):
    return runs.best_epochs(runs.fold_loss_log(s.loss_events(spark, sf)))


# --- checkpoints -------------------------------------------------------------------------


@query("r4_step_from_path", f"WITH {s.CHECKPOINTS} SELECT path, step FROM steps")
def r4(spark, sf):
    return runs.checkpoint_table(s.checkpoints(spark, sf)).select("path", "step")


@query("r5_checkpoint_epoch", f"WITH {s.CHECKPOINTS} SELECT * FROM epoch_steps")
def r5(spark, sf):
    return runs.checkpoint_per_epoch(runs.checkpoint_table(s.checkpoints(spark, sf)))


@query(
    "o10_latest_checkpoint",
    f"""WITH {s.CHECKPOINTS} SELECT run, path, step, epoch FROM (
      SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM steps) WHERE r = 1""",
)
def o10(spark, sf):
    return runs.latest_checkpoints(runs.checkpoint_table(s.checkpoints(spark, sf)))


_NEAREST = s.BEST + ", " + s.CHECKPOINTS + """, nearest AS (
  SELECT run, best_epoch, best_val_loss, path, checkpoint_epoch FROM (
    SELECT b.*, c.path, c.epoch AS checkpoint_epoch, row_number() OVER (PARTITION BY b.run
      ORDER BY abs(c.epoch - best_epoch), c.epoch, c.step DESC) AS r
    FROM best b LEFT JOIN epoch_steps c USING (run)) WHERE r = 1)"""


@query("j7_nearest_checkpoint", f"WITH {_NEAREST} SELECT * FROM nearest")
def j7(spark, sf):
    best = runs.best_epochs(runs.fold_loss_log(s.loss_events(spark, sf)))
    return runs.nearest_checkpoints(best, runs.checkpoint_table(s.checkpoints(spark, sf)))


@query(
    "m3_global_best",
    f"WITH {_NEAREST} SELECT * FROM nearest ORDER BY best_val_loss, best_epoch, run LIMIT 1",
)
def m3(spark, sf):
    history = runs.fold_loss_log(s.loss_events(spark, sf))
    return runs.global_best(history, runs.checkpoint_table(s.checkpoints(spark, sf)))


@query(
    "m3_validation_log_loss",
    f"""WITH {s.SCORES} SELECT round(-avg(CASE WHEN label = 1 THEN ln(greatest(score, 1e-15))
      ELSE ln(greatest(1 - score, 1e-15)) END), 6) AS log_loss FROM scores""",
)
def m3_loss(spark, sf):
    """Validation loss of scored rows, the figure the best model is chosen by."""
    return _rounded(s.binary_scores(spark, sf).agg(classify.log_loss().alias("log_loss")), "log_loss")


_REPORT_CELLS = [
    (row, metric, f"{row.replace(' ', '_').replace('.', '_')}_{metric}")
    for row in ("0.0", "1.0", "accuracy", "macro avg", "weighted avg")
    for metric in ("precision", "recall", "f1", "support")
]


@query(
    "r10_run_summary",
    f"""WITH {s.loss_sql(chr(39) + 'all' + chr(39))}, {_ROC}, {_REPORT.split(s.SCORES + ", ")[1]},
    best AS (SELECT epoch, val_loss FROM history ORDER BY val_loss, epoch LIMIT 1)
    SELECT 'all' AS run,
      '{{"model_name":"set weights","events":' || (SELECT count(*) FROM events) || '}}' AS model_info,
      (SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) FROM running) AS roc_auc,
      (SELECT epoch FROM best) AS best_epoch, (SELECT val_loss FROM best) AS best_validation_loss,
      arg_max_null(train_loss, epoch) AS final_training_loss,
      {", ".join(f"""(SELECT round(CAST({m} AS DOUBLE), 6) FROM report WHERE "row" = '{r}') AS "{n}" """
                 for r, m, n in _REPORT_CELLS)},
      (SELECT count(*) FROM documents) - (SELECT count(*) FROM scores) AS total_training_samples,
      (SELECT count(*) FROM scores) AS total_validation_samples,
      count(*) AS total_epochs_trained,
      CAST(min(epoch)::INTEGER AS VARCHAR) || '-' || CAST(max(epoch)::INTEGER AS VARCHAR) AS epoch_range,
      'fresh_start' AS training_sessions, 'global_across_all_epochs' AS best_model_selection,
      (SELECT epoch FROM best) AS globally_best_epoch FROM history""",
)
def r10(spark, sf):
    """All events as one run; labelled documents validate, the others train; the report unfolded."""
    scored = s.binary_scores(spark, sf)
    run = F.lit("all").alias("run")
    report = classify.classification_report(scored)
    whole = F.map_from_entries(F.collect_list(F.struct("row", F.struct("precision", "recall", "f1", "support"))))
    every = s.table(spark, sf, "documents").select(F.count("*")).scalar()
    counts = scored.agg(F.count("*").alias("validation_samples")).select(
        run, (every - F.col("validation_samples")).alias("training_samples"), "validation_samples"
    )
    info = s.table(spark, sf, "events").agg(F.count("*").alias("events")).select(
        run, F.to_json(F.struct(F.lit("set weights").alias("model_name"), "events")).alias("model_info")
    )
    # The parts are recorded tables, as after a finished run.
    summary = runs.run_summary(
        pinned(runs.fold_loss_log(s.loss_events(spark, sf, one_run=True))),
        pinned(classify.roc_auc(scored).select(run, "auc")),
        pinned(report.agg(F.to_json(whole).alias("report")).select(run, "report")),
        pinned(counts),
        pinned(info),
    )
    cells = {
        name: F.get_json_object("classification_report", f"$['{row}'].{metric}").cast("double")
        for row, metric, name in _REPORT_CELLS
    }
    unfolded = summary.withColumns(cells).drop("classification_report")
    return _rounded(unfolded, "roc_auc", *cells)
