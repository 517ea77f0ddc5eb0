"""Training logs, checkpoints and run summaries as queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP_PATTERN = r"checkpoint-(\d+)"


SEGMENTS = 1024  # at least; each holds about the same number of rows, whatever the order's values
_MOST_SEGMENTS = 1 << 16


def with_chunks(events: DataFrame, order: str, segments: int | None = None) -> DataFrame:
    """Add ``_chunk``, the number of the segment that a row's ``order`` falls in.

    Quantiles over all rows part the order, so far or bunched values cannot fill a segment with
    more than its share. The segment is found by binary search in their list. There are two
    segments per shuffle partition, so that they shrink as a larger job is cut finer.
    """
    if segments is None:
        tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        segments = max(SEGMENTS, min(2 * tasks, _MOST_SEGMENTS))
    shares = F.array(*[F.lit(i / segments) for i in range(1, segments)])
    marks = events.select(F.percentile_approx(order, shares, 4 * segments)).first()[0] or []
    # In double, which keeps the order of any two values: those it cannot tell apart stay together.
    edges = sorted({float(m) for m in marks})
    placed = events.withColumn("_order", F.col(order).cast("double"))
    splits = [float("-inf"), *edges, float("inf")]
    if len(splits) < 3:
        return placed.withColumn("_chunk", F.lit(0.0)).drop("_order")
    found = Bucketizer(splits=splits, inputCol="_order", outputCol="_chunk").transform(placed)
    return found.drop("_order")


def last_before(
    events: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str,
    segments: int | None = None,
) -> DataFrame:
    """Latest non-null ``value`` up to each row, per key, along a numeric ``order``.

    The order is cut into chunks of bounded share, so one busy key spreads over many tasks:
    a window runs within each (key, chunk), and the last value of each chunk, found by a
    plain aggregate, is carried to the later ones. Keys are not null; ``order`` is a whole
    number, unique per key.
    """
    placed = with_chunks(events, order, segments)

    # At most one row per key and chunk reaches this window.
    seen = placed.groupBy(*keys, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = seen.select(
        *keys, "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    local = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = placed.withColumn("_inside", F.last(value, ignorenulls=True).over(local))
    return inside.join(carried, [*keys, "_chunk"]).select(
        *events.columns, F.coalesce("_inside", "_carried").alias(name)
    )


def evaluations(events: DataFrame, keys: Sequence[str] = ("run", "session")) -> DataFrame:
    """Evaluation rows with the last training loss before them, null if there is none."""
    rows = last_before(events, keys, "seq", "loss", "train_loss")
    return rows.where("eval_loss is not null").select(
        *keys, "seq", "epoch", "train_loss", F.col("eval_loss").alias("val_loss")
    )


def upsert_epochs(evals: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """One row per (run, epoch): a later evaluation overwrites an earlier one."""
    return evals.groupBy(*keys, "epoch").agg(
        F.max_by("train_loss", "seq").alias("train_loss"),
        F.max_by("val_loss", "seq").alias("val_loss"),
    )


def fold_loss_log(events: DataFrame) -> DataFrame:
    """Loss history per (run, epoch) from the raw log.

    The last training loss does not carry over from one session to the next, so an
    evaluation that opens a session overwrites its epoch with a null training loss.
    """
    return upsert_epochs(evaluations(events))


def complete_rows(history: DataFrame) -> DataFrame:
    """Epochs that have both losses."""
    return history.dropna(subset=["train_loss", "val_loss"])


def gap_series(history: DataFrame) -> DataFrame:
    """Validation minus training loss per epoch, complete rows only."""
    return complete_rows(history).withColumn("gap", F.col("val_loss") - F.col("train_loss"))


def chronological(history: DataFrame) -> DataFrame:
    return history.orderBy("run", "epoch", "train_loss", "val_loss")


def gap_statistics(history: DataFrame) -> DataFrame:
    """Mean and population deviation of the gap per run."""
    return gap_series(history).groupBy("run").agg(
        F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap")
    )


def history_summary(history: DataFrame) -> DataFrame:
    """Epoch count and range, and the training loss of the last epoch, per run."""
    return history.groupBy("run").agg(
        F.count("*").alias("epochs"),
        F.min("epoch").alias("first_epoch"),
        F.max("epoch").alias("last_epoch"),
        F.max_by("train_loss", "epoch").alias("final_train_loss"),
    )


def best_epochs(history: DataFrame) -> DataFrame:
    """Epoch of the lowest validation loss per run; the earliest wins ties."""
    known = history.where("val_loss is not null")
    first = F.struct("val_loss", "epoch")
    return (
        known.groupBy("run")
        .agg(F.min(first).alias("best"))
        .select(
            "run", F.col("best.epoch").alias("best_epoch"), F.col("best.val_loss").alias("best_val_loss")
        )
    )


def step_of(path: Column) -> Column:
    """Step number in a checkpoint path, null when there is none."""
    digits = F.regexp_extract(path, STEP_PATTERN, 1)
    return F.when(digits != "", digits.cast("long"))


def checkpoint_table(checkpoints: DataFrame) -> DataFrame:
    """(run, path, step, epoch) from (run, path, state_epoch); paths without a step go."""
    epoch = F.coalesce(F.col("state_epoch").cast("int"), F.lit(0))
    rows = checkpoints.select("run", "path", step_of(F.col("path")).alias("step"), epoch.alias("epoch"))
    return rows.where("step is not null")


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """Checkpoint with the highest numeric step per run, with its epoch."""
    newest = F.max(F.struct("step", "path", "epoch")).alias("c")
    return checkpoints.groupBy("run").agg(newest).select("run", "c.path", "c.step", "c.epoch")


def checkpoint_per_epoch(checkpoints: DataFrame) -> DataFrame:
    """One checkpoint per (run, epoch); the highest step wins."""
    newest = F.max(F.struct("step", "path")).alias("c")
    return checkpoints.groupBy("run", "epoch").agg(newest).select("run", "epoch", "c.path", "c.step")


def nearest_checkpoints(best: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoint closest to the best epoch per run; ties take the smaller epoch.

    An exact epoch has distance 0 and so comes first by itself.
    """
    nearest = F.struct(
        F.abs(F.col("epoch") - F.col("best_epoch")).alias("distance"),
        F.col("epoch"),
        (-F.col("step")).alias("newest"),
        F.col("path"),
    )
    per_epoch = checkpoint_per_epoch(checkpoints)
    joined = best.join(per_epoch, "run", "left")
    return joined.groupBy("run", "best_epoch", "best_val_loss").agg(
        F.min(F.when(F.col("path").isNotNull(), nearest)).alias("c")
    ).select(
        "run",
        "best_epoch",
        "best_val_loss",
        F.col("c.path").alias("path"),
        F.col("c.epoch").alias("checkpoint_epoch"),
    )


def global_best(history: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The run and epoch with the lowest validation loss of all, and its checkpoint."""
    best = best_epochs(history).orderBy("best_val_loss", "best_epoch", "run").limit(1)
    return nearest_checkpoints(best, checkpoints)


def run_summary(
    history: DataFrame,
    auc: DataFrame,
    report: DataFrame,
    pair_counts: DataFrame,
    model_info: DataFrame,
    resumed: bool = False,
) -> DataFrame:
    """One record per run from the single results.

    ``auc`` is (run, auc), ``report`` is (run, report) and ``model_info`` (run, model_info), both as
    JSON strings, ``pair_counts`` is (run, training_samples, validation_samples).
    """
    best = best_epochs(history)
    span = history_summary(history)
    epoch_range = F.concat_ws(
        "-",
        F.format_string("%.0f", F.col("first_epoch").cast("double")),
        F.format_string("%.0f", F.col("last_epoch").cast("double")),
    )
    joined = span.join(best, "run", "left").join(auc, "run", "left")
    joined = joined.join(report, "run", "left").join(pair_counts, "run", "left")
    joined = joined.join(model_info, "run", "left")
    # The names of the record's fields.
    return joined.select(
        "run",
        "model_info",
        F.col("auc").alias("roc_auc"),
        "best_epoch",
        F.col("best_val_loss").alias("best_validation_loss"),
        F.col("final_train_loss").alias("final_training_loss"),
        F.col("report").alias("classification_report"),
        F.col("training_samples").alias("total_training_samples"),
        F.col("validation_samples").alias("total_validation_samples"),
        F.col("epochs").alias("total_epochs_trained"),
        epoch_range.alias("epoch_range"),
        F.lit("resumed" if resumed else "fresh_start").alias("training_sessions"),
        F.lit("global_across_all_epochs").alias("best_model_selection"),
        F.col("best_epoch").alias("globally_best_epoch"),
    )
