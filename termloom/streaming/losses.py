"""Fold a stream of loss events into a history table.

The state is keyed by (run, session, segment), a segment being a range of ``width`` places of the
log. As places are whole numbers, a segment holds ``width`` events at most, so one busy
session spreads over many keys, and a batch reads and writes the segments its events fall
into, however long the log has become. Within its segment an evaluation follows from the
losses there. One before the first loss of its segment takes the last loss of an earlier
segment, which is looked up when the history is read; so a late loss rewrites nothing beyond
the next loss in its own segment.

A log of many sessions with a few events each would be a state for each few events. With
``spread`` a state holds the sessions of one of so many parts, by the hash of run and session,
so there are ``spread`` states at most for a segment; their results are the same.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termloom.operators.runs import upsert_epochs
from termloom.streaming.triggers import AVAILABLE_NOW

EVENT_SCHEMA = "run string, session string, seq long, epoch double, loss double, eval_loss double"
WIDTH = 1024  # places of a segment, and so its events at most
_KEYS = ["run", "session", "segment"]
_LOSS, _EVAL = 1, 2  # bits of ``known``: pandas cannot tell a missing loss from one that is NaN
_CHANGES = """run string, session string, segment long, seq long, epoch double, train_loss double,
  val_loss double, known int, read long"""


class Segment:
    """Events of a session in a segment, in order; later ones replace those of the same place."""

    def __init__(self, events: dict[int, tuple]):
        self.events = events

    def evaluations(self) -> dict[int | None, tuple]:
        """(epoch, last loss, evaluation loss) by place; without place, the segment's last loss."""
        found, last = {}, None
        for seq in sorted(self.events):
            epoch, loss, eval_loss = self.events[seq]
            last = last if loss is None else loss
            if eval_loss is not None:
                found[seq] = (epoch, last, eval_loss)
        return {**found, None: (None, last, None)}

    def added(self, events: dict[int, tuple]) -> list[tuple]:
        """Add events; (place, evaluation) of what changed of the evaluations and the last loss."""
        before = self.evaluations() if self.events else {}
        self.events.update(events)
        after = self.evaluations()
        # By their text, as a loss that is NaN is not equal to itself.
        rows = [(seq, *c) for seq, c in after.items() if repr(c) != repr(before.get(seq))]
        # A repeated event may take an evaluation away: then its loss is not known.
        return rows + [(seq, before[seq][0], None, None) for seq in before.keys() - after.keys()]


def _new_events(parts: Iterator[pd.DataFrame]) -> dict[tuple[str, str], dict[int, tuple]]:
    """Events by session and place."""
    found: dict[tuple[str, str], dict[int, tuple]] = {}
    names = ("run", "session", "seq", "epoch", "loss", "eval_loss", "known")
    for part in parts:
        columns = (part[c].tolist() for c in names)
        for run, session, seq, epoch, loss, eval_loss, known in zip(*columns, strict=True):
            loss = loss if known & _LOSS else None
            event = (epoch, loss, eval_loss if known & _EVAL else None)
            found.setdefault((run, session), {})[seq] = event
    return found


def _fold_segment(
    key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Merge new events into the sessions of a state; what changed in those they belong to.

    ``read`` counts the events that were taken from the state, once per state and batch.
    """
    held = pickle.loads(state.get[0]) if state.exists else {}
    read = sum(map(len, held.values()))
    rows = []
    for session, events in _new_events(parts).items():
        segment = Segment(held.setdefault(session, {}))
        changed = segment.added(events) or [(None, *segment.evaluations()[None])]
        rows += [(*session, key[-1], *row) for row in changed]
    state.update((pickle.dumps(held),))
    out = pd.DataFrame(rows, columns=[*_KEYS, "seq", "epoch", "train_loss", "val_loss"])
    out["known"] = [(c[5] is not None) * _LOSS + (c[6] is not None) * _EVAL for c in rows]
    out["read"] = [0] * (len(rows) - 1) + [read]
    yield out.astype({"seq": "Int64", "epoch": float, "train_loss": float, "val_loss": float})


def fold_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    width: int = WIDTH,
    trigger: dict | None = None,
    spread: int | None = None,
) -> StreamingQuery:
    """Keep the evaluations of every run current, late events included.

    Each batch writes what it changed to its own folder, which a retry replaces; the state of
    the batch before is taken from the checkpoint, so a retried batch leaves the same tables.
    An event that comes again replaces the one of its place. Events without run, session or
    place are left out. By default runs over what is available, then stops.

    With ``spread`` sessions share so many states for a segment; choose it so that the events of all
    sessions in a segment, divided by it, fit a task. Without it each session has its own. A
    checkpoint goes on with the ``spread`` it began with.
    """
    placed = events.dropna(subset=["run", "session", "seq"]).withColumn(
        "segment", F.expr(f"(seq - pmod(seq, {int(width)})) div {int(width)}")
    )
    known = F.when(F.col("loss").isNotNull(), _LOSS).otherwise(0)
    known = known + F.when(F.col("eval_loss").isNotNull(), _EVAL).otherwise(0)
    placed = placed.withColumn("known", known)
    keys = _KEYS
    if spread is not None:
        keys = ["part", "segment"]
        placed = placed.withColumn("part", F.pmod(F.xxhash64("run", "session"), F.lit(int(spread))))
    changes = placed.groupBy(*keys).applyInPandasWithState(
        _fold_segment, _CHANGES, "events binary", "update", GroupStateTimeout.NoTimeout
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")

    return (
        changes.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def _changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_CHANGES}, batch_id long").parquet(f"{path}/changes")


def events_read(spark: SparkSession, path: str) -> DataFrame:
    """Events that each batch took from the state: (batch_id, events)."""
    return _changes(spark, path).groupBy("batch_id").agg(F.sum("read").alias("events"))


def current_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Latest version of every evaluation, as ``operators.runs.evaluations`` gives it."""

    def where_known(name: str, bit: int):
        nan = F.coalesce(F.col(name), F.lit(float("nan")))
        return F.when(F.col("known").bitwiseAND(F.lit(bit)) > 0, nan).alias(name)

    cells = F.struct("epoch", where_known("train_loss", _LOSS), where_known("val_loss", _EVAL))
    newest = _changes(spark, path).groupBy(*_KEYS, "seq").agg(F.max_by(cells, "batch_id").alias("c"))
    newest = newest.select(*_KEYS, "seq", "c.*")
    # One row per segment reaches this window.
    earlier = Window.partitionBy("run", "session").orderBy("segment")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.where("seq is null").select(
        *_KEYS, F.last("train_loss", ignorenulls=True).over(earlier).alias("carried")
    )
    known = newest.where("seq is not null and val_loss is not null")
    return known.join(carried, _KEYS).select(
        "run",
        "session",
        "seq",
        "epoch",
        F.coalesce("train_loss", "carried").alias("train_loss"),
        "val_loss",
    )


def current_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and epoch from the latest version of every evaluation."""
    return upsert_epochs(current_evaluations(spark, path))
