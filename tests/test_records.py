"""Verdicts, attempts, loss logs, checkpoints and streams on handmade rows."""

import random

import pytest
from pyspark.sql import functions as F

from termloom.operators import runs, verdicts
from termloom.streaming.losses import (
    EVENT_SCHEMA,
    current_evaluations,
    current_history,
    events_read,
    fold_stream,
)
from termloom.streaming.verdicts import (
    distinct_answers,
    verdict_totals,
    write_verdict_stream,
    write_verdict_totals,
)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("YES it is", True),
        ("yes", True),
        ("YESTERDAY", True),
        ("**YES**", False),
        ("NO", False),
        ("ERROR: YES", False),
        ("error: yes", False),
        ("", False),
    ],
)
def test_verdict(spark, text, expected):
    row = verdicts.parse_verdicts(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.is_equivalent, row.explanation) == (expected, text)


def test_assemble(spark):
    df = spark.createDataFrame(
        [(None,), ([],), ([None],), ([""],), ([" "],), ([" a", None, "b\n"],)], "p array<string>"
    )
    got = [r[0] for r in df.select(verdicts.assemble_text(F.col("p"))).collect()]
    assert got == [verdicts.NO_RESPONSE] * 2 + [verdicts.EMPTY_RESPONSE] * 2 + ["", "a b"]


def test_attempts(spark):
    log = [
        ("first", 0, True, "YES"),
        ("third", 0, False, "HTTP 429"),
        ("third", 1, False, "boom"),
        ("third", 2, True, "NO"),
        ("fourth", 0, False, "a"),
        ("fourth", 1, False, "b"),
        ("fourth", 2, False, "c"),
        ("fourth", 3, True, "YES"),
        ("limited", 0, False, "boom"),
        ("limited", 1, False, "boom"),
        ("limited", 2, False, "Rate exceeded"),
        ("quota", 0, False, "x"),
        ("quota", 1, False, "x"),
        ("quota", 2, False, "quota spent"),
    ]
    df = spark.createDataFrame(log, "request_id string, attempt int, ok boolean, text string")
    got = {r.request_id: tuple(r)[1:] for r in verdicts.resolve_attempts(df).collect()}
    assert got == {
        "first": ("YES", 1, 0.0),
        "third": ("NO", 3, 4.0),
        "fourth": ("ERROR: c", 3, 3.0),
        "limited": ("ERROR: Max retries exceeded", 3, 11.0),
        "quota": ("ERROR: quota spent", 3, 3.0),
    }
    other = {r.request_id: tuple(r)[1:] for r in verdicts.resolve_attempts(df, model="gemini").collect()}
    assert other["quota"] == ("ERROR: Max retries exceeded", 3, 23.0)
    assert other["third"] == ("NO", 3, 7.0)


def test_metrics_of_records(spark):
    rows = spark.createDataFrame(
        [(0, "a", "E1"), (1, "b", "E2"), (2, "c", "E3")], "index long, mention string, true_mondo string"
    )
    answers = spark.createDataFrame([(0, "YES"), (1, "ERROR: x")], "index long, text string")
    records = verdicts.verdict_records(rows, answers).withColumn("model", F.lit("gpt"))
    m = verdicts.verdict_metrics(records).first()
    assert (m.total_samples, m.correct_predictions, m.errors) == (3, 1, 2)
    assert m.accuracy == pytest.approx(1 / 3)
    assert verdicts.verdict_metrics(records.where("false")).count() == 0


def test_requests(spark):
    catalog = spark.createDataFrame(
        [("E1", "flu", 0), ("E2", "cold", 150)], "entity_id string, rep_text string, ordinal long"
    )
    pairs = spark.createDataFrame(
        [(1, "grippe", "E1"), (2, "grippe", "E2"), (3, "50% 'x'", "E9")],
        "query_id int, mention string, entity_id string",
    )
    rows = verdicts.request_table(pairs, catalog, {"m": "%s = %s?"}).orderBy("query_id").collect()
    assert [(r.model, r.prompt, r.batch) for r in rows] == [
        ("m", "grippe = flu?", 1),
        ("m", "grippe = cold?", 2),
        ("m", "50% 'x' = E9?", None),
    ]


# --- loss log ----------------------------------------------------------------------------


def fold(events):
    """Plain fold of (run, session, seq, epoch, loss, eval_loss) rows."""
    history, last = {}, {}
    for run, session, seq, epoch, loss, val in sorted(events, key=lambda e: e[2]):
        if loss is not None:
            last[run, session] = loss
        if val is not None:
            history[run, epoch] = (last.get((run, session)), val)
    return {(run, epoch, t, v) for (run, epoch), (t, v) in history.items()}


def random_events(n=600):
    """One run holds most events; evaluations may open a session or repeat an epoch."""
    rng = random.Random(3)
    out = []
    for seq in range(n):
        run = "hot" if rng.random() < 0.7 else f"r{rng.randrange(5)}"
        kind = rng.random()
        out.append(
            (
                run,
                f"s{seq * 3 // n}",
                seq,
                float(seq // 40),
                round(rng.random(), 3) if kind < 0.3 else None,
                round(rng.random(), 3) if kind > 0.6 else None,
            )
        )
    return out


def test_fold_and_chunks(spark):
    events = random_events()
    df = spark.createDataFrame(events, EVENT_SCHEMA)
    assert {tuple(r) for r in runs.fold_loss_log(df).collect()} == fold(events)
    for chunks in (1, 3, 200):
        rows = runs.last_before(df, ["run", "session"], "seq", "loss", "train_loss", chunks)
        evals = rows.where("eval_loss is not null")
        folded = runs.upsert_epochs(evals.withColumnRenamed("eval_loss", "val_loss"))
        assert {tuple(r) for r in folded.collect()} == fold(events)


def test_far_and_bunched_orders_fill_no_chunk(spark):
    """No chunk holds more than a segment's share, whatever the values of the order."""
    n = 20000
    far = F.when(F.col("id") % 4000 == 7, F.col("id") * 10**14).otherwise(F.col("id"))
    bunched = F.when(F.col("id") < 100, F.col("id") * 10**12).otherwise(-F.col("id"))
    for order in (F.col("id"), far, bunched, -F.col("id")):
        df = spark.range(n).select(order.cast("long").alias("seq"))
        placed = runs.with_chunks(df, "seq", 128)
        counts = placed.groupBy("_chunk").agg(F.count("*").alias("n"), F.min("seq"), F.max("seq"))
        found = sorted(tuple(r) for r in counts.collect())
        assert len(found) > 100 and max(c[1] for c in found) <= 2 * n / 128
        assert all(a[3] < b[2] for a, b in zip(found, found[1:]))


def test_history_queries(spark):
    history = spark.createDataFrame(
        [("a", 1.0, None, 0.9), ("a", 2.0, 0.5, 0.4), ("a", 3.0, 0.3, 0.4), ("b", 1.0, 0.2, 0.6)],
        "run string, epoch double, train_loss double, val_loss double",
    )
    best = {r.run: (r.best_epoch, r.best_val_loss) for r in runs.best_epochs(history).collect()}
    assert best == {"a": (2.0, 0.4), "b": (1.0, 0.6)}
    gaps = {r.run: r for r in runs.gap_statistics(history).collect()}
    assert gaps["a"].mean_gap == pytest.approx(0.0) and gaps["a"].std_gap == pytest.approx(0.1)
    summary = {r.run: tuple(r)[1:] for r in runs.history_summary(history).collect()}
    assert summary["a"] == (3, 1.0, 3.0, 0.3)
    assert [r.epoch for r in runs.chronological(history).where("run = 'a'").collect()] == [1.0, 2.0, 3.0]


def test_checkpoints(spark):
    raw = spark.createDataFrame(
        [
            ("a", "x/checkpoint-9", 1.0),
            ("a", "x/checkpoint-10", 3.9),
            ("a", "x/checkpoint-11", 3.0),
            ("a", "x/final", 2.0),
            ("a", "x/checkpoint-2", None),
            ("b", "y/final", 1.0),
        ],
        "run string, path string, state_epoch double",
    )
    table = runs.checkpoint_table(raw)
    assert table.count() == 4
    last = runs.latest_checkpoints(table).first()
    assert (last.path, last.step, last.epoch) == ("x/checkpoint-11", 11, 3)
    best = spark.createDataFrame(
        [("a", 2.0, 0.1), ("b", 1.0, 0.2)], "run string, best_epoch double, best_val_loss double"
    )
    near = {r.run: (r.path, r.checkpoint_epoch) for r in runs.nearest_checkpoints(best, table).collect()}
    assert near == {"a": ("x/checkpoint-9", 1), "b": (None, None)}
    exact = best.withColumn("best_epoch", F.lit(3.0)).where("run = 'a'")
    assert runs.nearest_checkpoints(exact, table).first().path == "x/checkpoint-11"


# --- streams -----------------------------------------------------------------------------


def test_late_events_and_retry(spark, tmp_path):
    """Events arrive out of order in several batches; each restart continues the fold."""
    events = random_events(200)
    shuffled = events[:]
    random.Random(5).shuffle(shuffled)
    source, out, offsets = (str(tmp_path / d) for d in ("in", "out", "offsets"))
    for lo in range(0, 200, 100):
        part = spark.createDataFrame(shuffled[lo : lo + 100], EVENT_SCHEMA).coalesce(1)
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(source)
        fold_stream(stream, out, offsets, width=16).awaitTermination()
        assert {tuple(r) for r in current_history(spark, out).collect()} == fold(shuffled[: lo + 100])


def fold_parts(spark, tmp_path, parts, width):
    """Feed parts one after the other, a batch each; the folders used."""
    source, out, offsets = (str(tmp_path / d) for d in ("in", "out", "offsets"))
    for part in parts:
        spark.createDataFrame(part, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(source)
        fold_stream(stream, out, offsets, width=width).awaitTermination()
    return source, out, offsets


def test_a_batch_reads_its_segments_and_not_the_log(spark, tmp_path):
    """One session that grows: what a batch takes from the state stays the same."""
    events = [
        ("r", "s", i, float(i // 7), i / 2 if i % 3 else None, float(i) if i % 5 == 0 else None)
        for i in range(240)
    ]
    late = [("r", "s", 3, 0.0, 99.0, None), ("r", "s", 200, 28.0, 77.0, None)]
    parts = [events[i : i + 20] for i in range(0, 240, 20)]
    _, out, _ = fold_parts(spark, tmp_path, [*parts, late], 32)
    read = {r.batch_id: r.events for r in events_read(spark, out).collect()}
    assert len(read) == 13
    assert max(read.values()) <= 2 * 32  # two segments at most, at any length of the log
    assert read[11] <= max(read[1], read[2], read[3])
    # The late loss repairs the evaluations up to the next loss, and nothing else.
    changed = spark.read.parquet(f"{out}/changes/batch_id=12").where("seq is not null")
    assert {r.seq for r in changed.collect()} <= {3, 5, 200}


def test_sessions_share_states(spark, tmp_path):
    """Many short sessions: few states for a segment, the results of a state for each session."""
    draw = random.Random(8)
    cells = [(f"r{i % 40}", str(i % 3), i, float(i // 50), i / 2, None) for i in range(400)]
    events = [(*e[:4], None, e[4]) if draw.random() < 0.4 else e for e in cells]
    nan = float("nan")
    late = [(*e[:4], nan, None) for e in events[:90]] + [("r1", "9", 5, 1.0, None, 2.0)]
    draw.shuffle(events)
    found = {}
    for name, options in (("own", {}), ("shared", {"spread": 4})):
        folder = tmp_path / name
        source, out, offsets = (str(folder / d) for d in ("in", "out", "offsets"))
        for part in (events[:200], events[200:], late):
            df = spark.createDataFrame(part, EVENT_SCHEMA)
            df.coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(EVENT_SCHEMA).parquet(source)
            fold_stream(stream, out, offsets, width=200, **options).awaitTermination()
        found[name] = sorted(map(repr, map(tuple, current_evaluations(spark, out).collect())))
        states = spark.read.parquet(f"{out}/changes/batch_id=1").where("read > 0").count()
        assert states <= 8 if options else states > 50
    assert found["own"] == found["shared"] and len(found["own"]) > 50


def test_a_retried_batch_and_repeated_events(spark, tmp_path):
    nan = float("nan")
    first = [("r", "s", 1, 0.0, 1.0, None), ("r", "s", 70, 0.0, None, 5.0), ("q", "s", -5, 0.0, None, 2.0)]
    second = [
        ("r", "s", 40, 1.0, nan, None),  # a loss that is NaN is a loss
        ("r", "s", 70, 2.0, None, 6.0),  # replaces the event of its place
        ("r", "s", 90, 2.0, None, nan),
        ("r", None, 3, 0.0, 1.0, 1.0),
        ("q", "s", -40, 0.0, 8.0, None),
    ]
    third = [("q", "s", -5, 0.0, 4.0, None)]  # no evaluation any more
    source, out, offsets = fold_parts(spark, tmp_path, [first, second, third], 32)

    def now():
        return sorted(map(repr, map(tuple, current_evaluations(spark, out).collect())))

    expected = [("r", "s", 70, 2.0, nan, 6.0), ("r", "s", 90, 2.0, nan, nan)]
    assert now() == sorted(map(repr, expected))
    for name in ("2", ".2.crc"):  # as if the last batch had not been committed
        (tmp_path / "offsets" / "commits" / name).unlink(missing_ok=True)
    fold_stream(
        spark.readStream.schema(EVENT_SCHEMA).parquet(source), out, offsets, width=32
    ).awaitTermination()
    assert now() == sorted(map(repr, expected))


def test_verdict_stream_recovers(spark, tmp_path):
    source, out, offsets = (str(tmp_path / d) for d in ("in", "out", "offsets"))
    schema = "index long, text string"
    for part in ([(1, "YES"), (2, "no")], [(3, "ERROR: x")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # the second start finds nothing new
            stream = spark.readStream.schema(schema).parquet(source)
            write_verdict_stream(stream, out, offsets).awaitTermination()
    done = {r["index"]: r.is_equivalent for r in spark.read.parquet(out).collect()}
    assert done == {1: True, 2: False, 3: False} and spark.read.parquet(out).count() == 3


def test_partial_results_are_closed_by_count(spark, tmp_path):
    """Parts hold so many records but the last; files that no batch committed are not read."""
    import pyarrow.parquet as pq

    source, out, offsets = (str(tmp_path / d) for d in ("in", "out", "offsets"))
    rows = [(i, "YES") for i in range(250)]
    spark.createDataFrame(rows, "index long, text string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("index long, text string").parquet(source)
    write_verdict_stream(stream, out, offsets).awaitTermination()
    parts = list((tmp_path / "out").glob("*.parquet"))
    assert sorted(pq.read_metadata(p).num_rows for p in parts) == [50, 100, 100]
    (tmp_path / "out" / "part-left-by-an-aborted-batch.parquet").write_bytes(parts[0].read_bytes())
    assert spark.read.parquet(out).count() == 250


@pytest.mark.parametrize("timed", [False, True])
def test_answers_sent_again_count_once(spark, tmp_path, timed):
    source, out, offsets = (str(tmp_path / d) for d in ("in", "out", "offsets"))
    schema = "index long, model string, text string, at timestamp"
    batches = [[(1, "a", "YES"), (2, "a", "no"), (1, "a", "YES")], [(2, "a", "no"), (3, "b", "YES")]]
    for i, part in enumerate([*batches, [(1, "a", "YES"), (3, "b", "YES"), (4, "b", "ERROR: x")]]):
        df = spark.createDataFrame(part, "index long, model string, text string")
        df = df.withColumn("at", F.timestamp_seconds(F.lit(60 * i)))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        once = distinct_answers(stream, ["index"], "at" if timed else None)
        write_verdict_totals(once, out, offsets).awaitTermination()
    found = {r.model: (r.total_samples, r.correct_predictions) for r in verdict_totals(spark, out).collect()}
    assert found == {"a": (2, 1), "b": (2, 1)}
