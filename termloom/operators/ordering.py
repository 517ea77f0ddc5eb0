"""Global order without a single-partition sort: ranks, running sums, shuffle, splits."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from termloom.functions.text import order_key
from termloom.session import pinned

_ONE_TASK_ROWS = 100_000
_CUT_ROWS = 10_000  # rows that one task ranks to find a cut
_DIGITS = 3  # of a key that one histogram tells apart
_LOCAL_BITS = 33  # documented layout of monotonically_increasing_id: partition, then row


def _sorted_chunks(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Range-sort ``df`` and write it, adding ``_chunk`` (sorted part) and ``_at`` (row in it).

    The sort key should identify a row; Spark's range partitioner then balances the
    chunks whatever the value distribution. Both numbers are written with the rows, so
    counting the chunks and reading them again agree even if an executor is lost.
    """
    row_id = F.monotonically_increasing_id()
    numbered = df.orderBy(*order_by).select("*", row_id.alias("_row"))
    return pinned(numbered, "sorted").select(
        *df.columns,
        F.shiftright("_row", _LOCAL_BITS).alias("_chunk"),
        F.col("_row").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_at"),
    )


def _before(value: Column) -> Column:
    """Sum over all earlier chunks; runs on one row per chunk."""
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def with_global_rank(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "position"
) -> DataFrame:
    """Dense 0-based position of every row in the order ``order_by``."""
    chunks = _sorted_chunks(df, order_by)
    counts = chunks.groupBy("_chunk").agg(F.count("*").alias("_n"))
    starts = counts.select("_chunk", _before(F.col("_n")).alias("_start"))
    # One row per sort partition, so the broadcast is bounded by the partition count.
    placed = chunks.join(F.broadcast(starts), "_chunk")
    return placed.select(*df.columns, (F.col("_start") + F.col("_at")).alias(name))


def with_running_sums(
    df: DataFrame, order_by: Sequence[str | Column], sums: dict[str, str]
) -> DataFrame:
    """Inclusive running sums along a global order; ``sums`` maps new name to column.

    Each sum also gets its grand total as ``<name>_total``.
    """
    chunks = _sorted_chunks(df, order_by)
    totals = chunks.groupBy("_chunk").agg(
        *[F.sum(source).alias(f"_t_{name}") for name, source in sums.items()]
    )
    every_chunk = Window.partitionBy(F.lit(1))
    starts = totals.select(
        "_chunk",
        *[_before(F.col(f"_t_{name}")).alias(f"_s_{name}") for name in sums],
        *[F.sum(f"_t_{name}").over(every_chunk).alias(f"{name}_total") for name in sums],
    )
    local = (
        Window.partitionBy("_chunk")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = chunks.select(
        "*", *[F.sum(source).over(local).alias(f"_l_{name}") for name, source in sums.items()]
    )
    return running.join(F.broadcast(starts), "_chunk").select(
        *df.columns,
        *[(F.col(f"_s_{name}") + F.col(f"_l_{name}")).alias(name) for name in sums],
        *[f"{name}_total" for name in sums],
    )


def seeded_shuffle(df: DataFrame, columns: Sequence[str], seed: int = 42) -> DataFrame:
    """Add the ``position`` of each row in a seeded pseudo-random order."""
    keyed = df.withColumn("_key", order_key(columns, seed))
    ranked = with_global_rank(keyed, ["_key", *columns])
    return ranked.drop("_key")


def cut_keys(
    keyed: DataFrame, cuts: Sequence[int], most: int = _CUT_ROWS, digits: int = _DIGITS
) -> list[Row | None]:
    """The rows at the 0-based positions ``cuts`` along the hex string ``_key.k``, then ``_key``.

    A selection without a sort: a histogram over the next digits of the key finds the range that
    holds a cut, and only its rows are looked at further, until a range has at most ``most`` rows
    or its key has no more digits, that is, all its rows have one key. So at most ``most`` rows with
    different keys are ranked for a cut, however many rows there are; each step brings
    ``16 ** digits`` counts of a cut to the driver at most. A position past the end gives None.
    """
    key = F.col("_key.k")
    ranges = {i: ("", 0, None) for i in range(len(cuts))}  # prefix, rows before it, rows in it

    def within(i: int) -> Column:
        return key.startswith(ranges[i][0])

    def open_cuts() -> list[int]:
        return [i for i, (p, _, n) in ranges.items() if n is None or (n > most and len(p) < 32)]

    while todo := open_cuts():
        width = len(ranges[todo[0]][0]) + digits
        todo = [i for i in todo if len(ranges[i][0]) + digits == width]
        wanted = functools.reduce(lambda x, y: x | y, [within(i) for i in todo])
        found = keyed.where(wanted).groupBy(F.substring(key, 1, width).alias("p")).count()
        counts = sorted((r["p"], r["count"]) for r in found.collect())
        for i in todo:
            prefix, before, _ = ranges[i]
            for p, n in counts:
                if not p.startswith(prefix):
                    continue
                if before + n > cuts[i]:
                    ranges[i] = (p, before, n)
                    break
                before += n
            else:
                del ranges[i]  # past the end
    if not ranges:
        return [None] * len(cuts)
    # Two cuts may share a range; its rows are ranked once.
    prefixes = sorted({p for p, _, _ in ranges.values()})
    label = F.lit(None).cast("string")
    for p in prefixes:
        label = F.when(key.startswith(p), p).otherwise(label)
    border = keyed.select("_key", label.alias("p")).where("p is not null")
    ranked = border.groupBy("p", "_key").count()  # equal rows are one
    running = Window.partitionBy("p").orderBy("_key")
    ranked = ranked.select(
        "p", "_key", "count", (F.sum("count").over(running) - F.col("count")).alias("start")
    )
    held = F.lit(False)
    for i, (p, before, _) in ranges.items():
        at = F.lit(cuts[i] - before)
        own = (F.col("start") <= at) & (at < F.col("start") + F.col("count"))
        held = held | ((F.col("p") == p) & own)
    rows = ranked.where(held).collect()
    out: list[Row | None] = [None] * len(cuts)
    for i, (p, before, _) in ranges.items():
        for r in rows:
            if r["p"] == p and r["start"] <= cuts[i] - before < r["start"] + r["count"]:
                out[i] = r["_key"]
    return out


def exact_split(
    df: DataFrame,
    columns: Sequence[str],
    seed: int = 42,
    tenths: Sequence[tuple[str, int]] = (("train", 8), ("dev", 1), ("test", 1)),
) -> DataFrame:
    """Split into exact shares along the seeded order, without sorting the rows.

    The keys at the cuts are selected from histograms, and every row is labelled by comparing its key
    with them. ``columns`` must identify a row; equal rows come to the same split.
    """
    keyed = df.withColumn("_key", F.struct(order_key(columns, seed).alias("k"), *columns))
    total = df.count()
    names = [name for name, _ in tenths]
    shares = [share for _, share in tenths]
    cuts = [total * sum(shares[: i + 1]) // 10 for i in range(len(shares) - 1)]
    kinds = {f.name: f.dataType for f in keyed.schema["_key"].dataType.fields}

    label = F.lit(names[-1])
    for i, row in reversed(list(enumerate(cut_keys(keyed, cuts)))):
        if row is None:  # nothing lies at or behind the cut
            label = F.lit(names[i])
            continue
        border = F.struct(*[F.lit(row[c]).cast(kind).alias(c) for c, kind in kinds.items()])
        label = F.when(F.col("_key") < border, F.lit(names[i])).otherwise(label)
    return keyed.withColumn("split", label).drop("_key")


def hash_split(
    df: DataFrame,
    columns: Sequence[str],
    seed: int = 42,
    tenths: Sequence[tuple[str, int]] = (("train", 8), ("dev", 1), ("test", 1)),
) -> DataFrame:
    """Approximate shares by key hash: one pass, and appended rows never move others."""
    draw = F.conv(F.substring(order_key(columns, seed), 1, 8), 16, 10).cast("long")
    names = [name for name, _ in tenths]
    shares = [share for _, share in tenths]
    label = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        bound = F.lit(sum(shares[: i + 1]) * (1 << 32))
        label = F.when(draw * 10 < bound, F.lit(names[i])).otherwise(label)
    return df.withColumn("split", label)


def batch_numbers(
    df: DataFrame, id_column: str, size: int = 100, ordinal: str = "ordinal"
) -> DataFrame:
    """Number candidates in batches of ``size`` along their ordinal; adds the batch total."""
    total = df.select(F.ceil(F.count("*") / size)).scalar()
    return df.select(
        id_column,
        ordinal,
        (F.floor(F.col(ordinal) / size) + 1).alias("batch"),
        total.alias("total_batches"),
    )


def first_rows(df: DataFrame, order_by: Sequence[str | Column], n: int | None) -> DataFrame:
    """First ``n`` rows in an explicit order; 0 or None means no limit.

    A limit ends in one task, so beyond ``_ONE_TASK_ROWS`` rows are taken by their global rank.
    """
    if not n:
        return df
    if n <= _ONE_TASK_ROWS:
        return df.orderBy(*order_by).limit(n)
    ranked = with_global_rank(df, order_by, "_position")
    return ranked.where(F.col("_position") < n).drop("_position")


__all__ = [
    "batch_numbers",
    "cut_keys",
    "exact_split",
    "first_rows",
    "hash_split",
    "seeded_shuffle",
    "with_global_rank",
    "with_running_sums",
]
