"""Filter interaction audit: what each filter removes in every order of the filters.

Every document gets a mask of the filters that it fails; equal masks of a part are one cell. A
Gray-code walk over the 32 subsets of filters toggles one filter at a time and keeps, for every
cell, how many of the active filters it fails, and the running survivors. The 32 states are
stored, and each step of each order is the difference of two of them.

A document fails

* A with under ``MIN_WORDS`` words,
* B when under half of its words are different,
* C when over a fiftieth of its code points are ``[A-Z]``,
* D when it holds any of ``SIGNS``,
* E when its text is that of any smaller id, in whatever part and whether removed or not.

Null text counts as empty: it fails A and, but for the smallest id, E. A null source is the
part of the empty string, together with sources that are empty. A null id stands behind all
others. Repeated rows of one id and text do not make each other fail E, and each counts. An id labelled
twice is good or toxic if one label says so; labels without document count nowhere. Very long
texts are read in slices, so that only their different words are held besides them. Equal
texts are found by their SHA-256. An empty table has no parts and gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.blocks import NO_ID
from termloom.llm.common import by_bytes, map_arrow, table

FILTERS = "ABCDE"
MIN_WORDS = 200
SIGNS = b"#$%&*|"
GROUP_BYTES = 4 << 20
SLICE = 1 << 20
_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(128, 192))  # bytes that do not begin a code point
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_REPEATED = 1 << FILTERS.index("E")
COUNTS = ("n", "good", "toxic")


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in parts that end at white space."""
    start = 0
    while len(text) - start > SLICE:
        white = _WHITE.search(text, start + SLICE)
        if not white:
            break
        yield text[start : white.start()]
        start = white.end()
    yield text[start:]


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    n_words, different = 0, set()
    for part in _slices(text):
        words = part.split()
        n_words += len(words)
        different.update(words)
    n_upper = len(text) - len(text.translate(None, _UPPER))
    n_points = len(text.translate(None, _FOLLOWING))
    fails = (
        n_words < MIN_WORDS,
        100 * len(different) < 50 * n_words,
        100 * n_upper > 2 * n_points,
        any(sign in text for sign in SIGNS),
    )
    return sum(1 << bit for bit, failed in enumerate(fails) if failed)


def document_masks(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source"
) -> DataFrame:
    """``id``, ``part``, ``mask`` of A to D and ``same``, the hash of the text."""
    picked = df.select(
        df[id_column].cast("long").alias("id"),
        F.coalesce(df[part_column].cast("string"), F.lit("")).alias("part"),
        df[text_column].alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in by_bytes(batches, "text", GROUP_BYTES):
            masks = pa.array([own_mask(t) for t in group], pa.int32())
            same = pa.array([hashlib.sha256(t).digest() for t in group], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), masks, same],
                names=["id", "part", "mask", "same"],
            )

    return map_arrow(picked, run, "id long, part string, mask int, same binary")


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones by (part, mask of all five filters).

    Rows are counted by text, part and labels before texts meet, so a text in a third of all
    documents is a few rows when its smallest id is looked up.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    kind = ["same", "part", "mask", "good", "toxic"]
    marked = masks.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    marked = marked.fillna(int(NO_ID), ["id"])
    by_id = marked.groupBy(*kind, "id").agg(F.count("*").alias("n"))
    by_kind = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("lowest")
    )
    first = F.min("lowest.id").over(Window.partitionBy("same"))
    unlike = F.when(F.col("lowest.id") == first, F.col("lowest.n")).otherwise(0)
    split = by_kind.withColumn("unlike", unlike).select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct("mask", F.col("unlike").alias("n")),
                F.struct(
                    (F.col("mask") + F.lit(_REPEATED)).alias("mask"),
                    (F.col("n") - F.col("unlike")).alias("n"),
                ),
            )
        ).alias("cell"),
    )
    n = F.col("cell.n")
    return split.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("n"),
        F.sum(n * F.col("good")).alias("good"),
        F.sum(n * F.col("toxic")).alias("toxic"),
    )


def subset_states(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters; cells is (parts, masks, counts), as is the result.

    The walk toggles one filter at a time. ``failing`` holds each mask's number of failures
    among the active filters; a mask whose number leaves or reaches 0 leaves or joins the
    survivors.
    """
    n_masks = cells.shape[1]
    masks = np.arange(n_masks)
    failing = np.zeros(n_masks, np.int64)
    running = cells.sum(1)
    states = np.empty_like(cells)
    active = 0
    states[:, active] = running
    for number in range(1, n_masks):
        toggled = number & -number  # the bit in which neighbours of the Gray code differ
        active ^= toggled
        has = masks & toggled > 0
        if active & toggled:
            running = running - cells[:, has & (failing == 0)].sum(1)
            failing[has] += 1
        else:
            failing[has] -= 1
            running = running + cells[:, has & (failing == 0)].sum(1)
        states[:, active] = running
    return states


def _steps() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of every step of every order: the order, step number, subset before it and filter's bit."""
    names, numbers, before, bits = [], [], [], []
    for order in permutations(range(len(FILTERS))):
        active = 0
        for number, bit in enumerate(order, 1):
            names.append("".join(FILTERS[i] for i in order))
            numbers.append(number)
            before.append(active)
            bits.append(1 << bit)
            active |= 1 << bit
    return names, np.array(numbers), np.array(before), np.array(bits)


def audit(cells: DataFrame) -> DataFrame:
    """One row per part, order and step from the cells of every part."""
    by_part = cells.groupBy("part").agg(
        F.collect_list(F.struct("mask", *COUNTS)).alias("cells")  # 32 at most
    )
    names, numbers, before, bits = _steps()
    size = 1 << len(FILTERS)
    longs = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                listed = batch.column("cells")
                rows = listed.flatten()
                owner = np.repeat(np.arange(batch.num_rows), np.asarray(listed.value_lengths()))
                grid = np.zeros((batch.num_rows, size, len(COUNTS)), np.int64)
                for i, count in enumerate(COUNTS):
                    grid[owner, np.asarray(rows.field("mask")), i] = np.asarray(rows.field(count))
                states = subset_states(grid)
                lost = states[:, before] - states[:, before | bits]
                failing = states[:, :1, 0] - states[:, bits, 0]
                every = size - 1
                unique = states[:, every ^ bits, 0] - states[:, every, 0][:, None]
                shapley = np.zeros_like(failing)
                for bit in np.unique(bits):
                    own = bits == bit
                    shapley[:, own] = lost[:, own, 0].sum(1, keepdims=True)
                values = [
                    states[:, before | bits, 0],
                    lost[:, :, 0],
                    failing - lost[:, :, 0],
                    unique,
                    lost[:, :, 1],
                    lost[:, :, 2],
                    shapley,
                ]
                part = batch.column("part").take(
                    pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
                )
                steps = np.tile(numbers, batch.num_rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part,
                        pa.array(names * batch.num_rows),
                        pa.array(steps),
                        *[pa.array(v.ravel()) for v in values],
                    ],
                    names=["part", "filter_order", "step", *longs],
                )

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs)
    return map_arrow(by_part, run, schema)


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    masks = document_masks(table(spark, sf, "documents"))
    return audit(mask_cells(masks, table(spark, sf, "labels")))


OP12_SQL = r"""
with facts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good,
         max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id
), fails as (
  select facts.part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         case when len(w) < 200 then 1 else 0 end
         + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
         + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)
                then 4 else 0 end
         + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
         + case when facts.doc_id > min(facts.doc_id) over (partition by t) then 16 else 0 end
           as mask
  from facts left join marks on facts.doc_id = marks.doc_id
), cells as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic
  from fails group by part, mask
), states as (
  select part, s.active,
         sum(case when mask & s.active = 0 then n else 0 end) as n,
         sum(case when mask & s.active = 0 then good else 0 end) as good,
         sum(case when mask & s.active = 0 then toxic else 0 end) as toxic
  from cells, (select unnest(range(32)) as active) s group by part, s.active
), letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps as (
  select filter_order, i as step, bits[i] as bit,
         coalesce(list_sum(bits[1:i - 1]), 0)::bigint as before
  from orders, (select unnest(range(1, 6)) as i) n
), joined as (
  select o.part, filter_order, step, bit, after.n as kept, o.n - after.n as removed,
         nothing.n - alone.n as failing, others.n - every.n as unique_fails,
         o.good - after.good as good_lost, o.toxic - after.toxic as toxic_lost
  from steps
  join states o on o.active = before
  join states after on after.part = o.part and after.active = before + bit
  join states nothing on nothing.part = o.part and nothing.active = 0
  join states alone on alone.part = o.part and alone.active = bit
  join states others on others.part = o.part and others.active = 31 - bit
  join states every on every.part = o.part and every.active = 31
)
select part, filter_order, step::integer as step, kept::bigint as kept, removed::bigint as removed,
       (failing - removed)::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       sum(removed) over (partition by part, bit)::bigint as shapley
from joined
"""
