"""Chat formatting by quotation linking: who answers what, and what each message says itself.

1. Quote levels are parsed from the marks at the start of each line (``>``, nested and spaced
   as mail programs write them); lines that only announce a quotation are dropped.
2. Lines of one level that follow each other are a passage. Its lines, its sentences and windows
   of its words are normalised and hashed, as are those of every message's own text. Sentences and
   windows do not depend on how lines are wrapped; of any ``GUARD`` windows in a row one is taken,
   so a common run of ``WINDOW + GUARD - 1`` words always meets.
3. Passages of every level are joined to the message that said them: the earliest in the same
   conversation before the quoting one, else the earliest in any. The original with most quoted
   characters is the ancestor of that level, at the first level the parent; among equals the later
   one. If only deeper levels have an ancestor, the parent is the earliest message that quotes it
   one level less deep, or follows it if that is the second level, else the ancestor itself. A
   message that quotes nothing answers what others quote inside their quotation of it.
4. A message without a link answers the message before it in its conversation; a message
   whose parent is in another conversation joins that conversation's thread.
5. Threads follow the parents to their roots; a message's position in its thread is behind
   that of its parent.

Originals are one row per hash before they are joined, so a line that a third of all messages
say is one row; if the hashes that are quoted are few enough to be sent to the tasks, others are
left out. Null text has no lines. Rows that repeat conversation and turn are messages each, in
the order of role and text. Null conversations are one conversation that comes first, null turns
come first in theirs. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import by_bytes, map_arrow, table
from termloom.operators.ordering import with_global_rank
from termloom.session import pinned

GROUP_BYTES = 4 << 20
WINDOW = 8  # words that are hashed together
GUARD = 4  # windows in a row of which one is taken
BROADCAST_HASHES = 1_000_000
LINE, SENTENCE, WORDS = range(3)
_MARK = regex.compile(r"^[ \t]*((?:>[ \t]?)+)")
_ANNOUNCES = regex.compile(
    r"^\s*(?:(?:on\b.{0,200}\b)?\S.{0,200}\b(?:wrote|writes|said)|-+ ?original message ?-+)\s*:?\s*$",
    regex.IGNORECASE,
)
_SENTENCE = regex.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])\s*|\n\s*\n")
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def levels(text: str) -> list[tuple[int, str]]:
    """Quote level and text of every line; a line that announces a quotation is left out."""
    found: list[tuple[int, str]] = []
    for line in text.split("\n"):
        m = _MARK.match(line)
        found.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    out = []
    behind = 0  # level of the next line that is not blank
    for level, line in reversed(found):
        if not (behind > level and _ANNOUNCES.match(line)):
            out.append((level, line))
        if line.strip():
            behind = level
    return out[::-1]


def normalised(line: str) -> str:
    return _NOT_WORD.sub(" ", line).strip().lower()


def own_text(lines: list[tuple[int, str]]) -> str:
    """The lines that are no quotation, without empty lines around them."""
    return "\n".join(line for level, line in lines if not level).strip("\n \t")


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the windows taken: the smallest of any ``GUARD`` in a row."""
    count = len(words) - WINDOW + 1
    if count < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    found = np.zeros(count, np.uint64)
    for j in range(WINDOW):
        found = found * np.uint64(0x9E3779B97F4A7C15) + each[j : j + count]
    found ^= found >> np.uint64(33)
    found *= np.uint64(0xFF51AFD7ED558CCD)
    found ^= found >> np.uint64(33)
    near = np.lib.stride_tricks.sliding_window_view(found, min(GUARD, count))
    at = np.unique(near.argmin(1) + np.arange(len(near)))
    return at, found[at].view(np.int64)


def units(lines: list[tuple[int, str]]) -> list[tuple[int, int, int, int, int]]:
    """Kind, hash, characters, first and last line of all units of some numbered lines.

    The units of a kind do not share characters: a window counts up to the next one.
    """
    out: list[tuple[int, int, int, int, int]] = []
    words: list[str] = []
    at: list[int] = []
    for i, line in lines:
        plain = normalised(line)
        if plain:
            out.append((LINE, _digest(plain), len(plain), i, i))
            parts = plain.split(" ")
            words += parts
            at += [i] * len(parts)
    place = 0
    for sentence in _SENTENCE.split("\n".join(line for _, line in lines)):
        plain = normalised(sentence)
        if plain:
            end = place + plain.count(" ") + 1
            out.append((SENTENCE, _digest(plain), len(plain), at[place], at[end - 1]))
            place = end
    starts, hashes = windows(words)
    ends = [*starts[1:].tolist(), len(words)][: len(starts)]
    for start, end, value in zip(starts.tolist(), ends, hashes.tolist(), strict=True):
        end = min(end, start + WINDOW)
        chars = sum(map(len, words[start:end])) + end - start
        out.append((WORDS, value, chars, at[start], at[start + WINDOW - 1]))
    return out


def _passages(lines: list[tuple[int, str]]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """Level and numbered lines of every quoted passage."""
    for level, part in groupby(enumerate(lines), key=lambda x: x[1][0]):
        if level:
            yield level, [(i, line) for i, (_, line) in part]


_UNIT = ("level", "kind", "hash", "chars", "first", "last")


def _parsed(messages: DataFrame) -> DataFrame:
    """Own text, count of quoted lines and the units of the quoted passages of every message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in by_bytes(batches, "text", GROUP_BYTES):
            own, counts, parts = [], [], []
            for text in group:
                lines = levels(text.decode("utf-8"))
                own.append(own_text(lines))
                counts.append(sum(1 for level, line in lines if level and normalised(line)))
                parts.append(
                    [
                        dict(zip(_UNIT, (level, *unit), strict=True))
                        for level, passage in _passages(lines)
                        for unit in units(passage)
                    ]
                )
            kind = pa.list_(pa.struct([(name, pa.int64()) for name in _UNIT]))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("conv", "turn", "role", "message")],
                    pa.array(own, pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(parts, kind),
                ],
                names=["conv", "turn", "role", "message", "own", "n_quoted", "parts"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("conv", "turn", "role", "message"))
    part = ",".join(f"{name}:long" for name in _UNIT)
    return map_arrow(
        messages, run, f"{schema}, own string, n_quoted long, parts array<struct<{part}>>"
    )


def _said(parsed: DataFrame) -> DataFrame:
    """``message``, ``conv`` and ``hash`` of the units of every message's own text."""
    picked = parsed.select("message", "conv", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, group in by_bytes(batches, "own", GROUP_BYTES):
            found = [
                sorted({unit[1] for unit in units(list(enumerate(text.decode("utf-8").split("\n"))))})
                for text in group
            ]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("message").take(pa.array(at)),
                    batch.column("conv").take(pa.array(at)),
                    pa.array([h for f in found for h in f], pa.int64()),
                ],
                names=["message", "conv", "hash"],
            )

    kind = picked.schema["conv"].dataType.simpleString()
    return map_arrow(picked, run, f"message long, conv {kind}, hash long")


def _ancestors(parsed: DataFrame) -> DataFrame | None:
    """The original of each level that has one: ``message``, ``conv``, ``level``, ``ancestor`` and
    ``lines``, the quoted lines of that level that were found; None if nothing is quoted."""
    quoted = parsed.where(F.size("parts") > 0).select(
        "message", "conv", F.explode("parts").alias("part")
    )
    quoted = pinned(quoted.select("message", "conv", "part.*"), "quoted")
    if quoted.isEmpty():
        return None
    said = _said(parsed)
    hashes = pinned(quoted.select("hash").distinct(), "hashes")
    if hashes.count() <= BROADCAST_HASHES:
        said = said.join(F.broadcast(hashes), "hash", "left_semi")
    here = said.groupBy("conv", "hash").agg(F.min("message").alias("here"))
    here = pinned(here, "said")
    anywhere = here.groupBy("hash").agg(F.min("here").alias("anywhere"))
    same = quoted["conv"].eqNullSafe(here["conv"]) & (quoted["hash"] == here["hash"])
    joined = quoted.join(here, same, "left").select(quoted["*"], "here")
    joined = joined.join(anywhere, "hash", "left")
    original = F.when(F.col("here") < F.col("message"), F.col("here")).when(
        F.col("anywhere") < F.col("message"), F.col("anywhere")
    )
    chars = [
        F.sum(F.when(F.col("kind") == kind, F.col("chars")).otherwise(0))
        for kind in (LINE, SENTENCE, WORDS)
    ]
    votes = (
        joined.withColumn("ancestor", original)
        .where(F.col("ancestor").isNotNull())
        .groupBy("message", "conv", "level", "ancestor")
        .agg(
            F.greatest(*chars).alias("chars"),
            F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("found"),
        )
    )
    best = votes.groupBy("message", "conv", "level").agg(
        F.max(F.struct("chars", "ancestor")).getField("ancestor").alias("ancestor"),
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).cast("long").alias("lines"),
    )
    return pinned(best, "ancestors")


def _quoted_parents(parsed: DataFrame, rows: DataFrame) -> DataFrame | None:
    """``message``, ``quoted_parent`` and ``n_linked`` of all messages whose parent quotations tell."""
    found = _ancestors(parsed)
    if found is None:
        return None
    nearest = found.groupBy("message", "conv").agg(
        F.min(F.struct("level", "ancestor", "lines")).alias("at")
    )
    nearest = pinned(nearest.select("message", "conv", "at.*"), "nearest")
    first = nearest.where("level = 1").select(
        "message", F.col("ancestor").alias("quoted_parent"), F.col("lines").alias("n_linked")
    )
    # Only deeper levels: who quotes the same ancestor one level less deep.
    deep = nearest.where("level > 1")
    key = ["ancestor", "level"]
    less = found.withColumn("level", F.col("level") + 1)
    here = less.groupBy(*key, F.col("conv").alias("its_conv")).agg(F.min("message").alias("here"))
    anywhere = less.groupBy(*key).agg(F.min("message").alias("anywhere"))
    own = nearest.where("level = 1").select(F.col("message").alias("next"))
    follower = (
        rows.select((F.col("message") - 1).alias("ancestor"), F.col("conv").alias("next_conv"))
        .join(rows.select(F.col("message").alias("ancestor"), "conv"), "ancestor")
        .where(F.col("conv").eqNullSafe(F.col("next_conv")))
        .select("ancestor", F.lit(2).cast("long").alias("level"), (F.col("ancestor") + 1).alias("next"))
        .join(own, "next", "left_anti")
    )
    at = here.withColumnsRenamed({"ancestor": "its_ancestor", "level": "its_level"})
    same = (
        (deep["ancestor"] == at["its_ancestor"])
        & (deep["level"] == at["its_level"])
        & deep["conv"].eqNullSafe(at["its_conv"])
    )
    between = deep.join(at, same, "left").select(deep["*"], "here")
    between = between.join(anywhere, key, "left").join(follower, key, "left")
    choice = [F.when(F.col(c) < F.col("message"), F.col(c)) for c in ("here", "next", "anywhere")]
    through = between.select(
        "message",
        F.coalesce(*choice, F.col("ancestor")).alias("quoted_parent"),
        F.col("lines").alias("n_linked"),
    )
    told = first.unionByName(through)
    # What a message quotes inside its quotation of another tells what that one answers.
    levels_of = found.groupBy("message").agg(
        F.map_from_entries(F.collect_list(F.struct("level", "ancestor"))).alias("by_level")
    )
    claims = (
        levels_of.select("message", "by_level", F.explode("by_level").alias("level", "child"))
        .select("child", F.try_element_at("by_level", F.col("level") + 1).alias("parent"))
        .where(F.col("parent") < F.col("child"))
        .groupBy("child", "parent")
        .agg(F.count("*").alias("times"))
        .groupBy("child")
        .agg(F.max(F.struct("times", "parent")).getField("parent").alias("quoted_parent"))
        .select(F.col("child").alias("message"), "quoted_parent", F.lit(0).cast("long").alias("n_linked"))
    )
    return told.unionByName(claims.join(nearest.select("message"), "message", "left_anti"))


def _threads(parents: DataFrame) -> DataFrame:
    """Root and depth of every message, by doubling the steps taken towards the root."""
    steps = pinned(
        parents.select(
            "message",
            F.col("parent").alias("up"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        ),
        "threads",
    )
    steps = steps.select("message", F.coalesce("up", "message").alias("up"), "depth")
    steps = pinned(steps, "threads")
    # Messages that have reached their root are set aside as they are, so a round makes rows for
    # those only that are still on their way.
    finished = steps.where(F.col("up") == F.col("message"))
    active = steps.where(F.col("up") != F.col("message"))
    while not active.isEmpty():
        above = finished.unionByName(active).select(
            F.col("message").alias("up"),
            F.col("up").alias("further"),
            F.col("depth").alias("more"),
        )
        moved = active.join(above, "up").select(
            "message",
            F.col("further").alias("up"),
            (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("more") > 0).alias("moved"),
        )
        moved = pinned(moved, "moved")
        finished = finished.unionByName(moved.where("not moved").drop("moved"))
        active = moved.where("moved").drop("moved")
    return finished.select("message", F.col("up").alias("root"), "depth")


def link_quotations(
    df: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per message: its own text, its parent, and its place in its thread.

    ``parent_conv`` and ``parent_turn`` name the message it answers, ``linked`` tells whether a
    quotation says so. ``thread`` numbers the roots, ``position`` the messages of a thread from
    0 in reply order, ``depth`` counts the parents above; ``n_quoted`` counts quoted lines and
    ``n_linked`` those found in their originals, of the least deep level that has any.
    """
    picked = df.select(
        df[conv_column].alias("conv"),
        df[turn_column].alias("turn"),
        df[role_column].alias("role"),
        df[text_column].alias("text"),
    )
    keyed = picked.withColumn("mark", F.xxhash64("text"))
    order = ["conv", "turn", "role", "mark"]
    ranked = with_global_rank(keyed, order, "message")
    parsed = pinned(_parsed(ranked), "messages")

    rows = parsed.select("message", "conv", "turn")
    before = rows.select(
        (F.col("message") + 1).alias("message"), F.col("conv").alias("before_conv")
    ).withColumn("same", F.lit(True))
    linked = rows.join(before, "message", "left")
    quoted = _quoted_parents(parsed, rows)
    if quoted is None:
        linked = linked.withColumns(
            {c: F.lit(None).cast("long") for c in ("quoted_parent", "n_linked")}
        )
    else:
        linked = linked.join(quoted, "message", "left")
    follows = F.col("same") & F.col("conv").eqNullSafe(F.col("before_conv"))
    parents = pinned(
        linked.select(
            "message",
            F.coalesce(
                F.col("quoted_parent"), F.when(follows, F.col("message") - 1)
            ).alias("parent"),
            F.col("quoted_parent").isNotNull().alias("linked"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        ),
        "parents",
    )
    threads = _threads(parents)
    placed = with_global_rank(threads, ["root", "message"], "place")
    starts = placed.where(F.col("root") == F.col("message")).select(
        "root", F.col("place").alias("start")
    )
    placed = placed.join(starts, "root").select(
        "message", "root", "depth", (F.col("place") - F.col("start")).alias("position")
    )
    above = rows.select(
        F.col("message").alias("parent"),
        F.col("conv").alias("parent_conv"),
        F.col("turn").alias("parent_turn"),
    )
    return (
        parsed.drop("parts")
        .join(parents, "message")
        .join(placed, "message")
        .join(above, "parent", "left")
        .select(
            F.col("conv").alias(conv_column),
            F.col("turn").alias(turn_column),
            F.col("role").alias(role_column),
            F.col("own").alias(text_column),
            "parent_conv",
            "parent_turn",
            "linked",
            F.col("root").alias("thread"),
            "position",
            "depth",
            "n_quoted",
            "n_linked",
        )
    )


def op3_quotations(spark: SparkSession, sf: str) -> DataFrame:
    return link_quotations(table(spark, sf, "conversations"))


def as_mails(messages: DataFrame) -> DataFrame:
    """Conversations as mail programs would send them: each message quotes the one before it.

    The message before that is quoted inside the quotation, one level deeper.
    """
    keys = ["conv_id", "turn"]
    one = messages.groupBy(*keys).agg(F.min(F.struct("role", "text")).alias("m"))
    one = one.select(*keys, "m.*")
    ago = {
        n: one.select(
            "conv_id",
            (F.col("turn") + n).alias("turn"),
            F.concat(F.lit("> " * n), F.regexp_replace("text", "\n", "\n" + "> " * n)).alias(
                f"ago{n}"
            ),
        )
        for n in (1, 2)
    }
    joined = one.join(ago[1], keys, "left").join(ago[2], keys, "left")
    said = F.concat(F.lit("They wrote:\n"), F.col("ago1"))
    deeper = F.concat(F.lit("> Before that someone wrote:\n"), F.col("ago2"))
    body = F.concat_ws("\n", said, deeper, F.lit(""), F.col("text"))
    return joined.select(
        *keys, "role", F.when(F.col("ago1").isNull(), F.col("text")).otherwise(body).alias("text")
    )


def quoted_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as mails and read back: own texts, parents and levels."""
    found = link_quotations(as_mails(table(spark, sf, "conversations")))
    return found.select(
        "conv_id", "turn", "role", "text", "parent_conv", "parent_turn", "linked", "n_quoted"
    )
