"""Connected components by contraction, with tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import pinned

_JUMPS = 2


def _mapped(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between the parents of their ends, each once, the smaller end first."""
    a = parents.select(F.col("v").alias("a"), F.col("p").alias("pa"))
    b = parents.select(F.col("v").alias("b"), F.col("p").alias("pb"))
    ends = edges.join(a, "a", "left").join(b, "b", "left")
    x, y = F.coalesce("pa", "a"), F.coalesce("pb", "b")
    moved = ends.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return moved.where(F.col("a") < F.col("b")).distinct()


def _followed(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Labels (v, p) with p replaced by its own parent where it has one."""
    up = parents.select(F.col("v").alias("p"), F.col("p").alias("_up"))
    return labels.join(up, "p", "left").select("v", F.coalesce("_up", "p").alias("p"))


def contract(edges: DataFrame) -> DataFrame:
    """Smallest vertex of the component of every vertex that is an end of an edge (a, b).

    Each round gives every vertex its smallest neighbour as parent, follows parents, and
    keeps the edges between different parents; a round at least halves the vertices of
    each component. Stars of any size cost one partial aggregate each.
    """
    left = pinned(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where(F.col("a") < F.col("b"))
        .distinct(),
        "edges",
    )
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(
            left.select(F.col("b").alias("v"), F.col("a").alias("w"))
        )
        parents = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("p"))
        for _ in range(_JUMPS):
            parents = pinned(parents, "parents")
            parents = _followed(parents, parents)
        parents = pinned(parents, "parents")
        labels = parents if labels is None else pinned(_followed(labels, parents), "labels")
        left = pinned(_mapped(left, parents), "edges")
    if labels is None:
        return left.select(F.col("a").alias("v"), F.col("b").alias("p"))
    return labels
