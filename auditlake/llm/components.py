"""Connected components over links, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize


def connect(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of the links (columns a and b, longs); component is the smallest id reached.

    Alternates large-star and small-star steps, which link every neighbour of a vertex to the smallest one: first
    the larger neighbours, then the smaller ones and the vertex itself. The number of rounds grows with
    the logarithm of the largest component. Each round is written to the shared folder, so a lost
    executor costs at most one round.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "cc-edges")
    seen = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            # A fixed point is a set of stars: every vertex hangs on the smallest of its component.
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen = tuple(state)
        edges = _star(_star(edges, larger=True), larger=False)
        edges = materialize(edges, "cc-edges")
    raise RuntimeError("components did not settle")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links (u above v) after one step: the larger neighbours of every vertex, or the smaller ones, hang on its smallest."""
    both = edges.union(edges.select("v", "u")) if larger else edges
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    if larger:
        # Only vertices with larger neighbours move them; the target is the vertex itself where it is the smallest.
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v"))
    else:
        moved = both.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()
