"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import removed, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest among them and itself.

    Only the minimum of a neighbourhood is aggregated, so a node with very many
    neighbours is combined before the shuffle and never gathered.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    view = both if large else both.where("b <= a")
    low = view.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    linked = view.join(low, "a").where("b > a" if large else "true")
    out = linked.select(F.col("b").alias("x"), "low")
    if not large:
        out = out.unionByName(low.select(F.col("a").alias("x"), "low"))
    return out.where("x <> low").select(F.col("x").alias("a"), F.col("low").alias("b")).distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (a, b).

    Each round is written to the shared folder; the rounds grow with the logarithm
    of the longest path. Nodes without an edge to another are not in the result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"))
    before, turn = None, 0
    while True:
        state = now.agg(mark.alias("m")).first()["m"]
        if state["n"] == 0 or state == before:
            break
        before, turn = state, turn + 1
        now = written(_star(_star(now, large=True), large=False), folder, f"{name}-{turn}")
        removed(now.sparkSession, f"{folder}/{name}-{turn - 1}")
    # Every edge now points at its component's smallest node.
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops).distinct()
