"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm.common import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node's neighbours (larger ones, or smaller ones and itself) move to its minimum."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.join(low, "u")
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(low.select("u", F.col("m").alias("v"))))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v) can reach.

    Alternating large-star and small-star steps until nothing changes.  Every step is a
    grouped minimum, which is combined before the shuffle, and an equi-join, which AQE splits at
    hubs; it writes its edges to the shared folder.  The driver sees two sums a step.  Nodes
    without an edge to another node are not listed.
    """
    now = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        nxt = written(_star(_star(now, True), False), "edges")
        r = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(edges.sparkSession, now)
        now = nxt
        if tuple(r) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(r)
