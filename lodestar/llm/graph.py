"""Connected components by contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges`` has longs ``a`` and ``b``.

    Each round hangs every node on its least neighbour (or itself), shortens the hanging twice,
    and contracts the edges; what is left shrinks at least by half in nodes, so rounds are few.
    Every round is written to the shared folder."""
    left = written(edges.filter("a != b").select("a", "b").distinct(), f"{name}-edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    known = written(nodes.withColumn("component", F.col("node")), f"{name}-nodes")
    for k in range(MAX_ROUNDS):
        if left.isEmpty():
            return known
        ways = left.union(left.select("b", "a"))
        hung = written(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), f"{name}-hung{k}")
        for _ in range(2):
            above = hung.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hung = hung.join(above, "up").select("node", F.col("top").alias("up"))
        hung = written(hung, f"{name}-up{k}")
        to = hung.select(F.col("node").alias("component"), "up")
        known = written(known.join(to, "component", "left").select("node", F.coalesce("up", "component").alias("component")), f"{name}-known{k}")
        a, b = hung.select(F.col("node").alias("a"), F.col("up").alias("a2")), hung.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        moved = left.join(a, "a").join(b, "b").filter("a2 != b2")
        left = written(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}-left{k}")
    raise RuntimeError("components did not settle")
