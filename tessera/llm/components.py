"""Connected components of an edge table, by alternating stars.

Each round hangs every node's larger neighbours on the least node around it
(large star) and then its smaller ones (small star).  Both halves are one
grouped minimum, which combines before it shuffles, and one join that Spark may
split where a hub holds a large share of the edges.  Every round is written to
the shared folder, so neither the plan nor its lineage grows, and a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a < b; one half of a round, in the same form."""
    if large:
        around = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = around.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        hung = around.filter("w > v").join(least, "v").select(F.col("m").alias("a"), F.col("w").alias("b"))
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        hung = edges.join(least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        hung = hung.unionAll(least.select(F.col("m").alias("a"), "b"))
    return hung.filter("a != b").distinct()


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """id and component (the least id reachable) for every node of ``edges``.

    ``edges`` has the columns a and b, in any order and with repeats; an edge
    with a null end or from a node to itself is ignored.
    """
    tidy = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    current = tidy.distinct()
    mark, step = None, 0
    while True:
        current = materialize(_star(_star(current, True), False), f"{folder}/{step}")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark, step = now, step + 1
    leaves = current.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return leaves.unionAll(current.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
