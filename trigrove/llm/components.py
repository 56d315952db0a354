"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.llm.common import discard, materialize


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``edges(a, b)`` of any orderable type -> ``(node, component)`` with the component's smallest node.

    Alternating large-star and small-star rounds: every round re-links neighbours to the smallest one, so that
    the graph becomes stars in a logarithmic number of rounds. Each round is a written table. A node with very
    many neighbours only meets map-side minima and a join that the adaptive planner may split. Loops and
    repeated edges are ignored, null ends are dropped; nodes without an edge do not appear.
    """
    now = materialize(_oriented(edges.select("a", "b").where("a is not null and b is not null")))
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        nxt = materialize(_small_star(_large_star(now)))
        new = _mark(nxt)
        discard(now)
        now = nxt
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _oriented(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(down.union(least.select("a", F.col("m"))))
