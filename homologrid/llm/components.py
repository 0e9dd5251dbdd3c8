"""Connected components of an edge table: alternating large and small stars.

Every round is two aggregations and two joins over the edges; it is written to the
shared folder before the next one starts.  The rounds end when the edges no longer
change, whatever the shape of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homologrid.staging import StageArea


def _smallest(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("center")).agg(F.min(other).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both, "a", "b").select("center", F.least("center", "least").alias("least"))
    return (
        both.where("b > a")
        .join(least, F.col("a") == F.col("center"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = _smallest(edges, "a", "b")
    moved = edges.join(least, F.col("a") == F.col("center")).where("b > least")
    own = least.select(F.col("center").alias("a"), F.col("least").alias("b"))
    return own.union(moved.select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the edges."""
    return tuple(
        edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(hash(a, b))")).first()
    )


def components(edges: DataFrame, area: StageArea) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node.

    Nodes are whole numbers.  Loops and repeated edges do not matter; no edges give no rows.
    """
    ordered = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = area.write(ordered.distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        stars = area.write(_large_star(now), "large-star")
        after = area.write(_small_star(stars), "small-star")
        area.forget(stars)
        area.forget(now)
        before, mark, now = mark, _mark(after), after
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
