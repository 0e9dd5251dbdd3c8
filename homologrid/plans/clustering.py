"""From scores or vectors to labelled communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homologrid.operators import clusters, graph
from homologrid.operators.neighbours import default_neighbours, neighbour_lists
from homologrid.operators.reduction import PRESTEP_COMPONENTS, score_components, similarity_components


def communities_of_coordinates(
    coordinates: DataFrame,
    neighbours: int = 10,
    share: float = 0.0,
    prefix: str = clusters.COMMUNITY_PREFIX,
    name: str = clusters.COMMUNITY_COLUMN,
    resolution: float = 1.0,
) -> DataFrame:
    """Neighbour graph of coordinates, communities, padded labels (largest first).

    The neighbour count is fixed by default; ``share=0.1`` is customary for small sets.
    """
    count = coordinates.count()
    if count < 3:
        return coordinates.select("protid", F.lit(f"{prefix}0").alias(name))
    near = default_neighbours(count, neighbours, share)
    # The prescribed count includes the row itself.
    lists = neighbour_lists(coordinates, max(1, near - 1), vector="coords", metric="euclidean")
    nodes = coordinates.select(F.col("protid").alias("node"))
    found = graph.communities(graph.fuzzy_graph(lists), nodes, resolution)
    return clusters.communities_by_size(found.withColumnRenamed("node", "protid"), prefix, name)


def communities_of_scores(scores: DataFrame, components: int = PRESTEP_COMPONENTS, **settings) -> DataFrame:
    """Communities of an all-against-all score table."""
    return communities_of_coordinates(score_components(scores, components), **settings)


def communities_of_vectors(
    vectors: DataFrame, components: int = PRESTEP_COMPONENTS, **settings
) -> DataFrame:
    """Communities of vectors compared by dot product."""
    return communities_of_coordinates(similarity_components(vectors, components), **settings)


def covered_clusters(scores: DataFrame) -> DataFrame:
    """Structural clusters: greedy set cover of the pairs that have a score."""
    pairs = scores.where(F.col("score") > 0).select(
        F.col("query").alias("src"), F.col("target").alias("dst")
    )
    nodes = scores.select(F.explode(F.array("query", "target")).alias("node")).distinct()
    cover = graph.set_cover(pairs, nodes)
    return clusters.structure_clusters(
        cover.select(F.col("representative").alias("ClusterRep"), F.col("node").alias("protid"))
    )
