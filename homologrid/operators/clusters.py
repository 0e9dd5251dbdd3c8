"""Cluster labels from cluster memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homologrid.functions.identifiers import padded_label, without_suffix
from homologrid.operators.ordering import dense_codes

# Label prefixes and column names of the two clusterings.
STRUCTURE_PREFIX = "SC"
STRUCTURE_COLUMN = "StruCluster"
COMMUNITY_PREFIX = "LC"
COMMUNITY_COLUMN = "LeidenCluster"


def labelled(members: DataFrame, key: str, prefix: str, name: str) -> DataFrame:
    """``protid`` with a label made of the sorted position of its cluster key.

    Positions are padded to the width of the largest one.
    """
    codes = dense_codes(members, key, "_code")
    # The codes are a written table, so counting it is one cheap scan.
    width = len(str(max(0, codes.count() - 1)))
    labels = codes.select(key, padded_label(prefix, F.col("_code"), F.lit(width)).alias(name))
    return members.join(labels, key).select("protid", name)


def structure_clusters(members: DataFrame) -> DataFrame:
    """Labels of a structural clustering given as ``ClusterRep, protid``."""
    cleaned = members.select(
        without_suffix(F.col("ClusterRep")).alias("ClusterRep"),
        without_suffix(F.col("protid")).alias("protid"),
    )
    return labelled(cleaned, "ClusterRep", STRUCTURE_PREFIX, STRUCTURE_COLUMN)


def communities_by_size(membership: DataFrame, prefix: str, name: str) -> DataFrame:
    """Labels in order of falling community size (ties: smallest member first)."""
    sizes = membership.groupBy("community").agg(
        F.count(F.lit(1)).alias("size"), F.min("protid").alias("first")
    )
    order = F.struct((-F.col("size")).alias("neg_size"), F.col("first"), F.col("community"))
    ranked = dense_codes(sizes.select(order.alias("place")), "place", "_code")
    width = len(str(max(0, ranked.count() - 1)))
    labels = ranked.select(
        F.col("place.community").alias("community"),
        padded_label(prefix, F.col("_code"), F.lit(width)).alias(name),
    )
    return membership.join(labels, "community").select("protid", name)
