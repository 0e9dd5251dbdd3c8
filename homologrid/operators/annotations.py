"""Per-cluster text analytics: exact annotations and words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homologrid.functions.identifiers import truncated
from homologrid.functions.words import EXCLUDED_WORDS, kept_words


def annotation_counts(df: DataFrame, cluster: str, annotation: str) -> DataFrame:
    """How often each exact annotation occurs in each cluster."""
    return (
        df.where(F.col(cluster).isNotNull() & F.col(annotation).isNotNull())
        .groupBy(F.col(cluster).alias("cluster"), F.col(annotation).alias("annotation"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def annotation_totals(df: DataFrame, cluster: str, annotation: str) -> DataFrame:
    """Number of annotated rows per cluster (rows, not distinct texts)."""
    return (
        df.where(F.col(cluster).isNotNull())
        .groupBy(F.col(cluster).alias("cluster"))
        .agg(F.count(annotation).alias("total"))
    )


def top_annotations(counts: DataFrame, n: int = 10, width: int = 30) -> DataFrame:
    """The ``n`` most frequent annotations per cluster, with display labels.

    The row-number filter is pushed below the shuffle by Spark (window group
    limit), so a hot cluster sends at most ``n`` rows per task.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "annotation")
    return (
        counts.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
        .withColumn("label", truncated(F.col("annotation"), width))
    )


def word_frequencies(
    df: DataFrame,
    cluster: str,
    annotation: str,
    excluded: Sequence[str] = tuple(EXCLUDED_WORDS),
) -> DataFrame:
    """Relative frequency of each kept word among the kept words of its cluster.

    Words are counted as written first; excluding and cleaning then touch each
    distinct word once, and counts of words that become equal are added.
    """
    raw = (
        df.where(F.col(cluster).isNotNull() & F.col(annotation).isNotNull())
        .select(F.col(cluster).alias("cluster"), F.explode(F.split(annotation, " ")).alias("word"))
        .groupBy("cluster", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = (
        raw.select("cluster", F.explode(kept_words(F.col("word"), excluded)).alias("word"), "n")
        .groupBy("cluster", "word")
        .agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("cluster").agg(F.sum("n").alias("total"))
    return counts.join(totals, "cluster").select(
        "cluster", "word", "n", (F.col("n") / F.col("total")).alias("frequency")
    )
