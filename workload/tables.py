"""The given tables and the domain views that Spark derives from them.

Analogy: a *protein* is a part, customer, user, document or vector; a *cluster*
is a type, language, flag or label; a *score* is a measure or a dot product.
Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def structure_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Events as structure-search hits: errors are hits that are not models."""
    events = table(spark, folder, "events")
    name = F.concat(
        F.lit("AF-U"),
        F.col("user_id").cast("string"),
        F.when(F.col("event_type") == "error", "-fragment").otherwise("-F1-model_v4"),
    )
    return events.select(
        F.col("event_id").alias("pos"),
        F.concat(name, F.lit(" "), F.col("event_type")).alias("target"),
        F.get_json_object("props", "$.k").cast("double").alias("fident"),
        (F.pmod("event_id", F.lit(7)) / 8).alias("prob"),
        (F.floor("value") / 1000).alias("evalue"),
    )


STRUCTURE_HITS_SQL = """
structure_hits AS (
  SELECT event_id AS pos,
         'AF-U' || CAST(user_id AS VARCHAR)
           || CASE WHEN event_type = 'error' THEN '-fragment' ELSE '-F1-model_v4' END
           || ' ' || event_type AS target,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS fident,
         (event_id % 7) / 8.0 AS prob,
         floor(value) / 1000 AS evalue
  FROM events
),
model_hits AS (
  SELECT *, regexp_extract(split_part(target, ' ', 1), 'AF-(.*)-F1-model', 1) AS protid
  FROM structure_hits
  WHERE contains(split_part(target, ' ', 1), '-F1-model')
    AND regexp_extract(split_part(target, ' ', 1), 'AF-(.*)-F1-model', 1) <> ''
)
"""


def part_features(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as annotated proteins; some annotation cells are made missing."""
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("protid"),
        F.when(F.col("p_brand") == "Brand#3", "deleted")
        .otherwise(F.col("p_name"))
        .alias("Protein names"),
        F.nullif(F.pmod("p_size", F.lit(6)), F.lit(5)).cast("double").alias("Annotation"),
        F.when(F.col("p_type") == "PROMO", F.lit(None))
        .when(F.col("p_type") == "ECONOMY", "fragment")
        .otherwise("whole")
        .alias("Fragment"),
        F.concat((F.col("p_size") * 10).cast("string"), F.lit(".0")).alias("Length"),
        F.col("p_type").alias("LeidenCluster"),
        F.col("p_retailprice").alias("pdb_confidence"),
    )


PART_FEATURES_SQL = """
part_features AS (
  SELECT p_partkey AS protid,
         CASE WHEN p_brand = 'Brand#3' THEN 'deleted' ELSE p_name END AS protein_names,
         CAST(nullif(p_size % 6, 5) AS DOUBLE) AS annotation,
         CASE WHEN p_type = 'PROMO' THEN NULL
              WHEN p_type = 'ECONOMY' THEN 'fragment' ELSE 'whole' END AS fragment,
         p_size * 10 AS len,
         p_type, p_retailprice
  FROM part
)
"""


def lineage_text(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with a lineage built from their region, nation and account."""
    supplier = table(spark, folder, "supplier")
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    kingdom = (
        F.when(F.col("r_name") == "AFRICA", "Metazoa (kingdom), Mammalia (class)")
        .when(F.col("r_name") == "AMERICA", "Metazoa (kingdom)")
        .when(F.col("r_name") == "ASIA", "Viridiplantae (kingdom)")
        .when(F.col("r_name") == "EUROPE", "Sarcopterygii (superclass), Fungi (kingdom)")
        .otherwise("Unranked (clade)")
    )
    domain = F.when(F.col("s_acctbal") < 0, "Bacteria (superkingdom)").otherwise(
        F.when(F.col("r_name") == "MIDDLE EAST", "cellular organisms (no rank)").otherwise(
            "Eukaryota (superkingdom)"
        )
    )
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("protid"),
            F.col("n_name").alias("nation"),
            F.concat_ws(", ", domain, kingdom).alias("lineage"),
        )
    )


LINEAGE_SQL = """
lineage_text AS (
  SELECT s_suppkey AS protid, n_name AS nation,
         CASE WHEN s_acctbal < 0 THEN 'Bacteria (superkingdom)'
              WHEN r_name = 'MIDDLE EAST' THEN 'cellular organisms (no rank)'
              ELSE 'Eukaryota (superkingdom)' END
         || ', ' ||
         CASE r_name WHEN 'AFRICA' THEN 'Metazoa (kingdom), Mammalia (class)'
                     WHEN 'AMERICA' THEN 'Metazoa (kingdom)'
                     WHEN 'ASIA' THEN 'Viridiplantae (kingdom)'
                     WHEN 'EUROPE' THEN 'Sarcopterygii (superclass), Fungi (kingdom)'
                     ELSE 'Unranked (clade)' END AS lineage
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey
)
"""


def sparse_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as scores of (supplier, part) pairs; most pairs are missing."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("target"))
        .agg(F.max("l_discount").alias("score"))
    )


SPARSE_SCORES_SQL = """
sparse_scores AS (
  SELECT l_suppkey AS query, l_partkey AS target, max(l_discount) AS score
  FROM lineitem GROUP BY 1, 2
)
"""
