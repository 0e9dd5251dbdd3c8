"""Feature assembly, overrides, concordance, coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.operators import features, hits
from homologrid.operators.study import study_table
from workload.tables import STRUCTURE_HITS_SQL, structure_hits, table


def _assembled(spark: SparkSession, folder: str) -> DataFrame:
    """Whole tables whose keys differ: documents, their labels, vectors, pages and parts."""
    documents = table(spark, folder, "documents")
    base = documents.select(F.col("doc_id").alias("protid"), "lang", "n_chars")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("protid"), "quality")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("protid"), "label")
    lines = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").alias("protid"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.avg("l_tax"), 6).alias("mean_tax"))
    )
    return features.assemble_features([base, labels, vectors, lines])


def feature_outer_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _assembled(spark, folder)


def feature_outer_merge_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that occur more than once: the merge multiplies rows."""
    orders = table(spark, folder, "orders")
    first = orders.select(F.col("o_custkey").alias("protid"), "o_orderstatus")
    second = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("protid"), "c_mktsegment"
    )
    third = table(spark, folder, "events").select(
        F.col("user_id").alias("protid"), "event_type"
    ).distinct()
    return features.assemble_features([first, second, third])


def feature_override(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    base = documents.select(F.col("doc_id").alias("protid"), "lang", "source", "n_chars")
    labels = table(spark, folder, "labels")
    override = labels.select(
        (F.col("doc_id") * 2).alias("protid"),
        F.when(F.col("quality") == 1, "xx").alias("lang"),
        F.when(F.col("toxic") == 0, F.col("doc_id")).alias("n_chars"),
        F.lit("ignored").alias("unknown_column"),
    )
    return features.override_cells(base, override)


def concordance(spark: SparkSession, folder: str) -> DataFrame:
    scores = (
        table(spark, folder, "events")
        .groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("protid"))
        .agg((F.max(F.get_json_object("props", "$.k").cast("int")) / 100).alias("TMscore_v_K"))
    )
    identities = hits.identity_features(structure_hits(spark, folder), "K")
    found = features.concordance(scores, identities, "K", max_evalue=0.003, min_score=0.5)
    return found.select("protid", F.round("concordance_v_K", 6).alias("concordance_v_K"))


def coordinates_join(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    coordinates = vectors.select(
        F.col("vec_id").alias("protid"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("PC0"),
        F.round(F.get("embedding", F.lit(1)).cast("double"), 6).alias("PC1"),
    )
    documents = table(spark, folder, "documents")
    return features.attach_coordinates(
        coordinates, documents.select(F.col("doc_id").alias("protid"), "lang", "n_chars")
    )


def study_right_join(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("protid"), "quality")
    documents = table(spark, folder, "documents")
    return study_table(
        labels, documents.select(F.col("doc_id").alias("protid"), "source", "n_chars")
    )


def rows_by_name(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("protid"), "quality")
    benchmark = table(spark, folder, "benchmark")
    return features.append_rows(
        [labels, benchmark.select(F.col("item_id").alias("protid"), "text")]
    )


QUERIES = {
    "feature_outer_merge": feature_outer_merge,
    "feature_outer_merge_repeated": feature_outer_merge_repeated,
    "feature_override": feature_override,
    "concordance": concordance,
    "coordinates_join": coordinates_join,
    "study_right_join": study_right_join,
    "rows_by_name": rows_by_name,
}

ORACLES = {
    "feature_outer_merge": """
WITH base AS (SELECT doc_id AS protid, lang, n_chars FROM documents),
marks AS (SELECT doc_id AS protid, quality FROM labels),
vectors AS (SELECT vec_id AS protid, label FROM embeddings),
lines AS (SELECT l_partkey AS protid, count(*) AS n_lines, round(avg(l_tax), 6) AS mean_tax
          FROM lineitem GROUP BY 1)
SELECT DISTINCT protid, lang, n_chars, quality, label, n_lines, mean_tax
FROM base FULL JOIN marks USING (protid) FULL JOIN vectors USING (protid)
  FULL JOIN lines USING (protid)""",
    "feature_outer_merge_repeated": """
WITH a AS (SELECT o_custkey AS protid, o_orderstatus FROM orders),
b AS (SELECT c_custkey AS protid, c_mktsegment FROM customer),
c AS (SELECT DISTINCT user_id AS protid, event_type FROM events)
SELECT DISTINCT protid, o_orderstatus, c_mktsegment, event_type
FROM a FULL JOIN b USING (protid) FULL JOIN c USING (protid)""",
    "feature_override": """
WITH o AS (SELECT doc_id * 2 AS protid, CASE WHEN quality = 1 THEN 'xx' END AS lang,
                  CASE WHEN toxic = 0 THEN doc_id END AS n_chars FROM labels)
SELECT coalesce(d.doc_id, o.protid) AS protid,
       CASE WHEN o.protid IS NOT NULL THEN o.lang ELSE d.lang END AS lang,
       d.source,
       CASE WHEN o.protid IS NOT NULL THEN o.n_chars ELSE d.n_chars END AS n_chars
FROM documents d FULL JOIN o ON d.doc_id = o.protid""",
    "concordance": f"""
WITH {STRUCTURE_HITS_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY protid
                    ORDER BY evalue, prob DESC, fident DESC) AS place FROM model_hits),
scores AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS protid,
                  max(CAST(json_extract_string(props, '$.k') AS INTEGER)) / 100 AS tm
           FROM events GROUP BY 1)
SELECT r.protid, round(tm - fident * 0.01, 6) AS "concordance_v_K"
FROM ranked r JOIN scores s ON r.protid = s.protid
WHERE place = 1 AND evalue < 0.003 AND tm > 0.5""",
    "coordinates_join": """
SELECT vec_id AS protid, round(CAST(embedding[1] AS DOUBLE), 6) AS "PC0",
       round(CAST(embedding[2] AS DOUBLE), 6) AS "PC1", lang, n_chars
FROM embeddings JOIN documents ON vec_id = doc_id""",
    "study_right_join": """
SELECT d.doc_id AS protid, quality, source, n_chars
FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id""",
    "rows_by_name": """
SELECT doc_id AS protid, quality, CAST(NULL AS VARCHAR) AS text FROM labels
UNION ALL SELECT item_id, NULL, text FROM benchmark""",
}
