"""Similarity, blocks, compactness, neighbours, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.operators import clusters, similarity
from homologrid.operators.vectors import moments, vector_width
from homologrid.sources.tabular import melt_matrix
from workload.tables import SPARSE_SCORES_SQL, sparse_scores, table

KEYS = [0, 7, 42]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("protid"), F.col("embedding").alias("vector"), "label"
    )


def pair_similarity_dense(spark: SparkSession, folder: str) -> DataFrame:
    profile = similarity.similarity_profile(_vectors(spark, folder))
    return profile.select(
        "protid",
        "n_targets",
        F.round("mean_similarity", 6).alias("mean_similarity"),
        F.round("mean_square", 6).alias("mean_square"),
    )


def key_vs_all(spark: SparkSession, folder: str) -> DataFrame:
    found = similarity.key_similarities(_vectors(spark, folder), KEYS)
    return found.select(
        "protid", *[F.round(f"TMscore_v_{k}", 6).alias(f"TMscore_v_{k}") for k in KEYS]
    )


def block_similarity(spark: SparkSession, folder: str) -> DataFrame:
    blocks = similarity.block_similarity(_vectors(spark, folder), "label")
    return blocks.withColumn("similarity", F.round("similarity", 6))


def _score_groups(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("protid"), F.col("s_nationkey").alias("cluster")
    )
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("protid"), F.col("p_brand").alias("cluster")
    )
    return suppliers, parts


def block_similarity_sparse(spark: SparkSession, folder: str) -> DataFrame:
    suppliers, parts = _score_groups(spark, folder)
    blocks = similarity.block_similarity_of_scores(
        sparse_scores(spark, folder), suppliers, parts
    )
    return blocks.withColumn("similarity", F.round("similarity", 12))


def cluster_compactness(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder).withColumn(
        "residue", F.pmod("protid", F.lit(7)).cast("int")
    )
    runs = [
        similarity.vector_compactness(vectors, name, "vector", name)
        for name in ("label", "residue")
    ]
    return runs[0].unionAll(runs[1]).withColumn(
        "mean_similarity", F.round("mean_similarity", 6)
    )


def score_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("query"),
        F.col("l_partkey").alias("target"),
        F.col("l_tax").alias("score"),
    )
    return similarity.conflicting_pairs(raw)


def similarity_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Mean order price of (nation, segment), wide and zero-filled."""
    scores = (
        table(spark, folder, "customer")
        .groupBy(F.col("c_nationkey").alias("query"), F.col("c_mktsegment").alias("target"))
        .agg(F.round(F.avg("c_acctbal"), 4).alias("score"))
    )
    return similarity.wide_matrix(scores, SEGMENTS)


def matrix_melt(spark: SparkSession, folder: str) -> DataFrame:
    return melt_matrix(similarity_pivot(spark, folder))


def cluster_labels_padded(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    members = part.select(
        F.concat("p_brand", F.lit(".pdb")).alias("ClusterRep"),
        F.concat(F.col("p_partkey").cast("string"), F.lit(".pdb")).alias("protid"),
    )
    return clusters.structure_clusters(members)


def second_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Centred second moments of the vectors: what the components are made of."""
    vectors = _vectors(spark, folder)
    width = vector_width(vectors, "vector")
    count, total, gram = moments(vectors, "vector", width)
    means = total / count
    rows = [
        (i, j, round(float(gram[i, j] / count - means[i] * means[j]), 6) + 0.0)
        for i in range(width)
        for j in range(width)
    ]
    return spark.createDataFrame(rows, "i int, j int, covariance double")


QUERIES = {
    "pair_similarity_dense": pair_similarity_dense,
    "key_vs_all": key_vs_all,
    "block_similarity": block_similarity,
    "block_similarity_sparse": block_similarity_sparse,
    "cluster_compactness": cluster_compactness,
    "score_conflicts": score_conflicts,
    "similarity_pivot": similarity_pivot,
    "matrix_melt": matrix_melt,
    "cluster_labels_padded": cluster_labels_padded,
    "second_moments": second_moments,
}

_PAIRS = """
pairs AS (
  SELECT a.vec_id AS q, a.label AS ql, b.vec_id AS t, b.label AS tl,
         list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
  FROM embeddings a CROSS JOIN embeddings b
)
"""

_PIVOT = """
cells AS (
  SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 4) AS score
  FROM customer GROUP BY 1, 2
)
"""

ORACLES = {
    "pair_similarity_dense": f"""
WITH {_PAIRS}
SELECT q AS protid, count(*) AS n_targets, round(avg(sim), 6) AS mean_similarity,
       round(avg(sim * sim), 6) AS mean_square
FROM pairs GROUP BY q""",
    "key_vs_all": """
SELECT a.vec_id AS protid,
""" + ",\n".join(
        f"""  round((SELECT list_dot_product(CAST(a.embedding AS DOUBLE[]),
         CAST(k.embedding AS DOUBLE[])) FROM embeddings k WHERE k.vec_id = {key}), 6)
    AS "TMscore_v_{key}" """
        for key in KEYS
    ) + "\nFROM embeddings a",
    "block_similarity": f"""
WITH {_PAIRS}
SELECT tl AS target_cluster, ql AS query_cluster, round(avg(sim), 6) AS similarity
FROM pairs GROUP BY 1, 2""",
    "block_similarity_sparse": f"""
WITH {SPARSE_SCORES_SQL},
q AS (SELECT s_suppkey AS id, s_nationkey AS cluster FROM supplier
      WHERE s_suppkey IN (SELECT query FROM sparse_scores)),
t AS (SELECT p_partkey AS id, p_brand AS cluster FROM part
      WHERE p_partkey IN (SELECT target FROM sparse_scores)),
dense AS (
  SELECT q.cluster AS query_cluster, t.cluster AS target_cluster,
         avg(coalesce(score, 0)) AS similarity, count(score) AS given
  FROM q CROSS JOIN t LEFT JOIN sparse_scores s ON s.query = q.id AND s.target = t.id
  GROUP BY 1, 2)
SELECT target_cluster, query_cluster, round(similarity, 12) AS similarity
FROM dense WHERE given > 0""",
    "cluster_compactness": f"""
WITH {_PAIRS},
a AS (SELECT 'label' AS run, ql AS c, avg(sim) AS s FROM pairs WHERE ql = tl GROUP BY 2),
b AS (SELECT 'residue' AS run, q % 7 AS c, avg(sim) AS s FROM pairs
      WHERE q % 7 = t % 7 GROUP BY 2)
SELECT run, round(avg(s), 6) AS mean_similarity, count(*) AS n_clusters FROM a GROUP BY run
UNION ALL
SELECT run, round(avg(s), 6), count(*) FROM b GROUP BY run""",
    "score_conflicts": """
SELECT l_suppkey AS query, l_partkey AS target, min(l_tax) AS lowest, max(l_tax) AS highest
FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_tax) > 1""",
    "similarity_pivot": f"""
WITH {_PIVOT}
SELECT c_nationkey AS protid,
""" + ",\n".join(
        f"  coalesce(max(score) FILTER (WHERE c_mktsegment = '{s}'), 0) AS \"{s}\""
        for s in SEGMENTS
    ) + "\nFROM cells GROUP BY 1",
    "matrix_melt": f"""
WITH {_PIVOT},
names AS (SELECT unnest({SEGMENTS!r}) AS target)
SELECT q.c_nationkey AS query, n.target, coalesce(c.score, 0) AS score
FROM (SELECT DISTINCT c_nationkey FROM cells) q CROSS JOIN names n
LEFT JOIN cells c ON c.c_nationkey = q.c_nationkey AND c.c_mktsegment = n.target""",
    "cluster_labels_padded": """
WITH coded AS (
  SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand || '.pdb') - 1 AS code FROM part),
ranked AS (
  SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part),
width AS (SELECT length(CAST(max(code) AS VARCHAR)) AS w FROM ranked)
SELECT CAST(p_partkey AS VARCHAR) AS protid,
       'SC' || lpad(CAST(code AS VARCHAR), CAST(w AS INTEGER), '0') AS "StruCluster"
FROM ranked, width""",
    "second_moments": """
WITH long AS (
  SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS i,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
mean AS (SELECT i, avg(x) AS m FROM long GROUP BY i),
prod AS (SELECT a.i, b.i AS j, avg(a.x * b.x) AS xy
         FROM long a JOIN long b USING (vec_id) GROUP BY 1, 2)
SELECT p.i, p.j, round(xy - a.m * b.m, 6) + 0.0 AS covariance
FROM prod p JOIN mean a ON a.i = p.i JOIN mean b ON b.i = p.j""",
}
