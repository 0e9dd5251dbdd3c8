"""Neighbours, communities, covers, components and layouts of the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.operators import alignment, graph, layout, reduction, tile_field
from homologrid.operators.neighbours import default_neighbours, neighbour_lists, neighbour_rows
from homologrid.operators.vectors import vector_width
from homologrid.plans.clustering import communities_of_vectors
from workload.tables import table


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("protid"), F.col("embedding").alias("vector")
    )


def knn_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest tenth of all vectors of each vector, ten at least: rows grow with the square of the table."""
    vectors = _vectors(spark, folder)
    near = default_neighbours(vectors.count(), share=0.1)
    rows = neighbour_rows(neighbour_lists(vectors, near, written=False))
    return rows.withColumn("distance", F.round("distance", 6))


def knn_in_degree(spark: SparkSession, folder: str) -> DataFrame:
    """How often each vector is among the ten nearest of another (hubs)."""
    rows = neighbour_rows(neighbour_lists(_vectors(spark, folder), 10, block_rows=128))
    return rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance")
    )


def neighbour_graph_symmetric(spark: SparkSession, folder: str) -> DataFrame:
    """Undirected neighbour graph with the number of directions of each edge."""
    rows = neighbour_rows(neighbour_lists(_vectors(spark, folder), 10))
    directed = rows.select(
        F.col("query").alias("src"), F.col("target").alias("dst"), F.lit(1.0).alias("w")
    )
    return graph.both_ways(directed).select(
        "src", "dst", (F.col("a") + F.col("b")).cast("int").alias("directions")
    )


def fuzzy_weights(spark: SparkSession, folder: str) -> DataFrame:
    return graph.fuzzy_graph(neighbour_lists(_vectors(spark, folder), 15, metric="euclidean"))


def leiden_membership(spark: SparkSession, folder: str) -> DataFrame:
    return communities_of_vectors(_vectors(spark, folder))


def setcover_clusters(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    rows = neighbour_rows(neighbour_lists(vectors, 10))
    pairs = rows.select(F.col("query").alias("src"), F.col("target").alias("dst"))
    return graph.set_cover(pairs, vectors.select(F.col("protid").alias("node")))


def pca_scores(spark: SparkSession, folder: str) -> DataFrame:
    reduced = reduction.principal_components(_vectors(spark, folder), 2)
    return reduction.coordinate_columns(reduced, "PC", 2)


def pca_variance(spark: SparkSession, folder: str) -> DataFrame:
    """All components together keep the total variance, are centred and uncorrelated."""
    vectors = _vectors(spark, folder)
    width = vector_width(vectors, "vector")
    reduced = reduction.coordinate_columns(
        reduction.principal_components(vectors, width), "PC", width
    )
    names = [f"PC{i}" for i in range(width)]
    total = " + ".join(f"var_pop({name})" for name in names)
    worst_mean = "greatest(" + ", ".join(f"abs(avg({name}))" for name in names) + ")"
    worst_pair = (
        "greatest("
        + ", ".join(f"abs(covar_pop({a}, {b}))" for a, b in zip(names, names[1:]))
        + ")"
    )
    return reduced.agg(
        F.expr(f"round({total}, 8)").alias("total_variance"),
        F.expr(f"round({worst_mean}, 8)").alias("largest_mean"),
        F.expr(f"round({worst_pair}, 8)").alias("largest_covariance"),
        F.count(F.lit(1)).alias("n"),
    )


def similarity_pca_scores(spark: SparkSession, folder: str) -> DataFrame:
    reduced = reduction.similarity_components(_vectors(spark, folder), 2)
    return reduction.coordinate_columns(reduced, "PC", 2)


def score_table_pca(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the sparse (customer, part) quantity table."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    scores = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("query"), F.col("l_partkey").alias("target"))
        .agg(F.max("l_quantity").alias("score"))
    )
    reduced = reduction.score_components(scores, 2, extra=30)
    return reduction.coordinate_columns(reduced, "PC", 2)


def tsne_layout(spark: SparkSession, folder: str) -> DataFrame:
    found = layout.reduce_dimensions(_vectors(spark, folder), "pca_tsne")
    return reduction.coordinate_columns(found, "tSNE", 2, first=1)


def umap_layout(spark: SparkSession, folder: str) -> DataFrame:
    found = layout.reduce_dimensions(_vectors(spark, folder), "pca_umap")
    return reduction.coordinate_columns(found, "UMAP", 2, first=1)


def map_repulsion(spark: SparkSession, folder: str) -> DataFrame:
    """The push of all rows of a map on every row; the map is the first two entries of the vectors."""
    places = [(F.get("vector", F.lit(axis)).cast("double") * 200).alias(f"y{axis}") for axis in range(2)]
    rows = _vectors(spark, folder).select(F.col("protid").alias("id"), *places).dropna()
    return tile_field.row_pushes(rows).select(
        "id", *[(F.round(f"push{axis}", 3) + 0.0).alias(f"push{axis}") for axis in range(2)]
    )


def structure_pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    """TM-scores of every vector, read as a chain of 3-D points, with its nearest ones."""
    vectors = _vectors(spark, folder)
    chain = F.sequence(F.lit(0), F.floor(F.size("vector") / 3).cast("int") - 1)
    carbons = vectors.select("protid", "vector", F.explode(chain).alias("residue")).select(
        "protid",
        "residue",
        *[
            (F.get("vector", F.col("residue") * 3 + i).cast("double") * 10).alias(axis)
            for i, axis in enumerate("xyz")
        ],
    )
    pairs = neighbour_rows(neighbour_lists(vectors, 5)).select("query", "target")
    return alignment.index_scores(pairs, alignment.chains(carbons))


# Residues that the copies of structure_alignment_copies lack, counted from 0.
GONE = (0, 1, 2, 10)


def structure_alignment_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as a chain, aligned both ways with a turned copy that lacks some residues and numbers anew."""
    given = _vectors(spark, folder).select(
        F.concat(F.lit("V"), F.col("protid").cast("string")).alias("protid"),
        F.posexplode(F.slice("vector", 1, F.floor(F.size("vector") / 3).cast("int") * 3)).alias("place", "value"),
    )
    at = F.pmod("place", F.lit(3))
    carbons = (
        given.groupBy("protid", F.floor(F.col("place") / 3).cast("int").alias("residue"))
        .agg(*[F.max(F.when(at == i, F.col("value").cast("double") * 10)).alias(a) for i, a in enumerate("xyz")])
    )
    # A quarter turn about one axis, a shift, and other numbers for the residues.
    copies = carbons.where(~F.col("residue").isin(*GONE)).select(
        F.concat(F.lit("copy-"), "protid").alias("protid"),
        (F.col("residue") * 2 + 500).alias("residue"),
        (-F.col("y") + 3).alias("x"),
        (F.col("x") - 7).alias("y"),
        (F.col("z") + 11).alias("z"),
    )
    structures = alignment.chains(carbons.unionByName(copies))
    names = carbons.select("protid").distinct()
    copy = F.concat(F.lit("copy-"), "protid")
    pairs = names.select(F.col("protid").alias("query"), copy.alias("target")).union(names.select(copy, "protid"))
    return alignment.alignment_scores(pairs, structures).select(
        "query", "target", F.round("score", 5).alias("score"), F.col("aligned").cast("long").alias("aligned")
    )


def sequence_double_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors, spelled in nine letters, with at least three equal 4-mers on one diagonal."""
    value = lambda x: F.least(F.greatest(F.floor(x.cast("double") * 16) + 4, F.lit(0)), F.lit(8))
    letters = F.transform("vector", lambda x: F.substring(F.lit("ACDEFGHIK"), (value(x) + 1).cast("int"), F.lit(1)))
    sequences = _vectors(spark, folder).select("protid", F.array_join(letters, "").alias("sequence"))
    return alignment.double_hits(sequences, k=4, least=3)


QUERIES = {
    "knn_graph": knn_graph,
    "knn_in_degree": knn_in_degree,
    "neighbour_graph_symmetric": neighbour_graph_symmetric,
    "fuzzy_weights": fuzzy_weights,
    "leiden_membership": leiden_membership,
    "setcover_clusters": setcover_clusters,
    "structure_pair_scores": structure_pair_scores,
    "structure_alignment_copies": structure_alignment_copies,
    "sequence_double_hits": sequence_double_hits,
    "pca_scores": pca_scores,
    "pca_variance": pca_variance,
    "similarity_pca_scores": similarity_pca_scores,
    "score_table_pca": score_table_pca,
    "tsne_layout": tsne_layout,
    "umap_layout": umap_layout,
    "map_repulsion": map_repulsion,
}

_NEAREST = """
pairs AS (
  SELECT a.vec_id AS query, b.vec_id AS target,
         round(2 - 2 * list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
                                              CAST(b.embedding AS DOUBLE[])), 10) AS d2
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY d2, target) AS INTEGER) AS rank,
         round(sqrt(greatest(d2, 0)), 6) AS distance
  FROM pairs)
"""

ORACLES = {
    "map_repulsion": """
WITH places AS (
  SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 200 AS y0, CAST(embedding[2] AS DOUBLE) * 200 AS y1 FROM embeddings),
gaps AS (
  SELECT a.id, a.y0 - b.y0 AS d0, a.y1 - b.y1 AS d1
  FROM places a JOIN places b ON a.y0 + a.y1 + b.y0 + b.y1 IS NOT NULL)
SELECT id, round(sum(d0 / pow(1 + d0 * d0 + d1 * d1, 2)), 3) + 0.0 AS push0,
       round(sum(d1 / pow(1 + d0 * d0 + d1 * d1, 2)), 3) + 0.0 AS push1
FROM gaps GROUP BY id""",
    "structure_alignment_copies": """
WITH chains AS (
  SELECT 'V' || CAST(vec_id AS VARCHAR) AS protid, len(embedding) // 3 AS n FROM embeddings),
lacking AS (
  SELECT protid, n, n - (CASE WHEN n > 10 THEN 4 ELSE least(n, 3) END) AS kept FROM chains)
SELECT protid AS query, 'copy-' || protid AS target, 1.0::DOUBLE AS score, kept AS aligned FROM lacking WHERE kept > 0
UNION ALL
SELECT 'copy-' || protid, protid, round(kept / n, 5), kept FROM lacking WHERE kept > 0""",
    "sequence_double_hits": """
WITH letters AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: substr('ACDEFGHIK',
    CAST(least(greatest(floor(CAST(x AS DOUBLE) * 16) + 4, 0), 8) AS INTEGER) + 1, 1)), '') AS sequence FROM embeddings),
places AS (SELECT vec_id, sequence, unnest(generate_series(1, len(sequence) - 3)) AS place FROM letters),
kmers AS (SELECT vec_id, place, substr(sequence, place, 4) AS kmer FROM places),
hits AS (
  SELECT a.vec_id AS query, b.vec_id AS target, b.place - a.place AS diagonal, count(*) AS hits
  FROM kmers a JOIN kmers b ON a.kmer = b.kmer AND a.vec_id < b.vec_id GROUP BY 1, 2, 3 HAVING count(*) >= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, target ORDER BY hits DESC, diagonal) AS place FROM hits)
SELECT query, target, CAST(diagonal AS INTEGER) AS diagonal, hits FROM ranked WHERE place = 1""",
    "knn_graph": f"""
WITH {_NEAREST}
SELECT query, target, rank, distance FROM ranked
WHERE rank <= (SELECT least(greatest(10, round_even(count(*) / 10.0, 0)), count(*) - 1) FROM embeddings)""",
    "knn_in_degree": f"""
WITH {_NEAREST}
SELECT target, count(*) AS n, round(avg(sqrt(greatest(d2, 0))), 6) AS mean_distance
FROM ranked WHERE rank <= 10 GROUP BY 1""",
    "neighbour_graph_symmetric": f"""
WITH {_NEAREST},
near AS (SELECT query, target FROM ranked WHERE rank <= 10),
both_ways AS (SELECT query AS src, target AS dst FROM near
         UNION ALL SELECT target, query FROM near)
SELECT src, dst, CAST(count(*) AS INTEGER) AS directions FROM both_ways GROUP BY 1, 2""",
    "pca_variance": """
WITH long AS (
  SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
v AS (SELECT i, var_pop(x) AS v FROM long GROUP BY i)
SELECT round(sum(v), 8) AS total_variance, 0.0::DOUBLE AS largest_mean,
       0.0::DOUBLE AS largest_covariance, (SELECT count(*) FROM embeddings) AS n
FROM v""",
}
