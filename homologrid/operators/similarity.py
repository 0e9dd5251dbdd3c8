"""All-against-all and key-against-all similarity, kept long and kept linear.

Two kinds of input are supported:

* score tables (``query, target, score``), sparse: a missing pair counts as 0;
* unit vectors, whose similarity is the dot product.  Sums of dot products over
  groups are dot products of group sums, so averages over all pairs need one
  pass over the rows and never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homologrid.operators.ordering import dense_codes
from homologrid.operators.vectors import (
    MAX_SHIPPED_BYTES,
    check_shipped,
    dot,
    matrix_of,
    moments,
    vector_width,
)
from homologrid.staging import StageArea

# At most this many key vectors are written into one generated expression.
KEYS_PER_PASS = 64
# Cluster means in a block; the products of two blocks take some 50 MB.
MEANS_PER_BLOCK = 1024
PAIRS_PER_BATCH = 1 << 16


def check_scores(scores: DataFrame, score: str = "score_text") -> DataFrame:
    """One row per pair; repeated pairs must agree, a conflict stops the job.

    Scores are compared as written when ``score`` is their text.
    """
    folded = scores.groupBy("query", "target").agg(
        F.min(score).alias("_low"), F.max(score).alias("_high")
    )
    message = F.concat_ws(" ", F.lit("conflicting scores for"), "query", "target")
    checked = F.when(F.col("_low").eqNullSafe(F.col("_high")), F.col("_low")).otherwise(
        F.raise_error(message).cast("string")
    )
    return folded.select("query", "target", checked.cast("double").alias("score"))


def conflicting_pairs(scores: DataFrame, score: str = "score") -> DataFrame:
    """Pairs given with more than one score."""
    return (
        scores.groupBy("query", "target")
        .agg(F.min(score).alias("lowest"), F.max(score).alias("highest"))
        .where(F.col("lowest") < F.col("highest"))
    )


def wide_matrix(scores: DataFrame, targets: Sequence[str], prefix: str = "") -> DataFrame:
    """Wide zero-filled matrix for a file contract, rows sorted by query.

    The target list is explicit (it decides the columns), so no extra pass looks
    for it.
    """
    wide = (
        scores.groupBy(F.col("query").alias("protid"))
        .pivot("target", list(targets))
        .agg(F.max("score"))
    )
    return wide.select(
        "protid",
        *[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(f"{prefix}{t}") for t in targets],
    ).orderBy("protid")


def key_similarities(
    vectors: DataFrame,
    keys: Sequence[str],
    id_column: str = "protid",
    vector: str = "vector",
    prefix: str = "TMscore_v_",
) -> DataFrame:
    """Similarity of every row to each key, one column per key - no join, no shuffle.

    Key vectors are looked up once and written into the expression.  Their number
    is checked; many keys are handled in several passes over the columns.
    """
    wanted = list(dict.fromkeys(keys))
    found = {
        row["id"]: row["v"]
        for row in vectors.where(F.col(id_column).isin(wanted))
        .select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .collect()
    }
    unknown = [key for key in wanted if key not in found]
    if unknown:
        raise ValueError(f"unknown keys: {unknown}")
    check_shipped(len(wanted), max((len(v) for v in found.values()), default=0), "key vectors")
    out = vectors.select(F.col(id_column).alias("protid"), F.col(vector).alias("_vector"))
    for start in range(0, len(wanted), KEYS_PER_PASS):
        out = out.select(
            "*",
            *[
                dot("_vector", found[key]).alias(f"{prefix}{key}")
                for key in wanted[start : start + KEYS_PER_PASS]
            ],
        )
    return out.drop("_vector")


def similarity_profile(
    vectors: DataFrame, id_column: str = "protid", vector: str = "vector"
) -> DataFrame:
    """Mean and mean square of each row's similarity to all rows, itself included.

    mean_j <v, u_j> = <v, m> and mean_j <v, u_j>^2 = v' M v with the mean m and the
    second moments M, so the whole dense matrix is summarised in linear time.
    """
    count, total, gram = moments(vectors, vector)
    if count == 0:
        return vectors.select(
            F.col(id_column).alias("protid"),
            F.lit(0).cast("bigint").alias("n_targets"),
            F.lit(None).cast("double").alias("mean_similarity"),
            F.lit(None).cast("double").alias("mean_square"),
        )
    mean = total / count
    second = gram / count
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"protid {kind}, n_targets bigint, mean_similarity double, mean_square double"

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = matrix_of(batch, "_vector")
            if len(block) == 0:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("protid")),
                    pa.array(np.full(len(block), count, dtype=np.int64)),
                    pa.array(block @ mean),
                    pa.array(np.einsum("ij,ij->i", block @ second, block)),
                ],
                names=["protid", "n_targets", "mean_similarity", "mean_square"],
            )

    return vectors.select(
        F.col(id_column).alias("protid"), F.col(vector).cast("array<double>").alias("_vector")
    ).mapInArrow(profile, schema)


def cluster_means(vectors: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean vector and size of each cluster, folded on the map side."""
    width = vector_width(vectors, vector)
    mean = ", ".join(f"avg(CAST(`{vector}`[{i}] AS DOUBLE))" for i in range(width))
    return (
        vectors.where(F.col(cluster).isNotNull())
        .groupBy(F.col(cluster).alias("cluster"))
        .agg(F.count(F.lit(1)).alias("size"), F.expr(f"array({mean})").alias("mean"))
    )


def block_similarity(vectors: DataFrame, cluster: str, vector: str = "vector") -> DataFrame:
    """Mean similarity of every cluster with every cluster, from the cluster means.

    The result has one row per pair of clusters by definition; nothing larger is
    ever made.  Means of at most ``MAX_SHIPPED_BYTES`` together reach every task at once; more of them
    meet block by block (``products_by_block``), so neither the driver nor a task holds them all.
    """
    means = StageArea(vectors.sparkSession, "means").write(
        cluster_means(vectors, cluster, vector)
    )
    return _mean_products(means)


def _mean_products(means: DataFrame) -> DataFrame:
    """<mean, mean> of all pairs of rows of a small or large table of cluster means."""
    shape = means.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("mean")).alias("d")).first()
    count, width = int(shape["n"]), int(shape["d"] or 0)
    if count * width * 8 > MAX_SHIPPED_BYTES:
        return products_by_block(means, count, width)
    shipped = means.select("cluster", "mean").toArrow().combine_chunks()
    if shipped.num_rows == 0:
        return means.sparkSession.createDataFrame([], _product_schema(means))
    names = shipped.column("cluster").combine_chunks()
    queries = matrix_of(shipped.to_batches()[0], "mean")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets = batch.column(batch.schema.get_field_index("cluster"))
            yield from _paired(targets, matrix_of(batch, "mean"), names, queries)

    return means.select("cluster", "mean").mapInArrow(multiply, _product_schema(means))


def _product_schema(means: DataFrame) -> str:
    kind = means.schema["cluster"].dataType.simpleString()
    return f"target_cluster {kind}, query_cluster {kind}, similarity double"


def _paired(
    targets: pa.Array, left: np.ndarray, queries: pa.Array, right: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Products of all rows of two blocks, in batches of about ``PAIRS_PER_BATCH`` pairs."""
    step = max(1, PAIRS_PER_BATCH // max(len(queries), 1))
    for first in range(0, len(targets), step):
        products = left[first : first + step] @ right.T
        rows, columns = products.shape
        yield pa.RecordBatch.from_arrays(
            [
                targets.take(pa.array(np.arange(first, first + rows).repeat(columns))),
                queries.take(pa.array(np.tile(np.arange(columns), rows))),
                pa.array(products.reshape(-1)),
            ],
            names=["target_cluster", "query_cluster", "similarity"],
        )


def products_by_block(
    means: DataFrame, count: int, width: int, block_rows: int = MEANS_PER_BLOCK
) -> DataFrame:
    """<mean, mean> of all pairs of rows of ``cluster, mean``, two blocks of rows a task.

    Rows are numbered and cut into blocks; the task of blocks (i, j), i <= j, gets both and gives their
    products in both orders.  A task holds at most two blocks of ``block_rows`` rows (fewer where rows are
    wide) and their products; a row is sent once for every block.
    """
    size = max(1, min(block_rows, MAX_SHIPPED_BYTES // (16 * max(width, 1))))
    blocks = -(-count // size)
    area = StageArea(means.sparkSession, "mean-blocks")
    codes = dense_codes(means.select("cluster"), "cluster")
    placed = area.write(
        means.join(codes, "cluster").select("cluster", "mean", F.floor(F.col("code") / size).alias("block")),
        "placed",
    )
    rows = placed.select(
        F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1).cast("long"))).alias("j"), "cluster", "mean"
    )
    columns = placed.select(
        F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("k"), F.col("block").alias("l"), "cluster", "mean"
    )

    def multiply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (first, one), (second, other) = (
            (t.column("cluster").combine_chunks(), matrix_of(t.combine_chunks().to_batches()[0], "mean"))
            for t in (left, right)
        )
        batches = list(_paired(first, one, second, other))
        if key[0].as_py() != key[1].as_py():
            batches += _paired(second, other, first, one)
        return pa.Table.from_batches(batches)

    return (
        rows.groupBy("i", "j").cogroup(columns.groupBy("k", "l")).applyInArrow(multiply, _product_schema(means))
    )


def block_similarity_of_scores(
    scores: DataFrame,
    query_groups: DataFrame,
    target_groups: DataFrame | None = None,
) -> DataFrame:
    """Mean score of every (target cluster, query cluster), missing pairs counting as 0.

    Only given pairs are touched: sums come from the score table, divisors from
    the cluster sizes.  ``*_groups`` are ``protid, cluster``; only proteins that
    occur in the matrix (as a query, respectively target) count.
    """
    target_groups = query_groups if target_groups is None else target_groups
    queries = query_groups.join(
        scores.select(F.col("query").alias("protid")).distinct(), "protid", "left_semi"
    )
    targets = target_groups.join(
        scores.select(F.col("target").alias("protid")).distinct(), "protid", "left_semi"
    )
    query_sizes = queries.groupBy(F.col("cluster").alias("query_cluster")).agg(
        F.count(F.lit(1)).alias("n_query")
    )
    target_sizes = targets.groupBy(F.col("cluster").alias("target_cluster")).agg(
        F.count(F.lit(1)).alias("n_target")
    )
    # Fold by query cluster and target first, so the second join moves fewer rows.
    by_query = (
        scores.join(
            queries.select(F.col("protid").alias("query"), F.col("cluster").alias("query_cluster")),
            "query",
        )
        .groupBy("query_cluster", "target")
        .agg(F.sum("score").alias("score"))
    )
    sums = (
        by_query.join(
            targets.select(
                F.col("protid").alias("target"), F.col("cluster").alias("target_cluster")
            ),
            "target",
        )
        .groupBy("target_cluster", "query_cluster")
        .agg(F.sum("score").alias("total"))
    )
    return (
        sums.join(query_sizes, "query_cluster")
        .join(target_sizes, "target_cluster")
        .select(
            "target_cluster",
            "query_cluster",
            (F.col("total") / (F.col("n_query") * F.col("n_target"))).alias("similarity"),
        )
    )


def fill_blocks(blocks: DataFrame, clusters: Sequence[str]) -> DataFrame:
    """Wide cluster-by-cluster matrix with zeros for pairs that share no score."""
    long = blocks.select(
        F.col("target_cluster").alias("query"),
        F.col("query_cluster").alias("target"),
        F.col("similarity").alias("score"),
    )
    return wide_matrix(long, clusters)


def compactness(blocks: DataFrame, run: str) -> DataFrame:
    """Mean of the diagonal blocks and number of clusters of one run."""
    return blocks.where(F.col("target_cluster") == F.col("query_cluster")).agg(
        F.lit(run).alias("run"),
        F.avg("similarity").alias("mean_similarity"),
        F.count(F.lit(1)).alias("n_clusters"),
    ).select("run", "mean_similarity", "n_clusters")


def vector_compactness(vectors: DataFrame, cluster: str, vector: str, run: str) -> DataFrame:
    """Compactness straight from cluster means: a diagonal block is |mean|^2."""
    means = cluster_means(vectors, cluster, vector)
    square = F.aggregate("mean", F.lit(0.0), lambda acc, x: acc + x * x)
    return means.agg(
        F.lit(run).alias("run"),
        F.avg(square).alias("mean_similarity"),
        F.count(F.lit(1)).alias("n_clusters"),
    ).select("run", "mean_similarity", "n_clusters")
