"""Exact top-k inner products by sorted lists without random access.

Candidates are cut into blocks.  In a block every dimension is a list of candidates sorted by
component; a query reads the list from its high or its low end, by the sign of its own component.
Lists are read in rounds, all to the same depth.  For every candidate seen there is a lower
bound (what was read, and the worst end of the lists where it was not met) and an
upper bound (what was read, and the frontier of the other lists); a candidate whose upper
bound falls below the k-th lower bound is out.  Reading stops when nothing outside the k best
lower bounds can qualify any more, ties included, and the scores of those that stay
are resolved by finishing their sums.  A query's bests of all blocks are merged by a ranking
that Spark cuts inside the tasks.

Query blocks meet candidate blocks as whole blocks, bounded on both sides.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a
shorter vector counts as zero beyond its length; ties go to the smaller id; a query never
meets its own row, but rows that repeat its id do; a null id is no query and
ranks behind all ids among ties; scores are whole numbers that must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homologrid.llm.common import quoted, table
from homologrid.staging import StageArea

SCALE = 1024
K = 10
QUERY_STEP = 100
CANDIDATE_ROWS = 4096
QUERY_ROWS = 256
# Shares of a list read after each round.
DEPTHS = (0.5, 0.7, 0.78, 0.86, 1.0)
# Reading stops when at most one in so many candidates can still qualify; their scores are resolved.
FEW = 16


def scaled(vector: str):
    """Whole components floor(1024 x) of a usable vector, as doubles; null otherwise."""
    x = F.col(quoted(vector))
    values = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    usable = x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    )
    return F.when(usable, values)


class Lists:
    """A block of candidates with one sorted list per dimension, kept for both directions."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n, width = values.shape
        up = np.argsort(values.T, axis=1, kind="stable")
        # Side 0 is read from the smallest component on, side 1 from the largest.
        self.order = np.stack((up, up[:, ::-1]))
        self.sorted = np.ascontiguousarray(np.take_along_axis(values.T[None], self.order, axis=2))
        kind = np.int16 if n < 1 << 15 else np.int32
        self.place = np.empty((n, width), kind)
        np.put_along_axis(self.place, up.T, np.arange(n, dtype=kind)[:, None], axis=0)

    def best(self, query: np.ndarray, k: int, hidden: np.ndarray) -> np.ndarray:
        """Positions that hold the ``k`` largest inner products, ties with the k-th included.

        ``hidden`` candidates do not count.
        """
        n, width = self.values.shape
        alive = np.flatnonzero(~hidden)
        if len(alive) <= k or not query.any():
            return alive
        dims = np.arange(width)
        side = (query > 0).astype(np.intp)
        # What the far end of each list adds: nothing can add less.
        worst = self.sorted[side, dims, n - 1] * query
        # Where each list has each candidate, counted from the end that is read.
        place = np.where(side == 1, n - 1 - self.place, self.place)
        gained = np.zeros(n)
        read = 0
        for share in DEPTHS:
            depth = n if share == 1.0 else max(read + 1, int(n * share))
            if depth <= read or depth > n:
                continue
            met = self.order[side, dims, read:depth]
            adds = self.sorted[side, dims, read:depth] * query[:, None]
            gained += np.bincount(met.ravel(), adds.ravel(), minlength=n)
            read = depth
            # Both bounds add something for every list that has not shown the candidate yet.
            ends = np.stack((worst, adds[:, -1]), axis=1)
            if len(alive) > n // 2:
                bounds = ((place >= depth).astype(np.float64) @ ends)[alive]
            else:
                bounds = (place[alive] >= depth).astype(np.float64) @ ends
            lower, upper = gained[alive] + bounds.T
            kth = np.partition(lower, len(lower) - k)[len(lower) - k]
            alive = alive[upper >= kth]
            if len(alive) <= max(4 * k, n // FEW):
                break
        return alive


def _block_bests(k: int):
    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["query_id", "asked", "vec_id", "score"]
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        own = _matrix(candidates["values"])
        asked = _matrix(queries["values"])
        width = max(own.shape[1], asked.shape[1])
        own = np.pad(own, ((0, 0), (0, width - own.shape[1])))
        asked = np.pad(asked, ((0, 0), (0, width - asked.shape[1])))
        ids = candidates["id"].to_pylist()
        numbers = candidates["number"].to_numpy()
        lists = Lists(own)
        # Sums of products beyond 2^53 are not exact in doubles: whole numbers then.
        exact = float(np.abs(own).max(initial=0)) * float(np.abs(asked).max(initial=0)) * width < 2.0**52
        out: list[tuple] = []
        for query_id, number, query in zip(queries["id"].to_pylist(), queries["number"].to_pylist(), asked):
            hidden = numbers == number
            if exact:
                found = lists.best(query, k, hidden)
                scores = (own[found] @ query).astype(np.int64).tolist()
            else:
                found = np.flatnonzero(~hidden)
                scores = [sum(int(a) * int(b) for a, b in zip(own[i], query)) for i in found]
            ranked = sorted(
                ((-s, ids[i] is None, ids[i] or 0, i) for s, i in zip(scores, found.tolist()))
            )[:k]
            out += [(query_id, number, ids[i], -s) for s, _, _, i in ranked]
        return pa.table({n: pa.array([o[j] for o in out], pa.int64()) for j, n in enumerate(names)})

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = [np.asarray(x, np.float64) for x in column.to_pylist()]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def top_k(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    query_step: int = QUERY_STEP,
    candidate_rows: int = CANDIDATE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for every id divisible by ``query_step``."""
    area = StageArea(vectors.sparkSession, "top-k")
    rows = area.write(
        vectors.select(
            F.col(quoted(key)).cast("long").alias("id"),
            scaled(vector).alias("values"),
            F.monotonically_increasing_id().alias("number"),
        ).where(F.col("values").isNotNull()),
        "scaled",
    )
    asked = F.coalesce(F.pmod("id", F.lit(query_step)) == 0, F.lit(False))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("q")).first()
    blocks = max(1, -(-counts["n"] // candidate_rows))
    groups = max(1, -(-counts["q"] // query_rows))
    mixed = F.xxhash64("number")
    candidates = rows.select(
        F.pmod(mixed, F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        "id",
        "number",
        "values",
    )
    queries = rows.where(asked).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(mixed, F.lit(groups)).cast("int").alias("group"),
        "id",
        "number",
        "values",
    )
    bests = (
        queries.groupBy("block", "group")
        .cogroup(candidates.groupBy("block", "group"))
        .applyInArrow(_block_bests(k), "query_id long, asked long, vec_id long, score long")
    )
    best_first = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        bests.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op8_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))


OP8_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM pairs
)
SELECT * FROM ranked WHERE rank <= 10
"""

QUERIES = {"op8_exact_top_k": op8_exact_top_k}
ORACLES = {"op8_exact_top_k": OP8_SQL}
