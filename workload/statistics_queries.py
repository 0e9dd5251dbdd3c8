"""Cluster statistics, study tables, quality and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.operators import statistics
from homologrid.operators.densities import cluster_densities
from homologrid.operators.ordering import exact_quantiles, running_totals, value_counts
from workload.tables import table

TARGETS = ["BUILDING"]


def _balances(spark: SparkSession, folder: str) -> DataFrame:
    """Account balances by market segment; one segment has no values at all."""
    customer = table(spark, folder, "customer")
    value = F.when(F.col("c_mktsegment") != "MACHINERY", F.floor("c_acctbal")).cast("double")
    shifted = F.when(F.col("c_mktsegment") == "HOUSEHOLD", value + 2500).otherwise(value)
    return statistics.cluster_values(
        customer.select("c_mktsegment", shifted.alias("v")), "c_mktsegment", "v"
    )


def _quantities(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").withColumn(
        "group",
        F.concat_ws("-", "l_returnflag", F.pmod("l_linenumber", F.lit(3)).cast("string")),
    )
    return statistics.cluster_values(lines, "group", "l_quantity")


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    for name, digits in places.items():
        df = df.withColumn(name, F.round(name, digits))
    return df


def mwu_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(statistics.rank_sum_test(_quantities(spark, folder)), u=2, z=6, p=8)


def mwu_against_targets(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        statistics.rank_sum_test(_balances(spark, folder), TARGETS, exact=False), u=2, z=6, p=8
    )


def ks_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    found = statistics.distribution_gap_test(_quantities(spark, folder))
    return _rounded(found.select("cluster", "n1", "n2", "d"), d=8)


def ks_against_targets(spark: SparkSession, folder: str) -> DataFrame:
    found = statistics.distribution_gap_test(_balances(spark, folder), TARGETS)
    return _rounded(found, d=8, p=8)


def violin_densities(spark: SparkSession, folder: str) -> DataFrame:
    """Densities of prices by return flag and line, on one grid."""
    lines = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_returnflag", (F.col("l_linenumber") % 3).cast("string")).alias("name"),
        (F.col("l_extendedprice") / 1000).alias("price"),
    )
    return _rounded(cluster_densities(lines, "name", "price"), bandwidth=8, at=6, density=8)


def bh_fdr(spark: SparkSession, folder: str) -> DataFrame:
    """Adjustment of one p-value per part, in two families."""
    part = table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 25, "large").otherwise("small").alias("family"),
        (F.pmod(F.col("p_partkey") * 7919, F.lit(10007)) / 10007).alias("p"),
    )
    tests = part.withColumn("p", F.round(F.col("p") * F.col("p"), 6))
    return _rounded(statistics.adjust_p(tests, "p", ["family"]), padj=8)


def cluster_median_markers(spark: SparkSession, folder: str) -> DataFrame:
    found = statistics.marked_clusters(_balances(spark, folder), TARGETS)
    return _rounded(
        found.select("cluster", "n1", "padj", "median", "target_median", "marker"), padj=8
    )


def cluster_markers_vs_rest(spark: SparkSession, folder: str) -> DataFrame:
    found = statistics.marked_clusters(_quantities(spark, folder))
    return _rounded(found.select("cluster", "padj", "median", "marker"), padj=8)


def cluster_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    shares = {"lower": 0.25, "median": 0.5, "upper": 0.75, "top": 0.99}
    found = exact_quantiles(lines, "l_extendedprice", shares, ["l_returnflag"])
    return _rounded(found, lower=4, median=4, upper=4, top=4)


def midranks(spark: SparkSession, folder: str) -> DataFrame:
    """Pooled midranks of all order prices."""
    orders = table(spark, folder, "orders").select(
        F.floor(F.col("o_totalprice") / 100).alias("value")
    )
    ranked = running_totals(value_counts(orders, "value"), "value", ["n"])
    return ranked.select(
        "value", "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("midrank")
    )


QUERIES = {
    "mwu_by_cluster": mwu_by_cluster,
    "mwu_against_targets": mwu_against_targets,
    "ks_by_cluster": ks_by_cluster,
    "ks_against_targets": ks_against_targets,
    "violin_densities": violin_densities,
    "bh_fdr": bh_fdr,
    "cluster_median_markers": cluster_median_markers,
    "cluster_markers_vs_rest": cluster_markers_vs_rest,
    "cluster_quartiles": cluster_quartiles,
    "midranks": midranks,
}

_BALANCES = """
raw AS (
  SELECT c_mktsegment AS cluster,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL
              WHEN c_mktsegment = 'HOUSEHOLD' THEN floor(c_acctbal) + 2500
              ELSE floor(c_acctbal) END AS value
  FROM customer),
vals AS (
  SELECT cluster, CAST(value AS DOUBLE) AS value FROM raw WHERE value IS NOT NULL
  UNION ALL SELECT cluster, 0.0 FROM raw GROUP BY cluster HAVING count(value) = 0)
"""

_QUANTITIES = """
vals AS (
  SELECT l_returnflag || '-' || CAST(l_linenumber % 3 AS VARCHAR) AS cluster,
         l_quantity AS value
  FROM lineitem)
"""

# Pooled samples spelled out: one row per member of each comparison.
_POOL_REST = """
names AS (SELECT DISTINCT cluster FROM vals),
pool AS (
  SELECT n.cluster, v.value, v.cluster = n.cluster AS own FROM names n CROSS JOIN vals v)
"""

_POOL_TARGETS = """
names AS (SELECT DISTINCT cluster FROM vals),
pool AS (
  SELECT cluster, value, TRUE AS own FROM vals
  UNION ALL
  SELECT n.cluster, v.value, FALSE FROM names n
  JOIN vals v ON v.cluster = 'BUILDING')
"""

_RANK_SUM = """
cells AS (
  SELECT cluster, value, count(*) AS t, count(*) FILTER (WHERE own) AS mine
  FROM pool GROUP BY 1, 2),
ranked AS (
  SELECT *, sum(t) OVER (PARTITION BY cluster ORDER BY value) - (t - 1) / 2.0 AS midrank
  FROM cells),
sums AS (
  SELECT cluster, CAST(sum(mine) AS DOUBLE) AS n1, CAST(sum(t - mine) AS DOUBLE) AS n2,
         sum(mine * midrank) AS r1,
         sum(CAST(t AS DOUBLE) * t * t - t) AS ties
  FROM ranked GROUP BY cluster),
stats AS (
  SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM sums),
scored AS (
  SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
         / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z
  FROM stats),
tails AS (
  SELECT cluster, CASE WHEN z <= 0 THEN 1.0 WHEN z > 8 THEN 0.0 ELSE
    2 * (0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(
      generate_series(0, 150),
      lambda k: exp((2 * k + 1) * ln(z) - (lgamma(2.0 * k + 2) - k * ln(2.0) - lgamma(k + 1.0))))))
    END AS p
  FROM scored),
tested AS (SELECT s.*, p FROM scored s JOIN tails USING (cluster))
"""

# A sample of one value without ties has an exact p: its rank is uniform.
_EXACT_SINGLE = """
tested AS (
  SELECT t.* EXCLUDE (p), CASE WHEN n1 = 1 AND ties = 0
    THEN least(1.0, 2 * (n2 - ceil(greatest(u, n2 - u)) + 1) / (n2 + 1)) ELSE p END AS p
  FROM plain t)
"""

_ADJUST = """
ranks AS (
  SELECT cluster, p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r,
         count(*) OVER () AS m FROM tested),
adjusted AS (
  SELECT cluster, least(1.0, min(p * m / r) OVER (ORDER BY p DESC)) AS padj FROM ranks)
"""

_GAPS = """
cells AS (
  SELECT cluster, value, count(*) FILTER (WHERE own) AS a,
         count(*) FILTER (WHERE NOT own) AS b FROM pool GROUP BY 1, 2),
steps AS (
  SELECT cluster,
         sum(a) OVER w / sum(a) OVER (PARTITION BY cluster) AS fa,
         sum(b) OVER w / sum(b) OVER (PARTITION BY cluster) AS fb,
         sum(a) OVER (PARTITION BY cluster) AS n1, sum(b) OVER (PARTITION BY cluster) AS n2
  FROM cells WINDOW w AS (PARTITION BY cluster ORDER BY value)),
gaps AS (
  SELECT cluster, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2,
         max(abs(fa - fb)) AS d FROM steps GROUP BY cluster)
"""

# Lattice paths that stay inside the band, row by row: a point is reached from the point on
# its left and the one below, so a row is the running sum of the row before, cut to the band.
# Every step is divided by the number of orders so far, as a share of all orders.
_PATHS = """
bands AS (
  SELECT cluster, n1, n2, CAST(round(d * n1 * n2) AS BIGINT) AS gap FROM gaps),
paths AS (
  SELECT cluster, n1, n2, gap, 0 AS i,
         list_transform(generate_series(0, n2), lambda j: CASE WHEN j * n1 < gap THEN 1.0::DOUBLE ELSE 0.0 END) AS ways
  FROM bands
  UNION ALL
  SELECT cluster, n1, n2, gap, i + 1,
         list_transform(generate_series(0, n2), lambda j:
           CASE WHEN abs((i + 1) * n2 - j * n1) < gap
             THEN list_sum(ways[greatest(1, 1 + CAST(floor(((i + 1) * n2 - gap) / n1) + 1 AS BIGINT)):j + 1])
                  * (i + 1.0) / (n2 + i + 1.0)
             ELSE 0.0 END)
  FROM paths WHERE i < n1),
shares AS (
  SELECT cluster, CASE WHEN gap = 0 THEN 0.0 ELSE ways[n2 + 1] END AS inside
  FROM paths WHERE i = n1)
"""

ORACLES = {
    "mwu_by_cluster": f"""
WITH {_QUANTITIES}, {_POOL_REST}, {_RANK_SUM}
SELECT cluster, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 2) AS u,
       round(z, 6) AS z, round(p, 8) AS p FROM tested""",
    "mwu_against_targets": f"""
WITH {_BALANCES}, {_POOL_TARGETS}, {_RANK_SUM}
SELECT cluster, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 2) AS u,
       round(z, 6) AS z, round(p, 8) AS p FROM tested""",
    "ks_by_cluster": f"""
WITH {_QUANTITIES}, {_POOL_REST}, {_GAPS}
SELECT cluster, n1, n2, round(d, 8) AS d FROM gaps""",
    "ks_against_targets": f"""
WITH RECURSIVE {_BALANCES}, {_POOL_TARGETS}, {_GAPS}, {_PATHS}
SELECT cluster, n1, n2, round(d, 8) AS d,
       round(greatest(0.0, 1 - inside), 8) AS p
FROM gaps JOIN shares USING (cluster)""",
    "violin_densities": """
WITH vals AS (
  SELECT l_returnflag || '-' || CAST(l_linenumber % 3 AS VARCHAR) AS cluster,
         CAST(l_extendedprice AS DOUBLE) / 1000 AS x FROM lineitem),
kernels AS (
  SELECT cluster, count(*) AS n, 1.06 * stddev_samp(x) * pow(count(*), -0.2) AS bandwidth FROM vals GROUP BY cluster),
grid AS (
  SELECT CAST(i AS INTEGER) AS point, low + i * (high - low) / 99 AS spot
  FROM (SELECT min(x) AS low, max(x) AS high FROM vals), unnest(range(100)) AS t(i))
SELECT cluster, n, round(bandwidth, 8) AS bandwidth, point, round(spot, 6) AS "at",
       round(sum(exp(-0.5 * pow((spot - x) / bandwidth, 2))) / (n * bandwidth * sqrt(2 * pi())), 8) AS density
FROM vals JOIN kernels USING (cluster), grid GROUP BY cluster, n, bandwidth, point, spot""",
    "bh_fdr": """
WITH raw AS (
  SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS family,
         (p_partkey * 7919 % 10007) / 10007.0 AS p0 FROM part),
tests AS (SELECT p_partkey, family, round(CAST(p0 AS DOUBLE) * CAST(p0 AS DOUBLE), 6) AS p FROM raw),
ranks AS (
  SELECT *, count(*) OVER (PARTITION BY family ORDER BY p) AS r,
         count(*) OVER (PARTITION BY family) AS m FROM tests)
SELECT p_partkey, family, p,
  round(least(1.0, min(p * m / r) OVER (PARTITION BY family ORDER BY p DESC)), 8) AS padj
FROM ranks""",
    "cluster_median_markers": f"""
WITH {_BALANCES}, {_POOL_TARGETS}, {_RANK_SUM.replace("tested AS", "plain AS")}, {_EXACT_SINGLE},
{_ADJUST},
meds AS (SELECT cluster, median(value) AS median FROM vals GROUP BY cluster),
target AS (SELECT median(value) AS target_median FROM vals WHERE cluster = 'BUILDING')
SELECT t.cluster, CAST(n1 AS BIGINT) AS n1, round(padj, 8) AS padj, median, target_median,
  CASE WHEN padj > 0.001 THEN '.' WHEN median < target_median THEN 'v'
       WHEN median > target_median THEN '^' ELSE 'o' END AS marker
FROM tested t JOIN adjusted USING (cluster) JOIN meds USING (cluster), target""",
    "cluster_markers_vs_rest": f"""
WITH {_QUANTITIES}, {_POOL_REST}, {_RANK_SUM}, {_ADJUST},
meds AS (SELECT cluster, median(value) AS median FROM vals GROUP BY cluster)
SELECT t.cluster, round(padj, 8) AS padj, median,
       CASE WHEN padj > 0.001 THEN '.' ELSE '*' END AS marker
FROM tested t JOIN adjusted USING (cluster) JOIN meds USING (cluster)""",
    "cluster_quartiles": """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS "lower",
       round(quantile_cont(l_extendedprice, 0.5), 4) AS "median",
       round(quantile_cont(l_extendedprice, 0.75), 4) AS "upper",
       round(quantile_cont(l_extendedprice, 0.99), 4) AS "top"
FROM lineitem GROUP BY 1""",
    "midranks": """
WITH v AS (SELECT CAST(floor(o_totalprice / 100) AS BIGINT) AS value FROM orders),
c AS (SELECT value, count(*) AS n FROM v GROUP BY 1)
SELECT value, n, CAST(sum(n) OVER (ORDER BY value) - n + (n + 1) / 2 AS DOUBLE) AS midrank
FROM c""",
}
