"""Meta-analysis, structure quality and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.functions.scaling import (
    confidence_band,
    rescaled,
    structure_confidence,
)
from homologrid.operators import presentation, quality, study
from homologrid.operators.ordering import with_scalars
from homologrid.sources.structures import atoms
from workload.tables import (
    LINEAGE_SQL,
    PART_FEATURES_SQL,
    lineage_text,
    part_features,
    table,
)
from homologrid.functions.taxa import lineage_names


def _binned(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("protid"), "p_retailprice", "p_size"
    )
    binned = study.quantile_bins(part, ["p_retailprice", "p_size"])
    return study.bin_weights(binned, ["p_retailprice_bin", "p_size_bin"])


def quantile_bins(spark: SparkSession, folder: str) -> DataFrame:
    return _binned(spark, folder).withColumn(
        "combined_weight", F.round("combined_weight", 8)
    )


def weighted_sample(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("protid"), "p_name", "p_retailprice"
    )
    return study.weighted_sample(part, 25, "p_retailprice")


def sampled_marks(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("protid"), "p_retailprice")
    return study.mark_sampled(part, study.weighted_sample(part, 25, "p_retailprice")).select(
        "protid", "sampled"
    )


def histogram_equal_width(spark: SparkSession, folder: str) -> DataFrame:
    found = study.equal_width_histogram(table(spark, folder, "orders"), "o_totalprice")
    return found.withColumn("bin_start", F.round("bin_start", 4))


def histogram_fixed_edges(spark: SparkSession, folder: str) -> DataFrame:
    return study.fixed_edge_histogram(table(spark, folder, "events"), "value", 4, 50, 2)


def top_k_sorted(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return study.top_rows(orders, "o_totalprice", 10, "o_orderkey").select(
        "o_orderkey", "o_totalprice"
    )


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        F.col("source").alias("run"),
        F.nullif(F.pmod("doc_id", F.lit(9)), F.lit(4)).alias("cluster"),
        F.when(F.col("n_chars") > 900, "blast+foldseek")
        .when(F.col("n_chars") > 500, "foldseek")
        .otherwise("blast")
        .alias("method"),
        F.nullif("lang", F.lit("de")).alias("organism"),
        (F.col("n_chars") / 7).alias("size"),
        F.col("n_chars").alias("chars"),
    )
    found = study.run_summary(
        documents, "run", "cluster", "method", "organism", ["chars"], ["size"]
    )
    return found.select(
        *[
            F.round(c, 6).alias(c) if c.endswith(("mean", "median")) else F.col(c)
            for c in found.columns
        ]
    )


def compactness_table(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    runs = (
        parts.groupBy(F.col("p_brand").alias("run"))
        .agg(
            F.round(F.avg("p_size"), 6).alias("Leiden"),
            F.round(F.avg("p_retailprice"), 6).alias("Structural"),
            F.count(F.lit(1)).alias("n_clusters"),
        )
        .unpivot(["run", "n_clusters"], ["Leiden", "Structural"], "method", "mean_similarity")
    )
    return study.compactness_table(runs)


def _fixed(number, digits: int):
    """A number with a fixed count of decimals."""
    return number.cast(f"decimal(10,{digits})").cast("string")


def atom_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items written as fixed-width ATOM lines, read back by column ranges."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("protid"),
        F.col("l_orderkey").cast("int").alias("line_no"),
        F.concat(
            F.lit("ATOM  "),
            F.lpad(F.pmod("l_orderkey", F.lit(100000)).cast("string"), 5, " "),
            F.lit("  CA  "),
            F.lit("GLY "),
            F.col("l_returnflag"),
            F.lpad(F.pmod("l_partkey", F.lit(10000)).cast("string"), 4, " "),
            F.lit("    "),
            F.lpad(_fixed(F.col("l_quantity"), 3), 8, " "),
            F.lpad(_fixed(F.col("l_tax"), 2), 7, " "),
            F.lit(" "),
            F.lpad(_fixed(F.col("l_discount"), 3), 8, " "),
            F.lit("  1.00"),
            F.lpad(_fixed(F.col("l_quantity") * 2, 2), 6, " "),
        ).alias("line"),
    )
    return lines


def atom_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = atoms(atom_lines(spark, folder))
    return found.groupBy("CHAIN").agg(
        F.count(F.lit(1)).alias("n_atoms"),
        F.round(F.sum("X"), 3).alias("sum_x"),
        F.round(F.sum("Y"), 3).alias("sum_y"),
        F.round(F.sum("Z"), 3).alias("sum_z"),
        F.sum("RESNUM").alias("sum_resnum"),
        F.round(F.avg("TEMP"), 6).alias("mean_temp"),
        F.max("SERIAL").alias("last_serial"),
    )


def structure_assessment(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.assess_structures(atom_lines(spark, folder))
    return found.select(
        "protid",
        "pdb_origin",
        F.round("pdb_confidence", 6).alias("pdb_confidence"),
        F.array_join(F.array_sort("pdb_chains"), ",").alias("chains"),
    )


def confidence_qc(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    per_supplier = lines.groupBy(F.col("l_suppkey").alias("protid")).agg(
        F.avg("l_discount").alias("mean_low"),
        F.max("l_discount").alias("max_low"),
        F.avg("l_quantity").alias("mean_high"),
        F.max("l_quantity").alias("max_high"),
    )
    even = F.pmod("protid", F.lit(2)) == 0
    origin = F.when(F.pmod("protid", F.lit(5)) == 0, "PDB").otherwise("Other")
    return per_supplier.select(
        "protid",
        F.round(
            structure_confidence(
                origin,
                F.when(even, F.col("mean_low")).otherwise(F.col("mean_high")),
                F.when(even, F.col("max_low")).otherwise(F.col("max_high")),
            ),
            6,
        ).alias("pdb_confidence"),
    )


def confidence_bands(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        confidence_band((F.col("l_quantity") * 2 + F.col("l_linenumber") - 3)).alias("band")
    )
    return lines.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def origin_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Origins from flags set by what a document mentions, starts and ends with."""
    documents = table(spark, folder, "documents")
    text = F.upper("text")

    def flag(condition):
        return condition.cast("int")

    scores = quality.origin_scores(
        {
            quality.PREDICTED_A: flag(text.contains("TION")),
            quality.PREDICTED_B: flag(text.contains("SCH")),
            quality.ARCHIVE: flag(text.contains("LES")),
        },
        {
            quality.PREDICTED_A: flag(F.col("lang") == "fr"),
            quality.PREDICTED_B: flag(F.col("lang").isin("fr", "de")),
        },
        {
            quality.PREDICTED_A: flag(F.col("n_chars") % 2 == 0),
            quality.PREDICTED_B: flag(F.col("n_chars") % 3 == 0),
            quality.ARCHIVE_REMARK: flag(F.col("n_chars") % 5 == 0),
        },
        flag(F.col("source") == "web"),
    )
    return documents.select("doc_id", quality.best_origin(scores).alias("origin"))


def rescale_minmax(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "value")
    limits = events.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    ranged = with_scalars(events, limits)
    value = rescaled(F.col("value"), F.col("low"), F.col("high"), -1.0, 1.0)
    return ranged.select("event_id", F.round(value, 8).alias("rescaled"))


def axis_range(spark: SparkSession, folder: str) -> DataFrame:
    found = presentation.axis_range(table(spark, folder, "customer"), ["c_acctbal", "c_custkey"])
    return found.select("axis", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def _rules() -> list[presentation.ColumnRule]:
    return presentation.plotting_rules("euk", wrap_text=False, decimals=1)


def _plot_table(spark: SparkSession, folder: str) -> DataFrame:
    features = part_features(spark, folder).withColumn(
        "pdb_confidence",
        F.when(F.pmod("protid", F.lit(4)) != 0, F.col("pdb_confidence") / 20),
    )
    lineage = lineage_text(spark, folder).select(
        "protid", lineage_names(F.col("lineage")).alias("Lineage")
    )
    joined = features.withColumn("Length", F.col("Length").cast("double")).join(
        lineage, "protid", "left"
    )
    return presentation.prepared(joined, _rules())


def plot_ready(spark: SparkSession, folder: str) -> DataFrame:
    ready = presentation.with_taxon(_plot_table(spark, folder), _rules())
    return ready.select(
        "protid",
        F.col("Protein names").alias("protein_names"),
        "LeidenCluster",
        "Annotation",
        "Length",
        "pdb_confidence",
        "Lineage_taxonomic",
    )


def plot_points(spark: SparkSession, folder: str) -> DataFrame:
    ready = _plot_table(spark, folder)
    return presentation.plot_points(ready, _rules(), "protid", "Length").select(
        "protid", "x", "feature", "kind", "value", "category"
    )


def hover_text(spark: SparkSession, folder: str) -> DataFrame:
    ready = _plot_table(spark, folder).select("protid", "Protein names", "LeidenCluster", "Annotation")
    return presentation.with_hover(ready, _rules()).select("protid", "hover")


def color_limits(spark: SparkSession, folder: str) -> DataFrame:
    found = presentation.color_limits(_plot_table(spark, folder), _rules())
    return found.withColumn("missing_until", F.round("missing_until", 8))


def category_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return presentation.category_table(_plot_table(spark, folder), "Annotation")


# Neutral example colours; real runs bring their own.
PALETTE = ["#1B9E77", "#D95F02", "#7570B3", "#E7298A"]


def category_colours(spark: SparkSession, folder: str) -> DataFrame:
    return presentation.category_colours(table(spark, folder, "part"), "p_brand", PALETTE)


QUERIES = {
    "category_colours": category_colours,
    "quantile_bins": quantile_bins,
    "weighted_sample": weighted_sample,
    "sampled_marks": sampled_marks,
    "histogram_equal_width": histogram_equal_width,
    "histogram_fixed_edges": histogram_fixed_edges,
    "top_k_sorted": top_k_sorted,
    "run_summary": run_summary,
    "compactness_table": compactness_table,
    "atom_scan": atom_scan,
    "structure_assessment": structure_assessment,
    "confidence_qc": confidence_qc,
    "confidence_bands": confidence_bands,
    "origin_scoring": origin_scoring,
    "rescale_minmax": rescale_minmax,
    "axis_range": axis_range,
    "plot_ready": plot_ready,
    "plot_points": plot_points,
    "hover_text": hover_text,
    "color_limits": color_limits,
    "category_sizes": category_sizes,
}

_SAMPLE = """
drawn AS (
  SELECT p_partkey AS protid, p_name, p_retailprice,
         -ln((CAST(('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || '#20230821'), 1, 13))
                AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE)) / p_retailprice AS draw
  FROM part),
sample AS (SELECT * FROM drawn ORDER BY draw, protid LIMIT 25)
"""

_PLOT = f"""
{PART_FEATURES_SQL}, {LINEAGE_SQL},
plot AS (
  SELECT f.protid, protein_names, p_type AS "LeidenCluster",
         CAST(CAST(coalesce(annotation, 0) AS INTEGER) AS VARCHAR) AS "Annotation",
         CAST(len AS DOUBLE) AS "Length",
         round_even(coalesce(CASE WHEN f.protid % 4 <> 0 THEN p_retailprice / 20 END, -1.0), 1)
           AS pdb_confidence,
         coalesce(list_transform(string_split(lineage, ', '),
                  lambda x: split_part(x, ' (', 1)), []) AS names
  FROM part_features f LEFT JOIN lineage_text t USING (protid)),
placed AS (
  SELECT *, coalesce(list_filter(['Mammalia', 'Vertebrata', 'Arthropoda', 'Ecdysozoa',
    'Lophotrochozoa', 'Metazoa', 'Fungi', 'Viridiplantae', 'Sar', 'Excavata', 'Amoebazoa',
    'Eukaryota', 'Bacteria', 'Archaea', 'Viruses'],
    lambda r: list_contains(names, r))[1], 'Other') AS taxon
  FROM plot)
"""

ORACLES = {
    "category_colours": """
WITH coded AS (
  SELECT p_brand AS category, row_number() OVER (ORDER BY p_brand) - 1 AS code
  FROM (SELECT DISTINCT p_brand FROM part)),
base AS (
  SELECT category, code // 4 AS step, CASE code % 4
           WHEN 0 THEN [27, 158, 119] WHEN 1 THEN [217, 95, 2]
           WHEN 2 THEN [117, 112, 179] ELSE [231, 41, 138] END AS rgb
  FROM coded)
SELECT category, '#' || array_to_string(list_transform(rgb,
         lambda v: printf('%02X', CAST(round(v + (255 - v) * step / (step + 1)) AS INTEGER))), '')
         AS colour
FROM base""",
    "quantile_bins": """
WITH edges AS (
  SELECT list_transform(generate_series(1, 9), lambda i: i / 10) AS s,
         quantile_cont(p_retailprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS a,
         quantile_cont(CAST(p_size AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b
  FROM part),
binned AS (
  SELECT p_partkey AS protid, p_retailprice, p_size,
         CAST(1 + len(list_filter(a, lambda e: p_retailprice > e)) AS INTEGER) AS p_retailprice_bin,
         CAST(1 + len(list_filter(b, lambda e: p_size > e)) AS INTEGER) AS p_size_bin
  FROM part, edges)
SELECT *, round(count(*) OVER (PARTITION BY p_retailprice_bin, p_size_bin)
                / count(*) OVER (), 8) AS combined_weight
FROM binned""",
    "weighted_sample": f"""
WITH {_SAMPLE} SELECT protid, p_name, p_retailprice FROM sample""",
    "sampled_marks": f"""
WITH {_SAMPLE}
SELECT p_partkey AS protid,
       CASE WHEN p_partkey IN (SELECT protid FROM sample) THEN 'yes' ELSE 'no' END AS sampled
FROM part""",
    "histogram_equal_width": """
WITH lim AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (
  SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin
  FROM orders, lim)
SELECT bin, round(lo + bin * (hi - lo) / 20, 4) AS bin_start, count(*) AS n
FROM b, lim GROUP BY bin, lo, hi""",
    "histogram_fixed_edges": """
SELECT CAST(least(floor((value - 4) / 2), 22) AS INTEGER) AS bin,
       4.0::DOUBLE + least(floor((value - 4) / 2), 22) * 2 AS bin_start, count(*) AS n
FROM events WHERE value >= 4 AND value <= 50 GROUP BY 1, 2""",
    "top_k_sorted": """
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
    "run_summary": """
WITH d AS (
  SELECT source AS run, CASE WHEN n_chars > 900 THEN 'blast+foldseek'
           WHEN n_chars > 500 THEN 'foldseek' ELSE 'blast' END AS method,
         nullif(lang, 'de') AS organism, CAST(trunc(n_chars / 7) AS INTEGER) AS size, n_chars
  FROM documents WHERE doc_id % 9 <> 4)
SELECT run, count(*) AS n, count(*) FILTER (WHERE contains(method, 'foldseek')) AS n_structure,
       count(*) FILTER (WHERE contains(method, 'blast')) AS n_sequence,
       count(DISTINCT organism) + max(CAST(organism IS NULL AS INTEGER)) AS n_species,
       round(avg(n_chars), 6) AS chars_mean, round(avg(size), 6) AS size_mean,
       round(median(n_chars), 6) AS chars_median, round(median(size), 6) AS size_median
FROM d GROUP BY run""",
    "compactness_table": """
SELECT p_brand AS run, round(avg(p_size), 6) AS "Leiden_mean", count(*) AS "Leiden_count",
       round(avg(p_retailprice), 6) AS "Structural_mean", count(*) AS "Structural_count"
FROM part GROUP BY 1""",
    "atom_scan": """
SELECT l_returnflag AS "CHAIN", count(*) AS n_atoms, round(sum(l_quantity), 3) AS sum_x,
       round(sum(round(l_tax, 2)), 3) AS sum_y, round(sum(round(l_discount, 3)), 3) AS sum_z,
       CAST(sum(l_partkey % 10000) AS BIGINT) AS sum_resnum,
       round(avg(l_quantity * 2), 6) AS mean_temp,
       CAST(max(l_orderkey % 100000) AS INTEGER) AS last_serial
FROM lineitem GROUP BY 1""",
    "structure_assessment": """
SELECT CAST(l_suppkey AS VARCHAR) AS protid, 'Other' AS pdb_origin,
       round(avg(l_quantity * 2), 6) AS pdb_confidence,
       string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS chains
FROM lineitem GROUP BY 1""",
    "confidence_qc": """
WITH s AS (
  SELECT l_suppkey AS protid, avg(l_discount) AS ml, avg(l_quantity) AS mh,
         max(l_discount) AS xl, max(l_quantity) AS xh
  FROM lineitem GROUP BY 1)
SELECT protid, round(CASE WHEN protid % 5 = 0 THEN 100.0
    WHEN CASE WHEN protid % 2 = 0 THEN xl ELSE xh END <= 1
      THEN 100 * CASE WHEN protid % 2 = 0 THEN ml ELSE mh END
    ELSE CASE WHEN protid % 2 = 0 THEN ml ELSE mh END END, 6) AS pdb_confidence
FROM s""",
    "confidence_bands": """
WITH v AS (SELECT l_quantity * 2 + l_linenumber - 3 AS x FROM lineitem)
SELECT CASE WHEN x < 0 OR x > 100 THEN NULL WHEN x = 0 OR x > 90 THEN 'very_high'
            WHEN x > 70 THEN 'confident' WHEN x > 50 THEN 'low' ELSE 'very_low' END AS band,
       count(*) AS n
FROM v GROUP BY 1""",
    "origin_scoring": """
WITH f AS (
  SELECT doc_id, contains(upper(text), 'TION') AS ma, contains(upper(text), 'SCH') AS mb,
         contains(upper(text), 'LES') AS mp, lang, n_chars, source FROM documents),
s AS (
  SELECT doc_id,
    ma::INT + (lang = 'fr')::INT + (n_chars % 2 = 0)::INT AS a,
    mb::INT + (lang = 'de')::INT + (n_chars % 2 <> 0 AND n_chars % 3 = 0)::INT AS e,
    mp::INT + (source = 'web')::INT
      + (n_chars % 2 <> 0 AND n_chars % 3 <> 0 AND n_chars % 5 = 0)::INT AS p
  FROM f),
o AS (SELECT *, 3 - a - e - p AS x FROM s)
SELECT doc_id, CASE WHEN p >= a AND p >= e AND p >= x THEN 'PDB'
  WHEN x >= a AND x >= e THEN 'Other' WHEN e >= a THEN 'ESMFold'
  ELSE 'AlphaFold' END AS origin
FROM o""",
    "rescale_minmax": """
SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())
       * 2 - 1, 8) AS rescaled
FROM events""",
    "axis_range": """
SELECT 'c_acctbal' AS axis, round(min(c_acctbal) - 0.07 * (max(c_acctbal) - min(c_acctbal)), 6) AS low,
       round(max(c_acctbal) + 0.07 * (max(c_acctbal) - min(c_acctbal)), 6) AS high FROM customer
UNION ALL
SELECT 'c_custkey', round(min(c_custkey) - 0.07::DOUBLE * (max(c_custkey) - min(c_custkey)), 6),
       round(max(c_custkey) + 0.07::DOUBLE * (max(c_custkey) - min(c_custkey)), 6) FROM customer""",
    "plot_ready": f"""
WITH {_PLOT}
SELECT protid, protein_names, "LeidenCluster", "Annotation", "Length", pdb_confidence,
       taxon AS "Lineage_taxonomic" FROM placed""",
    "plot_points": f"""
WITH {_PLOT}
SELECT protid, CAST(protid AS DOUBLE) AS x, 'LeidenCluster' AS feature, 'categorical' AS kind,
       CAST(NULL AS DOUBLE) AS value, "LeidenCluster" AS category FROM placed
UNION ALL SELECT protid, protid, 'Annotation', 'categorical', NULL, "Annotation" FROM placed
UNION ALL SELECT protid, protid, 'Lineage', 'taxonomic', NULL, taxon FROM placed
UNION ALL SELECT protid, protid, 'Length', 'continuous', "Length", NULL FROM placed
UNION ALL SELECT protid, protid, 'pdb_confidence', 'continuous', pdb_confidence, NULL
FROM placed""",
    "hover_text": f"""
WITH {_PLOT}
SELECT protid, '<b>' || CAST(protid AS VARCHAR) || '</b></br>{presentation.HOVER_RULE}'
  || '<br><b>Protein name</b>: ' || protein_names
  || '<br><b>Leiden cluster</b>: ' || "LeidenCluster"
  || '<br><b>Annotation score</b>: ' || "Annotation" AS hover
FROM placed""",
    "color_limits": f"""
WITH {_PLOT}
SELECT 'Length' AS feature,
       CASE WHEN 0 < min("Length") THEN 0.0 ELSE min("Length") END AS low,
       max("Length") AS high,
       CASE WHEN 0 < min("Length") THEN round((min("Length") / max("Length"))
            / (min("Length") / max("Length") + 1), 8) END AS missing_until
FROM placed
UNION ALL SELECT 'pdb_confidence', -1.0, 100.0, round((1 / 101.0::DOUBLE) / (1 / 101.0::DOUBLE + 1), 8)
""",
    "category_sizes": f"""
WITH {_PLOT}
SELECT "Annotation" AS category, count(*) AS n FROM placed GROUP BY 1""",
}
