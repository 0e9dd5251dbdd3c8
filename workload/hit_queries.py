"""Hit lists, provenance and id mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.operators import hits, provenance
from homologrid.sources.id_mapping import mapping_rows
from workload.tables import (
    PART_FEATURES_SQL,
    STRUCTURE_HITS_SQL,
    part_features,
    structure_hits,
    table,
)


def hit_extract_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return hits.extract_structure_hits(structure_hits(spark, folder), F.col("pos"))


def hit_extract_cap(spark: SparkSession, folder: str) -> DataFrame:
    return hits.extract_structure_hits(structure_hits(spark, folder), F.col("pos"), limit=40)


def best_hit_per_id(spark: SparkSession, folder: str) -> DataFrame:
    best = hits.identity_features(structure_hits(spark, folder), "K")
    return best.withColumn("fident_v_K", F.round("fident_v_K", 6))


def sequence_hit_accessions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.concat(F.lit("NP_"), F.col("l_partkey").cast("string")).alias("part"),
        "l_orderkey",
        "l_linenumber",
    )
    found = lines.withColumn("sacc", F.when(F.col("flag").isNotNull(), F.col("part")))
    seen = hits.extract_sequence_hits(found, [F.col("l_orderkey"), F.col("l_linenumber")])
    return seen.select("sacc", F.col("pos.l_orderkey").alias("first_order"))


def hit_union_distinct(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("protid"))
    users = table(spark, folder, "events").select(F.col("user_id").alias("protid"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("protid"))
    return hits.union_ids([orders, users, suppliers])


def hit_filter_nullsafe(spark: SparkSession, folder: str) -> DataFrame:
    excluded = table(spark, folder, "lineitem").where(F.col("l_quantity") == 50)
    kept = hits.filter_candidates(
        part_features(spark, folder),
        min_length=60,
        max_length=400,
        excluded=excluded.select(F.col("l_partkey").alias("protid")),
    )
    return kept.select("protid", F.col("Protein names").alias("protein_names"), "Annotation")


def source_of_hits(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    proteins = events.select(F.col("user_id").alias("protid"))
    key = F.when(
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(2)) == 0, "U1"
    ).otherwise("U10")
    method = F.when(F.col("event_type").isin("click", "view"), "blast").otherwise("foldseek")
    found = events.select(F.col("user_id").alias("protid"), key.alias("key"), method.alias("method"))
    # Parts are candidates too: most of them nobody has hit.
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("protid"))
    proteins = proteins.union(parts)
    return provenance.hit_sources(proteins, found, ["U1", "U10"])


def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    requested = table(spark, folder, "customer").select(F.col("c_custkey").alias("protid"))
    fetched = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    return hits.pending_ids(requested, fetched.select(F.col("o_custkey").alias("protid")))


def id_mapping(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    payload = F.concat(
        F.lit('{"results":[{"from":"NP_'),
        F.col("user_id").cast("string"),
        F.lit('","to":"P'),
        F.get_json_object("props", "$.k"),
        F.lit('"}]}'),
    )
    mapping = mapping_rows(events.select(payload.alias("value")))
    wanted = events.where(F.col("event_type") == "signup").select(
        F.concat(F.lit("NP_"), F.col("user_id").cast("string")).alias("protid")
    )
    return hits.map_ids(wanted, mapping)


def missing_key_ids(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "documents").select(F.col("doc_id").alias("protid"))
    known = table(spark, folder, "labels").select(F.col("doc_id").alias("protid"))
    return hits.missing_keys(keys, known)


def ordered_site_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct sites of all pages with the first page of each."""
    pages = table(spark, folder, "pages")
    site = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    return hits.first_seen(
        pages.select(F.nullif(site, F.lit("")).alias("site"), "page_id"), "site", F.col("page_id")
    )


QUERIES = {
    "hit_extract_first_seen": hit_extract_first_seen,
    "hit_extract_cap": hit_extract_cap,
    "best_hit_per_id": best_hit_per_id,
    "sequence_hit_accessions": sequence_hit_accessions,
    "hit_union_distinct": hit_union_distinct,
    "hit_filter_nullsafe": hit_filter_nullsafe,
    "source_of_hits": source_of_hits,
    "resume_pending": resume_pending,
    "id_mapping": id_mapping,
    "missing_key_ids": missing_key_ids,
    "ordered_site_dedup": ordered_site_dedup,
}

ORACLES = {
    "hit_extract_first_seen": f"""
WITH {STRUCTURE_HITS_SQL}
SELECT protid, min(pos) AS pos FROM model_hits WHERE evalue < 0.01 GROUP BY protid""",
    "hit_extract_cap": f"""
WITH {STRUCTURE_HITS_SQL}
SELECT protid, min(pos) AS pos FROM model_hits WHERE evalue < 0.01
GROUP BY protid ORDER BY pos, protid LIMIT 40""",
    "best_hit_per_id": f"""
WITH {STRUCTURE_HITS_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY protid
                               ORDER BY evalue, prob DESC, fident DESC) AS place
  FROM model_hits)
SELECT protid, prob AS "prob_v_K", evalue AS "evalue_v_K",
       round(fident * 0.01, 6) AS "fident_v_K"
FROM ranked WHERE place = 1""",
    "sequence_hit_accessions": """
SELECT 'NP_' || CAST(l_partkey AS VARCHAR) AS sacc, min(l_orderkey) AS first_order
FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""",
    "hit_union_distinct": """
SELECT o_custkey AS protid FROM orders
UNION SELECT user_id FROM events
UNION SELECT s_suppkey FROM supplier""",
    "hit_filter_nullsafe": f"""
WITH {PART_FEATURES_SQL}
SELECT protid, protein_names, annotation AS "Annotation" FROM part_features
WHERE protein_names IS DISTINCT FROM 'deleted' AND annotation IS NOT NULL
  AND fragment IS DISTINCT FROM 'fragment' AND len > 60 AND len < 400
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = protid AND l_quantity = 50)""",
    "source_of_hits": """
WITH found AS (
  SELECT user_id AS protid,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0
              THEN 'U1' ELSE 'U10' END AS key,
         CASE WHEN event_type IN ('click', 'view') THEN 'blast' ELSE 'foldseek' END AS method
  FROM events),
flags AS (
  SELECT p.protid,
    CAST(EXISTS (SELECT 1 FROM found f WHERE f.protid = p.protid AND key = 'U1' AND method = 'blast') AS INTEGER) AS "U1_blast",
    CAST(EXISTS (SELECT 1 FROM found f WHERE f.protid = p.protid AND key = 'U1' AND method = 'foldseek') AS INTEGER) AS "U1_foldseek",
    CAST(EXISTS (SELECT 1 FROM found f WHERE f.protid = p.protid AND key = 'U10' AND method = 'blast') AS INTEGER) AS "U10_blast",
    CAST(EXISTS (SELECT 1 FROM found f WHERE f.protid = p.protid AND key = 'U10' AND method = 'foldseek') AS INTEGER) AS "U10_foldseek"
  FROM (SELECT user_id AS protid FROM events UNION SELECT p_partkey FROM part) p),
sums AS (
  SELECT *, greatest("U1_blast", "U10_blast") AS blast,
            greatest("U1_foldseek", "U10_foldseek") AS foldseek FROM flags)
SELECT *, CASE WHEN blast = 1 AND foldseek = 1 THEN 2 ELSE 0 END AS both_methods,
       CASE WHEN blast = 1 AND foldseek = 1 THEN 'blast+foldseek'
            WHEN blast = 1 THEN 'blast' WHEN foldseek = 1 THEN 'foldseek'
            ELSE 'blast' END AS source_method,
       greatest("U1_blast", "U1_foldseek") AS "U1_hit",
       greatest("U10_blast", "U10_foldseek") AS "U10_hit"
FROM sums""",
    "resume_pending": """
SELECT c_custkey AS protid FROM customer
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""",
    "id_mapping": """
SELECT DISTINCT 'P' || json_extract_string(m.props, '$.k') AS protid
FROM events m
WHERE m.user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')""",
    "missing_key_ids": """
SELECT doc_id AS protid FROM documents EXCEPT SELECT doc_id FROM labels""",
    "ordered_site_dedup": """
SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS site, min(page_id) AS pos
FROM pages WHERE regexp_extract(url, '^https?://([^/]+)/', 1) <> '' GROUP BY 1""",
}
