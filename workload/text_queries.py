"""Annotations, words, taxa."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.functions.scaling import entry_count
from homologrid.functions.taxa import (
    EUKARYOTE_FOCUS,
    lineage_names,
    taxon_category,
    taxon_labels,
)
from homologrid.operators import annotations
from homologrid.operators.study import contingency
from workload.tables import LINEAGE_SQL, lineage_text, table

LANGUAGES = ["en", "fr", "de", "es"]


def annotation_topn(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn(
        "note", F.concat_ws(" / ", "p_name", "p_brand", "p_type")
    )
    counts = annotations.annotation_counts(part, "p_size", "note")
    return annotations.top_annotations(counts, n=10, width=20)


def annotation_totals(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn("note", F.nullif("p_type", F.lit("PROMO")))
    return annotations.annotation_totals(part, "p_brand", "note")


def annotation_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return annotations.annotation_counts(table(spark, folder, "documents"), "lang", "text")


def word_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    found = annotations.word_frequencies(
        table(spark, folder, "documents"), "lang", "text", ["the", "la", "of"]
    )
    return found.withColumn("frequency", F.round("frequency", 9))


def annotation_words(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn(
        "note", F.concat(F.lit("(protein) protein  "), "p_name", F.lit(" (red)"))
    )
    found = annotations.word_frequencies(part, "p_type", "note")
    return found.withColumn("frequency", F.round("frequency", 9))


def lineage_split(spark: SparkSession, folder: str) -> DataFrame:
    return lineage_text(spark, folder).select(
        "protid", F.array_join(lineage_names(F.col("lineage")), "|").alias("names")
    )


def assign_taxon(spark: SparkSession, folder: str) -> DataFrame:
    names = lineage_names(F.col("lineage"))
    return lineage_text(spark, folder).select(
        "protid",
        taxon_category(names, EUKARYOTE_FOCUS).alias("category"),
        taxon_labels(names, EUKARYOTE_FOCUS).alias("labels"),
    )


def taxon_contingency(spark: SparkSession, folder: str) -> DataFrame:
    found = contingency(table(spark, folder, "documents"), "source", "lang", LANGUAGES)
    return found.select(
        "run",
        "place",
        "category",
        "n",
        F.round("share", 8).alias("share"),
        F.round("cumulative_share", 8).alias("cumulative_share"),
    )


def multi_value_count(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").withColumn(
        "entries",
        F.when(F.col("lang") != "de", F.translate(F.col("text"), ".,", ";;")),
    )
    return documents.select("doc_id", entry_count(F.col("entries")).alias("n_entries"))


def turn_text(spark: SparkSession, folder: str) -> DataFrame:
    """Words per speaker over all conversations, parentheses removed."""
    found = annotations.word_frequencies(
        table(spark, folder, "conversations"), "role", "text", ["de"]
    )
    return found.select("cluster", "word", "n")


QUERIES = {
    "annotation_topn": annotation_topn,
    "annotation_totals": annotation_totals,
    "annotation_value_counts": annotation_value_counts,
    "word_frequencies": word_frequencies,
    "annotation_words": annotation_words,
    "speaker_words": turn_text,
    "lineage_split": lineage_split,
    "assign_taxon": assign_taxon,
    "taxon_contingency": taxon_contingency,
    "multi_value_count": multi_value_count,
}


def _words_sql(source: str, cluster: str, text: str, excluded: list[str]) -> str:
    listed = ", ".join(f"'{word}'" for word in excluded)
    return f"""
WITH words AS (
  SELECT {cluster} AS cluster, unnest(string_split({text}, ' ')) AS raw FROM {source}),
kept AS (
  SELECT cluster, replace(replace(raw, '(', ''), ')', '') AS word FROM words
  WHERE raw NOT IN ({listed})),
counts AS (SELECT cluster, word, count(*) AS n FROM kept GROUP BY 1, 2)
"""


_RANKED = ", ".join(f"'{name}'" for name in EUKARYOTE_FOCUS)

ORACLES = {
    "annotation_topn": """
WITH counts AS (
  SELECT p_size AS cluster, p_name || ' / ' || p_brand || ' / ' || p_type AS annotation,
         count(*) AS n FROM part GROUP BY 1, 2),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, annotation)
                 AS INTEGER) AS place FROM counts)
SELECT *, CASE WHEN length(annotation) > 20 THEN substr(annotation, 1, 20) || '...'
               ELSE annotation END AS label
FROM ranked WHERE place <= 10""",
    "annotation_totals": """
SELECT p_brand AS cluster, count(nullif(p_type, 'PROMO')) AS total FROM part GROUP BY 1""",
    "annotation_value_counts": """
SELECT lang AS cluster, text AS annotation, count(*) AS n FROM documents GROUP BY 1, 2""",
    "word_frequencies": _words_sql("documents", "lang", "text", ["the", "la", "of"])
    + """SELECT *, round(n / sum(n) OVER (PARTITION BY cluster), 9) AS frequency FROM counts""",
    "annotation_words": _words_sql(
        "part", "p_type", "'(protein) protein  ' || p_name || ' (red)'", ["protein", "None"]
    )
    + """SELECT *, round(n / sum(n) OVER (PARTITION BY cluster), 9) AS frequency FROM counts""",
    "speaker_words": _words_sql("conversations", "role", "text", ["de"])
    + "SELECT * FROM counts",
    "lineage_split": f"""
WITH {LINEAGE_SQL}
SELECT protid, array_to_string(list_transform(string_split(lineage, ', '),
         lambda x: split_part(x, ' (', 1)), '|') AS names
FROM lineage_text""",
    "assign_taxon": f"""
WITH {LINEAGE_SQL},
named AS (
  SELECT protid, list_transform(string_split(lineage, ', '),
         lambda x: split_part(x, ' (', 1)) AS names FROM lineage_text),
hits AS (
  SELECT protid, list_filter([{_RANKED}], lambda r: list_contains(names, r)) AS found
  FROM named)
SELECT protid, CASE WHEN len(found) = 0 THEN 'Other' ELSE found[1] END AS category,
       CASE WHEN len(found) = 0 THEN 'Other' ELSE array_to_string(found, ',') END AS labels
FROM hits""",
    "taxon_contingency": """
WITH ranked AS (
  SELECT unnest(['en', 'fr', 'de', 'es']) AS category, unnest([0, 1, 2, 3]) AS place),
runs AS (SELECT DISTINCT source AS run FROM documents),
cells AS (
  SELECT run, place, category,
         (SELECT count(*) FROM documents d WHERE d.source = run AND d.lang = category) AS n
  FROM runs CROSS JOIN ranked WHERE category IN (SELECT lang FROM documents))
SELECT run, place, category, n,
       round(n / sum(n) OVER (PARTITION BY run), 8) AS share,
       round(sum(n) OVER (PARTITION BY run ORDER BY place)
             / sum(n) OVER (PARTITION BY run), 8) AS cumulative_share
FROM cells""",
    "multi_value_count": """
SELECT doc_id, CAST(CASE WHEN lang = 'de' THEN 0 ELSE
  len(list_filter(string_split(replace(replace(text, '.', ';'), ',', ';'), ';'),
                  lambda x: x <> '')) END AS INTEGER) AS n_entries
FROM documents""",
}
