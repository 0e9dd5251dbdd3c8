"""The two runs: search mode (hits to map) and cluster mode (structures to map).

Everything between the inputs and the stage tables is one lazy plan per stage.
Stages are written where several later steps read them; a rerun into the same
folder continues after the last complete stage.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.functions.taxa import lineage_names
from homologrid.operators import (
    annotations,
    features,
    hits,
    layout,
    provenance,
    quality,
    similarity,
    statistics,
)
from homologrid.operators.clusters import structure_clusters
from homologrid.operators.layout import score_layout
from homologrid.operators.presentation import plot_points, plotting_rules, prepared
from homologrid.operators.reduction import score_components
from homologrid.plans.clustering import communities_of_coordinates, covered_clusters
from homologrid.plans.settings import InputError, Mode, Settings, check_cluster_inputs
from homologrid.staging import ResumableStages


@dataclass
class Inputs:
    """Tables obtained elsewhere.  ``*_hits`` map a key protein to its hit table."""

    scores: DataFrame
    metadata: DataFrame
    structure_lines: DataFrame | None = None
    structure_hits: Mapping[str, DataFrame] = field(default_factory=dict)
    sequence_hits: Mapping[str, DataFrame] = field(default_factory=dict)
    id_mapping: DataFrame | None = None
    key_scores: DataFrame | None = None
    cluster_members: DataFrame | None = None
    override: DataFrame | None = None


def _hit_order(df: DataFrame):
    """First-seen order: the row number column when given, else content order."""
    return F.col("pos") if "pos" in df.columns else F.col("evalue")


def collected_hits(inputs: Inputs, settings: Settings) -> DataFrame:
    """All hits, long: ``protid, key, method``.  One small plan per key protein."""
    tables = []
    for key, table in inputs.structure_hits.items():
        found = hits.extract_structure_hits(
            table, _hit_order(table), settings.hit_evalue, settings.max_structure_hits
        )
        tables.append(
            found.select("protid", F.lit(key).alias("key"), F.lit(provenance.STRUCTURE_METHOD).alias("method"))
        )
    for key, table in inputs.sequence_hits.items():
        found = hits.capped(
            hits.extract_sequence_hits(table, _hit_order(table)),
            settings.max_sequence_hits,
            ["pos", "sacc"],
        )
        found = hits.require_hits(found, settings.allow_empty_search)
        ids = found.select(F.col("sacc").alias("protid"))
        if inputs.id_mapping is not None:
            ids = hits.map_ids(ids, inputs.id_mapping)
        tables.append(
            ids.select("protid", F.lit(key).alias("key"), F.lit(provenance.SEQUENCE_METHOD).alias("method"))
        )
    if not tables:
        raise InputError("a search run needs hit tables")
    return reduce(DataFrame.unionAll, tables)


def chosen_proteins(found: DataFrame, metadata: DataFrame, settings: Settings) -> DataFrame:
    """Hits that pass the metadata filter, up to the structure cap, and the key proteins.

    The cap is a setting of the analysis; it is applied in a fixed order (hit by
    most searches first, then by id).
    """
    support = found.groupBy("protid").agg(F.count(F.lit(1)).alias("support"))
    kept = hits.filter_candidates(
        metadata.join(support, "protid"), settings.min_length, settings.max_length
    ).where(~F.col("protid").isin(list(settings.excluded_proteins)))
    chosen = hits.capped(kept, settings.max_structures or None, [F.desc("support"), "protid"])
    keys = found.where(F.col("key").isin(list(settings.key_proteins)))
    return hits.union_ids([chosen, keys.select(F.col("key").alias("protid"))])


class Run:
    """One analysis: stages by name, computed when missing, read when present."""

    def __init__(self, spark: SparkSession, inputs: Inputs, settings: Settings, folder: str):
        self.spark = spark
        self.inputs = inputs
        self.settings = settings.checked()
        self.stages = ResumableStages(spark, folder)
        if self.settings.mode is Mode.CLUSTER:
            self._check_structures()

    def _stage(self, name: str, build, *given: object) -> DataFrame:
        """A stage of these settings and arguments; others have stages of their own."""
        return self.stages.run(name, build, self.settings, *given)

    def _check_structures(self) -> None:
        known = self.inputs.scores.select(F.col("query").alias("protid")).distinct()
        keys = list(self.settings.key_proteins)
        present = {
            row["protid"] for row in known.where(F.col("protid").isin(keys)).collect()
        }
        check_cluster_inputs(known.count(), [key for key in keys if key not in present])

    def hits(self) -> DataFrame:
        return self._stage("hits", lambda: collected_hits(self.inputs, self.settings))

    def proteins(self) -> DataFrame:
        """The proteins of the map."""

        def build() -> DataFrame:
            if self.settings.mode is Mode.CLUSTER:
                return self.inputs.scores.select(F.col("query").alias("protid")).distinct()
            return chosen_proteins(self.hits(), self.inputs.metadata, self.settings)

        return self._stage("proteins", build)

    def scores(self) -> DataFrame:
        """Scores between proteins of the map, conflicts refused."""

        def build() -> DataFrame:
            table = self.inputs.scores
            column = "score_text" if "score_text" in table.columns else "score"
            checked = similarity.check_scores(table, column)
            ids = self.proteins()
            return checked.join(
                ids.select(F.col("protid").alias("query")), "query", "left_semi"
            ).join(ids.select(F.col("protid").alias("target")), "target", "left_semi")

        return self._stage("scores", build)

    def components(self) -> DataFrame:
        return self._stage(
            "components", lambda: score_components(self.scores(), self.settings.components)
        )

    def communities(self) -> DataFrame:
        return self._stage(
            "communities",
            lambda: communities_of_coordinates(
                self.components(), self.settings.neighbours, self.settings.neighbour_share
            ),
        )

    def structure_clusters(self) -> DataFrame:
        given = self.inputs.cluster_members
        return self._stage(
            "structure_clusters",
            lambda: covered_clusters(self.scores()) if given is None else structure_clusters(given),
        )

    def key_scores(self) -> DataFrame:
        """One column per key protein; missing pairs score 0."""
        keys = list(self.settings.key_proteins)
        table = self.inputs.key_scores if self.inputs.key_scores is not None else self.scores()
        base = self.proteins()
        long = table.where(F.col("query").isin(keys)).select(
            F.col("target").alias("protid"), F.col("query").alias("key"), "score"
        )
        wide = long.groupBy("protid").pivot("key", keys).agg(F.max("score"))
        return base.join(wide, "protid", "left").select(
            "protid",
            *[F.coalesce(F.col(f"`{key}`"), F.lit(0.0)).alias(f"TMscore_v_{key}") for key in keys],
        )

    def features(self) -> DataFrame:
        """All features of all proteins of the map, overrides applied."""

        def build() -> DataFrame:
            keys = list(self.settings.key_proteins)
            tables = [self.inputs.metadata, self.communities(), self.structure_clusters()]
            if self.inputs.structure_lines is not None:
                tables.append(quality.assess_structures(self.inputs.structure_lines))
            if keys:
                scores = self.key_scores()
                tables.append(scores)
                for key in keys:
                    table = self.inputs.structure_hits.get(key)
                    if table is None:
                        continue
                    identity = hits.identity_features(table, key)
                    tables.append(identity)
                    tables.append(
                        features.concordance(
                            scores,
                            identity,
                            key,
                            max_evalue=self.settings.concordance_evalue,
                            min_score=self.settings.concordance_min_score,
                        )
                    )
            if self.settings.mode is Mode.SEARCH:
                sources = provenance.hit_sources(self.proteins(), self.hits(), keys)
                tables.append(provenance.contract_columns(sources, keys))
            merged = features.assemble_features(tables)
            if self.inputs.override is not None:
                merged = features.override_cells(merged, self.inputs.override)
            return merged

        return self._stage("features", build)

    def mapped_features(self) -> DataFrame:
        """Features of the proteins that are on the map."""
        return self.features().join(self.proteins(), "protid", "left_semi")

    def layout(self, mode: str) -> DataFrame:
        def build() -> DataFrame:
            if mode == "pca":
                return self.components().select("protid", F.slice("coords", 1, 2).alias("coords"))
            return score_layout(
                self.scores(),
                mode,
                self.settings.seed,
                self.settings.layout_rounds,
                self.components() if mode.startswith("pca_") else None,
            )

        return self._stage(f"layout_{mode}", build)

    def block_similarity(self, column: str) -> DataFrame:
        groups = self.mapped_features().where(F.col(column).isNotNull()).select(
            "protid", F.col(column).alias("cluster")
        )
        return self._stage(
            f"blocks_{column}",
            lambda: similarity.block_similarity_of_scores(self.scores(), groups),
        )

    def markers(
        self, columns: tuple[str, ...] = ("pdb_confidence", "Annotation", "Length")
    ) -> DataFrame:
        """Markers of every cluster against the cluster of each key protein, one table per key.

        Without key proteins every cluster is compared with the rest; ``key`` is null then.
        """

        def against(key: str | None) -> DataFrame:
            scored = [f"{kind}_v_{key}" for kind in ("TMscore", "fident")] if key else []
            found = statistics.column_markers(
                self.mapped_features(), "LeidenCluster", [*columns, *scored], [key] if key else None
            )
            return found.withColumn("key", F.lit(key).cast("string"))

        def build() -> DataFrame:
            keys = list(self.settings.key_proteins) or [None]
            return reduce(DataFrame.unionByName, [against(key) for key in keys])

        return self._stage("markers", build, columns)

    def _notes(self, column: str) -> DataFrame:
        return self.mapped_features().select("LeidenCluster", F.col(f"`{column}`").alias("note"))

    def annotation_table(self, column: str = "Protein names") -> DataFrame:
        return self._stage(
            "annotations",
            lambda: annotations.top_annotations(
                annotations.annotation_counts(self._notes(column), "LeidenCluster", "note")
            ),
            column,
        )

    def word_table(self, column: str = "Protein names") -> DataFrame:
        return self._stage(
            "words",
            lambda: annotations.word_frequencies(self._notes(column), "LeidenCluster", "note"),
            column,
        )

    def plot_table(self, mode: str) -> DataFrame:
        """Plot-ready points of one layout."""

        def build() -> DataFrame:
            rules = plotting_rules(self.settings.taxon_focus, self.settings.key_proteins)
            coordinates = self.layout(mode).select(
                "protid",
                F.get("coords", F.lit(0)).alias("_x"),
                F.get("coords", F.lit(1)).alias("_y"),
            )
            table = features.attach_coordinates(coordinates, self.features())
            if "Lineage" not in table.columns and "Taxonomic lineage" in table.columns:
                table = table.withColumn("Lineage", lineage_names(F.col("`Taxonomic lineage`")))
            return plot_points(prepared(table, rules), rules, "_x", "_y")

        return self._stage(f"plot_{mode}", build)

    def all(self) -> dict[str, DataFrame]:
        """Every result of the run."""
        results = {
            "features": self.features(),
            "blocks_leiden": self.block_similarity("LeidenCluster"),
            "blocks_structure": self.block_similarity("StruCluster"),
            "markers": self.markers(),
            "annotations": self.annotation_table(),
            "words": self.word_table(),
        }
        for mode in self.settings.plotting_modes:
            results[f"plot_{mode}"] = self.plot_table(mode)
        return results
