"""Command line: one command per table-to-table step.

    python -m homologrid <command> --help

Inputs and outputs are folders or files of the documented text formats.  On a
cluster start it with spark-submit; without a running session a local one is made.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homologrid.functions.taxa import lineage_names
from homologrid.functions.words import EXCLUDED_WORDS
from homologrid.operators import (
    annotations,
    clusters,
    features,
    hits,
    layout,
    presentation,
    provenance,
    quality,
    reduction,
    similarity,
    statistics,
)
from homologrid.operators.ordering import with_scalars
from homologrid.plans.clustering import communities_of_scores
from homologrid.plans.runs import Inputs, Run
from homologrid.plans.settings import InputError, Settings, is_on
from homologrid.sources import id_mapping, search_xml, structures, tabular, writers


def _scores(spark: SparkSession, path: str) -> DataFrame:
    """A matrix file (wide, with header) as a score table with few of its zeros.

    Those of the first row and the first column stay, so that no protein is lost whose
    scores are all 0.
    """
    cells = tabular.read_matrix(spark, path)
    first = cells.agg(F.min("query").alias("_query"), F.min("target").alias("_target"))
    kept = (F.col("score") != 0) | (F.col("query") == F.col("_query")) | (F.col("target") == F.col("_target"))
    return with_scalars(cells, first).where(kept).drop("_query", "_target")


def _features(spark: SparkSession, path: str, numbers: Sequence[str] = ()) -> DataFrame:
    return tabular.read_features(spark, path, numbers=numbers)


def aggregate_features(spark, args):
    tables = [_features(spark, path) for path in args.input]
    merged = features.assemble_features(tables)
    if args.features_override_file:
        merged = features.override_cells(merged, _features(spark, args.features_override_file))
    writers.write_table(merged, args.output)


def aggregate_fident(spark, args):
    found = tabular.read_structure_hits(spark, args.input)
    writers.write_table(hits.identity_features(found, args.protid), args.output)


def aggregate_hits(spark, args):
    writers.write_ids(
        hits.union_ids([tabular.read_ids(spark, path) for path in args.input]), args.output
    )


def assess_pdbs(spark, args):
    lines = structures.read_structure_lines(spark, args.input)
    writers.write_table(quality.assess_structures(lines), args.output)


def calculate_concordance(spark, args):
    scored = _features(spark, args.tmscore_file, [f"TMscore_v_{args.protid}"])
    names = [f"{kind}_v_{args.protid}" for kind in ("fident", "evalue")]
    found = features.concordance(
        scored,
        _features(spark, args.fident_file, names),
        args.protid,
        args.method,
        args.evalue_maximum,
        args.tmscore_minimum,
    )
    writers.write_table(found, args.output)


def key_scores(spark, args):
    table = similarity.check_scores(tabular.read_pair_scores(spark, args.input))
    mine = table.where(F.col("query").isin(args.keyids)).select(
        F.col("target").alias("query"), F.col("query").alias("target"), "score"
    )
    writers.write_table(similarity.wide_matrix(mine, args.keyids, "TMscore_v_"), args.output)


def pivot_scores(spark, args):
    table = similarity.check_scores(tabular.read_pair_scores(spark, args.input))
    # The columns of the file are its targets: a matrix file is only made for small sets.
    targets = [r["target"] for r in table.select("target").distinct().orderBy("target").collect()]
    writers.write_table(similarity.wide_matrix(table, targets), args.output)


def structure_clusters(spark, args):
    members = tabular.read_cluster_members(spark, args.input)
    writers.write_table(clusters.structure_clusters(members), args.output)


def dim_reduction(spark, args):
    reduced = layout.score_layout(_scores(spark, args.input), args.mode, args.random_state, args.rounds)
    prefix, first = "PC", 0
    if args.mode != "pca":
        prefix, first = ("tSNE" if args.mode.endswith("tsne") else "UMAP"), 1
    writers.write_table(reduction.coordinate_columns(reduced, prefix, 2, first), args.output)


def leiden_clustering(spark, args):
    found = communities_of_scores(
        _scores(spark, args.input),
        args.n_pcs,
        neighbours=args.n_neighbors,
        share=args.neighbor_share,
        prefix=args.cluster_abbrev,
        name=args.cluster_name,
    )
    writers.write_table(found, args.output)


def extract_sequence_hits(spark, args):
    columns = tabular.columns_of_format(args.format_string) if args.format_string else None
    if args.xml:
        found = search_xml.read_search_xml(spark, args.input)
        found = found.withColumn("pos", F.struct("evalue", "sacc"))
    else:
        found = tabular.read_sequence_hits(spark, args.input, columns, with_position=True)
    ids = hits.extract_sequence_hits(found, F.col("pos"))
    hits.require_hits(ids, is_on(args.allow_empty))
    writers.write_ids(ids.orderBy("pos"), args.output, "sacc")


def extract_structure_hits(spark, args):
    found = tabular.read_structure_hits(spark, args.input, with_position=True)
    ids = hits.extract_structure_hits(found, F.col("pos"), args.evalue, args.max_num_hits)
    writers.write_ids(ids.orderBy("pos"), args.output)


def filter_hits(spark, args):
    table = _features(spark, args.input)
    excluded = None
    if args.excluded_protids:
        excluded = spark.createDataFrame([(i,) for i in args.excluded_protids], "protid string")
    kept = hits.filter_candidates(table, args.min_length, args.max_length, excluded)
    writers.write_ids(kept, args.output)


def map_ids(spark, args):
    mapping = id_mapping.read_id_mapping(spark, args.mapping)
    writers.write_ids(hits.map_ids(tabular.read_ids(spark, args.input), mapping), args.output)


def rescue_mapping(spark, args):
    writers.write_ids(hits.union_ids([tabular.read_ids(spark, args.input)]), args.output)


def source_of_hits(spark, args):
    """Hit files are named ``<key>.<method>_hits...``."""
    found = tabular.read_ids(spark, args.hit_files, keep_file=True)
    name = F.split_part("source_file", F.lit("hits"), F.lit(1))
    cut = F.regexp_extract(name, r"^(.*)[._](blast|foldseek)[._]*$", 1)
    method = F.regexp_extract(name, r"^(.*)[._](blast|foldseek)[._]*$", 2)
    long = found.select("protid", cut.alias("key"), method.alias("method"))
    proteins = _features(spark, args.input).select("protid")
    sources = provenance.hit_sources(proteins, long, args.keyids)
    writers.write_table(provenance.contract_columns(sources, args.keyids), args.output)


def cluster_similarity(spark, args):
    groups = _features(spark, args.features_file).select(
        "protid", F.col(f"`{args.features_column}`").alias("cluster")
    )
    blocks = similarity.block_similarity_of_scores(
        _scores(spark, args.matrix_file), groups.where(F.col("cluster").isNotNull())
    )
    writers.write_table(blocks, args.output)


def cluster_distributions(spark, args):
    table = _features(spark, args.input, args.columns)
    keys = [args.keyid] if args.keyid else None
    writers.write_table(
        statistics.column_markers(table, args.cluster_column, args.columns, keys), args.output
    )


def semantic_analysis(spark, args):
    table = _features(spark, args.features_file).select(
        F.col(f"`{args.agg_column}`").alias("cluster"), F.col(f"`{args.annot_column}`").alias("note")
    )
    counts = annotations.annotation_counts(table, "cluster", "note")
    writers.write_table(annotations.top_annotations(counts), f"{args.output}/annotations")
    words = annotations.word_frequencies(table, "cluster", "note", args.exclude_words)
    writers.write_table(words, f"{args.output}/words")
    totals = annotations.annotation_totals(table, "cluster", "note")
    writers.write_table(totals, f"{args.output}/totals")


def apply_coordinates(spark, args):
    joined = features.attach_coordinates(
        _features(spark, args.dimensions), _features(spark, args.features)
    )
    writers.write_table(joined, args.output)


def plot_points(spark, args):
    """Plot-ready points from coordinates and features."""
    rules = presentation.plotting_rules(args.taxon_focus, args.keyids or ())
    coordinates = _features(spark, args.dimensions)
    x, y = [c for c in coordinates.columns if c != "protid"][:2]
    coordinates = coordinates.select(
        "protid", F.col(f"`{x}`").cast("double").alias("_x"), F.col(f"`{y}`").cast("double").alias("_y")
    )
    table = features.attach_coordinates(coordinates, _features(spark, args.features, args.numbers))
    if "Lineage" not in table.columns and "Taxonomic lineage" in table.columns:
        table = table.withColumn("Lineage", lineage_names(F.col("`Taxonomic lineage`")))
    writers.write_table(
        presentation.plot_points(presentation.prepared(table, rules), rules, "_x", "_y"), args.output
    )


def _named_files(pairs: Sequence[str]) -> dict[str, str]:
    """``key=path`` arguments by key."""
    named = dict(pair.split("=", 1) for pair in pairs)
    if len(named) < len(pairs):
        raise InputError("a key protein is named twice")
    return named


def run(spark, args):
    """One configured run, in either mode, with all its results as Parquet folders."""
    changes = json.loads(spark.read.text(args.config, wholetext=True).first()["value"])
    inputs = Inputs(
        tabular.read_pair_scores(spark, args.scores),
        _features(spark, args.metadata, ("Annotation", "Length")),
        structures.read_structure_lines(spark, args.structures) if args.structures else None,
        {
            key: tabular.read_structure_hits(spark, path, with_position=True)
            for key, path in _named_files(args.structure_hits).items()
        },
        {
            key: tabular.read_sequence_hits(spark, path, with_position=True)
            for key, path in _named_files(args.sequence_hits).items()
        },
        id_mapping.read_id_mapping(spark, args.id_mapping) if args.id_mapping else None,
        cluster_members=tabular.read_cluster_members(spark, args.cluster_members)
        if args.cluster_members
        else None,
        override=_features(spark, args.features_override_file) if args.features_override_file else None,
    )
    results = Run(spark, inputs, Settings().overlaid(changes), f"{args.folder}/stages").all()
    for name, table in results.items():
        table.write.mode("overwrite").parquet(f"{args.folder}/{name}")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="homologrid", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name, run, *needed, many=()):
        sub = commands.add_parser(name)
        for option in needed:
            sub.add_argument(f"--{option}", required=True)
        for option in many:
            sub.add_argument(f"--{option}", required=True, nargs="+")
        sub.set_defaults(run=run)
        return sub

    sub = command("aggregate-features", aggregate_features, "output", many=["input"])
    sub.add_argument("--features-override-file")
    command("aggregate-fident", aggregate_fident, "output", "protid", many=["input"])
    command("aggregate-hits", aggregate_hits, "output", many=["input"])
    command("assess-structures", assess_pdbs, "input", "output")
    sub = command(
        "concordance", calculate_concordance, "tmscore-file", "fident-file", "protid", "output"
    )
    sub.add_argument("--method", default="linear")
    sub.add_argument("--evalue-maximum", type=float, default=features.CONCORDANCE_EVALUE)
    sub.add_argument("--tmscore-minimum", type=float, default=features.CONCORDANCE_MIN_SCORE)
    command("key-scores", key_scores, "input", "output", many=["keyids"])
    command("pivot-scores", pivot_scores, "input", "output")
    command("structure-clusters", structure_clusters, "input", "output")
    sub = command("reduce", dim_reduction, "input", "output")
    sub.add_argument("--mode", default="pca", choices=layout.MODES)
    sub.add_argument("--random-state", type=int, default=reduction.SEED)
    sub.add_argument("--rounds", type=int, help="rounds of a layout, where not the usual number")
    sub = command("communities", leiden_clustering, "input", "output")
    sub.add_argument("--n-neighbors", type=int, default=10)
    sub.add_argument("--neighbor-share", type=float, default=0.0, help="of all rows, where more")
    sub.add_argument("--n-pcs", type=int, default=reduction.PRESTEP_COMPONENTS)
    sub.add_argument("--cluster-name", default=clusters.COMMUNITY_COLUMN)
    sub.add_argument("--cluster-abbrev", default=clusters.COMMUNITY_PREFIX)
    sub = command("extract-sequence-hits", extract_sequence_hits, "input", "output")
    sub.add_argument("--format-string")
    sub.add_argument("--xml", action="store_true")
    sub.add_argument("--allow-empty")
    sub = command("extract-structure-hits", extract_structure_hits, "output", many=["input"])
    sub.add_argument("--evalue", type=float, default=hits.HIT_EVALUE)
    sub.add_argument("--max-num-hits", type=int)
    sub = command("filter-hits", filter_hits, "input", "output")
    sub.add_argument("--min-length", type=int, default=0)
    sub.add_argument("--max-length", type=int, default=0)
    sub.add_argument("--excluded-protids", nargs="*")
    command("map-ids", map_ids, "input", "mapping", "output")
    command("rescue-mapping", rescue_mapping, "input", "output")
    command("source-of-hits", source_of_hits, "input", "output", many=["hit-files", "keyids"])
    command(
        "cluster-similarity",
        cluster_similarity,
        "matrix-file",
        "features-file",
        "features-column",
        "output",
    )
    sub = command("cluster-distributions", cluster_distributions, "input", "output", many=["columns"])
    sub.add_argument("--cluster-column", default=clusters.COMMUNITY_COLUMN)
    sub.add_argument("--keyid")
    sub = command(
        "semantic-analysis", semantic_analysis, "features-file", "agg-column", "annot-column", "output"
    )
    sub.add_argument("--exclude-words", nargs="+", default=EXCLUDED_WORDS)
    command("apply-coordinates", apply_coordinates, "dimensions", "features", "output")
    sub = command("plot-points", plot_points, "dimensions", "features", "output")
    sub.add_argument("--keyids", nargs="*")
    sub.add_argument("--taxon-focus", default="euk")
    sub.add_argument("--numbers", nargs="*", default=("Annotation", "Length", "pdb_confidence"))
    sub = command("run", run, "config", "folder", "metadata", many=["scores"])
    sub.add_argument("--structures", nargs="*")
    sub.add_argument("--structure-hits", nargs="*", default=(), metavar="KEY=PATH")
    sub.add_argument("--sequence-hits", nargs="*", default=(), metavar="KEY=PATH")
    sub.add_argument("--id-mapping")
    sub.add_argument("--cluster-members")
    sub.add_argument("--features-override-file")
    return parser


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = build_parser().parse_args(argv)
    if spark is None:
        from homologrid.session import local_session

        spark = SparkSession.getActiveSession() or local_session()
    args.run(spark, args)


if __name__ == "__main__":
    main()
