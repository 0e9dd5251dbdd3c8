"""Hits, provenance, features, clusters, text, taxa, study and plot tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from homologrid.functions import identifiers, scaling, taxa, words
from homologrid.operators import (
    annotations,
    clusters,
    features,
    hits,
    ordering,
    presentation,
    provenance,
    similarity,
    study,
)
from tests.conftest import as_dict


def test_missing_cells_are_not_fragments(spark):
    rows = [
        ("a", "name", 5.0, None, "100.0"),
        ("b", "name", 5.0, "fragment", "100.0"),
        ("c", "deleted", 5.0, None, "100.0"),
        ("d", None, 5.0, None, "100.0"),
        ("e", "name", None, None, "100.0"),
        ("f", "name", 5.0, None, "50.0"),
        ("g", "name", 5.0, None, "200.0"),
    ]
    table = spark.createDataFrame(
        rows, "protid string, `Protein names` string, Annotation double, Fragment string, Length string"
    )
    ids = lambda df: {r["protid"] for r in df.collect()}
    assert ids(hits.filter_candidates(table)) == {"a", "d", "f", "g"}
    assert ids(hits.filter_candidates(table, 50, 200)) == {"a", "d"}
    assert ids(hits.filter_candidates(table, 50, 0)) == {"a", "d", "g"}
    excluded = table.where("protid = 'a'")
    assert ids(hits.filter_candidates(table, 50, 200, excluded)) == {"d"}
    assert ids(hits.filter_candidates(table, 200, 200)) == set()
    with pytest.raises(ValueError):
        hits.filter_candidates(table, 5, 2)


def test_sources_and_prefix_keys(spark):
    proteins = spark.createDataFrame([("x",), ("y",), ("z",), ("n",)], "protid string")
    found = spark.createDataFrame(
        [("x", "P1", "blast"), ("x", "P1", "foldseek"), ("y", "P10", "foldseek"), ("z", "P10", "blast")],
        "protid string, key string, method string",
    )
    rows = {r["protid"]: r for r in provenance.hit_sources(proteins, found, ["P1", "P10"]).collect()}
    assert [rows[p]["source_method"] for p in "xyzn"] == [
        "blast+foldseek",
        "foldseek",
        "blast",
        "blast",
    ]
    # P1 is a prefix of P10 and must not pick up its hits.
    assert [rows[p]["P1_hit"] for p in "xyzn"] == [1, 0, 0, 0]
    assert [rows[p]["P10_hit"] for p in "xyzn"] == [0, 1, 1, 0]
    table = provenance.hit_sources(proteins, found, ["P1"], no_hit_label="None")
    assert as_dict(table, "protid", "source_method")["n"] == "None"
    names = provenance.contract_columns(table, ["P1"]).columns
    assert {"source.method", "P1.hit", "blast+foldseek", "P1.blast_"} <= set(names)


def test_override_rules(spark):
    base = spark.createDataFrame(
        [("a", "x", 1), ("b", "y", 2), ("c", "z", 3)], "protid string, name string, n int"
    )
    override = spark.createDataFrame(
        [("a", None, 9, "q"), ("b", "new", 8, "q"), ("b", "newer", 7, "q"), ("k", "added", None, "q")],
        "protid string, name string, n int, other string",
    )
    rows = {r["protid"]: tuple(r)[1:] for r in features.override_cells(base, override).collect()}
    assert rows == {"a": (None, 9), "b": ("new", 8), "c": ("z", 3), "k": ("added", None)}


def test_assembly_plans_agree_and_clashes_are_named(spark):
    a = spark.createDataFrame([("1", 10), ("2", 20)], "protid string, a int")
    b = spark.createDataFrame([("2", "x"), ("3", None)], "protid string, b string")
    c = spark.createDataFrame([("1", 0.5), (None, 0.7)], "protid string, c double")
    folded = features.assemble_features([a, b, c]).select("protid", "a", "b", "c")
    joined = features.assemble_features([a, b, c], unique=False).select("protid", "a", "b", "c")
    assert sorted(folded.collect(), key=str) == sorted(joined.collect(), key=str)
    assert folded.count() == 3
    twice = features.assemble_features([a.unionAll(a.withColumn("a", F.lit(5))), b])
    assert twice.count() == 5
    with pytest.raises(features.ColumnClash, match="'a'"):
        features.assemble_features([a, a])


def test_concordance_is_strict(spark):
    scores = spark.createDataFrame(
        [("a", 0.8), ("b", 0.0), ("c", 0.9)], "protid string, TMscore_v_K double"
    )
    identity = spark.createDataFrame(
        [("a", 1e-9, 0.3), ("b", 1e-9, 0.3), ("c", 0.001, 0.3)],
        "protid string, evalue_v_K double, fident_v_K double",
    )
    found = features.concordance(scores, identity, "K").collect()
    assert [(r["protid"], round(r["concordance_v_K"], 6)) for r in found] == [("a", 0.5)]
    with pytest.raises(ValueError, match="unknown method"):
        features.concordance(scores, identity, "K", method="other")


def test_block_orientation_and_zero_fill(spark):
    matrix = {"A": [1, 0.4, 0.7], "B": [0.2, 1, 0.8], "C": [0.3, 0.6, 1]}
    rows = [(q, t, float(s)) for q, line in matrix.items() for t, s in zip("ABC", line)]
    scores = spark.createDataFrame(rows, "query string, target string, score double")
    groups = spark.createDataFrame(
        [("A", "c0"), ("B", "c0"), ("C", "c1"), ("unused", "c1")], "protid string, cluster string"
    )
    blocks = similarity.block_similarity_of_scores(scores, groups)
    found = {(r[0], r[1]): round(r[2], 6) for r in blocks.collect()}
    assert found == {("c0", "c0"): 0.65, ("c0", "c1"): 0.45, ("c1", "c0"): 0.75, ("c1", "c1"): 1.0}
    sparse = similarity.block_similarity_of_scores(scores.where("score <> 0.4"), groups)
    assert round(as_dict(sparse.where("query_cluster = 'c0'"), "target_cluster", "similarity")["c0"], 6) == 0.55
    compact = similarity.compactness(blocks, "r").first()
    assert (round(compact["mean_similarity"], 6), compact["n_clusters"]) == (0.825, 2)


def test_vector_blocks_equal_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 5))
    labels = rng.integers(0, 3, size=40)
    table = spark.createDataFrame(
        [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, labels))],
        "protid int, vector array<double>, label int",
    )
    pairs = vectors @ vectors.T
    for row in similarity.block_similarity(table, "label").collect():
        block = pairs[np.ix_(labels == row[0], labels == row[1])]
        assert row[2] == pytest.approx(block.mean())
    for row in similarity.similarity_profile(table).collect():
        assert row["mean_similarity"] == pytest.approx(pairs[row["protid"]].mean())
        assert row["mean_square"] == pytest.approx((pairs[row["protid"]] ** 2).mean())
    keys = similarity.key_similarities(table, [0, 3])
    assert as_dict(keys, "protid", "TMscore_v_3")[7] == pytest.approx(pairs[3, 7])
    with pytest.raises(ValueError, match="unknown keys"):
        similarity.key_similarities(table, [99])


@pytest.mark.parametrize("count, label", [(1, "SC0"), (10, "SC0"), (11, "SC00")])
def test_label_padding(spark, count, label):
    members = spark.createDataFrame(
        [(f"r{i:02d}.pdb", f"m{i:02d}.pdb") for i in range(count)], "ClusterRep string, protid string"
    )
    found = as_dict(clusters.structure_clusters(members), "protid", "StruCluster")
    assert found["m00"] == label and len(found) == count
    assert len(set(found.values())) == count


def test_suffix_is_a_suffix(spark):
    row = spark.createDataFrame([("Xpdb.pdb", "a.pdb.pdbx")], "a string, b string").select(
        identifiers.without_suffix(F.col("a")), identifiers.without_all(F.col("b"))
    )
    assert tuple(row.first()) == ("Xpdb", "ax")


def test_word_rules(spark):
    table = spark.createDataFrame(
        [("c", "a b  c"), ("c", "(protein) protein"), ("c", None)], "k string, t string"
    )
    found = as_dict(annotations.word_frequencies(table, "k", "t"), "word", "n")
    assert found == {"a": 1, "b": 1, "": 1, "c": 1, "protein": 1}
    assert annotations.annotation_totals(table, "k", "t").first()["total"] == 2
    label = table.select(words.wrapped(F.lit("word " * 12), 30, "<br>")).first()[0]
    assert label == "word word word word word word<br>word word word word word word"


def test_taxa(spark):
    names = taxa.lineage_names(F.lit("Eukaryota (superkingdom), Metazoa (kingdom), Sarcopterygii"))
    row = spark.range(1).select(
        names.alias("n"),
        taxa.taxon_category(names, taxa.EUKARYOTE_FOCUS),
        taxa.taxon_labels(names, taxa.EUKARYOTE_FOCUS),
        taxa.taxon_category(F.array(F.lit("x")), taxa.BACTERIA_FOCUS),
    ).first()
    assert row[0] == ["Eukaryota", "Metazoa", "Sarcopterygii"]
    assert tuple(row)[1:] == ("Metazoa", "Metazoa,Eukaryota", "Other")


def test_confidence_bands(spark):
    values = [0.0, 0.1, 50.0, 50.1, 70.0, 90.0, 90.1, 100.0, 100.5]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    bands = [r[0] for r in table.select(scaling.confidence_band(F.col("v"))).collect()]
    assert bands == [
        "very_high",
        "very_low",
        "very_low",
        "low",
        "low",
        "confident",
        "very_high",
        "very_high",
        None,
    ]


def test_quantile_bins_equal_pandas(spark):
    eleven = spark.createDataFrame([(i,) for i in range(1, 12)], "v int")
    rows = study.quantile_bins(eleven, ["v"]).orderBy("v").collect()
    assert [r["v_bin"] for r in rows] == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    values = np.random.default_rng(5).normal(size=777)
    want = pd.qcut(pd.Series(values), 10, labels=range(1, 11)).astype(int)
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = as_dict(study.quantile_bins(table, ["v"]), "i", "v_bin")
    assert [got[i] for i in range(777)] == list(want)


def test_weighted_sample(spark):
    table = spark.range(2000).select(
        F.col("id").alias("protid"), F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("w")
    )
    first = {r["protid"] for r in study.weighted_sample(table, 200, "w").collect()}
    again = {r["protid"] for r in study.weighted_sample(table.repartition(7), 200, "w").collect()}
    assert first == again and len(first) == 200
    assert sum(i < 1000 for i in first) > 150


def test_histograms(spark):
    table = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 19.9, 20]], "v double")
    found = as_dict(study.equal_width_histogram(table, "v", 20), "bin", "n")
    assert found == {0: 1, 1: 1, 2: 1, 19: 2}
    edges = spark.createDataFrame([(40.0,), (41.9,), (42.0,), (100.0,), (30.0,)], "v double")
    found = as_dict(study.fixed_edge_histogram(edges, "v", 40, 100, 2), "bin", "n")
    assert found == {0: 2, 1: 1, 29: 1}


def test_entry_counts_and_study(spark):
    table = spark.createDataFrame([("PF1;PF2;",), (None,), ("",)], "p string")
    assert [r[0] for r in table.select(scaling.entry_count(F.col("p"))).collect()] == [2, 0, 0]


def test_running_totals_with_many_ranges(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=500), np.full(400, 0.25)])
    groups = rng.integers(0, 3, size=900)
    table = spark.createDataFrame(
        [(int(g), float(v)) for g, v in zip(groups, values)], "g int, v double"
    )
    counts = ordering.value_counts(table, "v", ["g"])
    totals = ordering.running_totals(counts, "v", ["n"], ["g"], ordering.range_bounds(table, "v", 40))
    for row in totals.collect():
        assert row["n_before"] == ((groups == row["g"]) & (values < row["v"])).sum()
    quantiles = ordering.exact_quantiles(table, "v", {"q": 0.3, "m": 0.5}, ["g"])
    for row in quantiles.collect():
        mine = values[groups == row["g"]]
        assert row["q"] == pytest.approx(np.quantile(mine, 0.3))
        assert row["m"] == pytest.approx(np.median(mine))


def test_plot_rules(spark):
    rules = presentation.plotting_rules("bac", ["K"])
    assert len(rules) == 14 and rules[0].column == "Protein names"
    with pytest.raises(ValueError):
        presentation.plotting_rules("plants")
    table = spark.createDataFrame(
        [("a", None, 3.0, ["Bacteria"], None, 1), ("b", "n" * 5 + " " + "m" * 40, None, None, 0.123456, 0)],
        "protid string, `Protein names` string, Annotation double, Lineage array<string>,"
        " TMscore_v_K double, `K.hit` int",
    )
    ready = {r["protid"]: r for r in presentation.prepared(table, rules).collect()}
    assert ready["a"]["Annotation"] == "3" and ready["b"]["Annotation"] == "0"
    assert ready["a"]["TMscore_v_K"] == -0.01 and ready["b"]["TMscore_v_K"] == 0.1235
    assert ready["b"]["Protein names"] == "nnnnn</br>" + "m" * 40
    assert ready["a"]["K.hit"] is True and ready["b"]["K.hit"] is False
    placed = presentation.with_taxon(presentation.prepared(table, rules), rules)
    assert as_dict(placed, "protid", "Lineage_taxonomic") == {"a": "Bacteria", "b": "Other"}
    text = presentation.hover_template(table.columns, rules)
    assert text.startswith("<b>%{customdata[0]}</b>") and "Broad taxon" not in text
    limits = {r["feature"]: r for r in presentation.color_limits(presentation.prepared(table, rules), rules).collect()}
    share = 0.01 / 1.01
    assert limits["TMscore_v_K"]["low"] == -0.01
    assert limits["TMscore_v_K"]["missing_until"] == pytest.approx(share / (1 + share))


def test_fixed_colours(spark):
    table = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    found = presentation.category_colours(table, "c", fixed={"a": "#111111", "b": "#222222"})
    assert as_dict(found, "category", "colour") == {"a": "#111111", "b": "#222222"}
    with pytest.raises(ValueError, match="'b'"):
        presentation.category_colours(table, "c", fixed={"a": "#111111"})


@pytest.mark.parametrize("block_rows", [1, 4, 100])
def test_means_meet_block_by_block(spark, block_rows):
    """Every ordered pair once, whatever the blocks; equal to the product of all means."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(11, 5))
    means = spark.createDataFrame(
        [(f"c{i:02d}", v.tolist()) for i, v in enumerate(vectors)], "cluster string, mean array<double>"
    )
    found = similarity.products_by_block(means, 11, 5, block_rows).collect()
    got = {(r["target_cluster"], r["query_cluster"]): r["similarity"] for r in found}
    assert len(found) == len(got) == 121
    for (a, b), value in got.items():
        assert value == pytest.approx(vectors[int(a[1:])] @ vectors[int(b[1:])])


def test_many_means_take_the_blocks(spark, monkeypatch):
    """Beyond the bytes that may be shipped the result is the same; repeated and single rows included."""
    rows = [(i, i % 7, [float(i), 1.0, float(i % 3)]) for i in range(40)] + [(40, None, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "id int, cluster int, vector array<double>")
    want = sorted(map(tuple, similarity.block_similarity(vectors, "cluster").collect()))
    used = []
    by_block = similarity.products_by_block
    monkeypatch.setattr(similarity, "products_by_block", lambda *given: used.append(1) or by_block(*given))
    monkeypatch.setattr(similarity, "MAX_SHIPPED_BYTES", 100)
    got = sorted(map(tuple, similarity.block_similarity(vectors, "cluster").collect()))
    assert used and len(got) == 49
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])
