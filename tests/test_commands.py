"""The command line on small files."""

from __future__ import annotations

import pytest

from homologrid.__main__ import _scores, main
from homologrid.operators import layout
from tests.test_sources import structure_row


def table(spark, path):
    return spark.read.csv(str(path), sep="\t", header=True).collect()


def lines(spark, path):
    return {r[0] for r in spark.read.text(str(path)).collect()}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "K.foldseek_hits.txt").write_text("A\nB\n")
    (tmp_path / "K.blast_hits.txt").write_text("B\nC\n")
    (tmp_path / "hits.m8").write_text(
        "\n".join(structure_row(f"AF-{n}-F1-model_v4 x", 1e-9, fident=50.0) for n in "AB") + "\n"
    )
    (tmp_path / "features.tsv").write_text(
        "protid\tProtein names\tAnnotation\tFragment\tLength\tgroup\n"
        "A\tred one\t5.0\t\t10.0\tg1\nB\tred two\t5.0\tfragment\t20.0\tg1\nC\tblue\t5.0\t\t30.0\tg2\n"
    )
    (tmp_path / "scores.txt").write_text(
        "".join(f"{q}.pdb {t}.pdb {1.0 if q == t else 0.5}\n" for q in "ABC" for t in "ABC" if q + t != "AC")
    )
    (tmp_path / "override.tsv").write_text("protid\tgroup\nC\tg1\n")
    return tmp_path


def test_lists_and_features(spark, files):
    path = lambda name: str(files / name)
    main(["extract-structure-hits", "--input", path("hits.m8"), "--output", path("ids")], spark)
    assert lines(spark, path("ids")) == {"A", "B"}
    both = [path("K.foldseek_hits.txt"), path("K.blast_hits.txt")]
    main(["aggregate-hits", "--input", *both, "--output", path("all")], spark)
    assert lines(spark, path("all")) == {"A", "B", "C"}
    main(["filter-hits", "--input", path("features.tsv"), "--output", path("kept"), "--max-length", "30"], spark)
    assert lines(spark, path("kept")) == {"A"}
    source = ["source-of-hits", "--input", path("features.tsv"), "--hit-files", *both, "--keyids", "K"]
    main([*source, "--output", path("source")], spark)
    found = {r["protid"]: r["source.method"] for r in table(spark, path("source"))}
    assert found == {"A": "foldseek", "B": "blast+foldseek", "C": "blast"}
    main(["aggregate-fident", "--input", path("hits.m8"), "--protid", "K", "--output", path("fident")], spark)
    main(["key-scores", "--input", path("scores.txt"), "--keyids", "A", "--output", path("key")], spark)
    assert {r["protid"]: float(r["TMscore_v_A"]) for r in table(spark, path("key"))} == {"A": 1.0, "B": 0.5}
    (files / "tm.tsv").write_text("protid\tTMscore_v_K\nA\t0.75\nB\t0\n")
    options = ["--tmscore-file", path("tm.tsv"), "--fident-file", path("fident"), "--protid", "K"]
    main(["concordance", *options, "--output", path("concordance")], spark)
    assert [(r[0], float(r[1])) for r in table(spark, path("concordance"))] == [("A", 0.25)]
    main(
        [
            "aggregate-features",
            "--input",
            path("features.tsv"),
            path("fident"),
            "--features-override-file",
            path("override.tsv"),
            "--output",
            path("merged"),
        ],
        spark,
    )
    merged = {r["protid"]: r for r in table(spark, path("merged"))}
    assert merged["C"]["group"] == "g1" and float(merged["A"]["fident_v_K"]) == 0.5


def test_matrix_commands(spark, files):
    path = lambda name: str(files / name)
    main(["pivot-scores", "--input", path("scores.txt"), "--output", path("matrix")], spark)
    matrix = {r["protid"]: r for r in table(spark, path("matrix"))}
    assert float(matrix["A"]["C"]) == 0.0 and float(matrix["C"]["A"]) == 0.5
    options = ["--features-file", path("features.tsv"), "--features-column", "group"]
    main(["cluster-similarity", "--matrix-file", path("matrix"), *options, "--output", path("blocks")], spark)
    blocks = {(r[0], r[1]): float(r[2]) for r in table(spark, path("blocks"))}
    assert blocks[("g1", "g1")] == pytest.approx(0.75) and blocks[("g2", "g1")] == pytest.approx(0.25)
    main(["reduce", "--input", path("matrix"), "--output", path("pca")], spark)
    assert {r["protid"] for r in table(spark, path("pca"))} == {"A", "B", "C"}
    main(
        [
            "semantic-analysis",
            "--features-file",
            path("features.tsv"),
            "--agg-column",
            "group",
            "--annot-column",
            "Protein names",
            "--output",
            path("text"),
        ],
        spark,
    )
    words = {(r["cluster"], r["word"]): int(r["n"]) for r in table(spark, path("text/words"))}
    assert words[("g1", "red")] == 2
    (files / "members.tsv").write_text("A.pdb\tA.pdb\nA.pdb\tB.pdb\nC.pdb\tC.pdb\n")
    main(["structure-clusters", "--input", path("members.tsv"), "--output", path("sc")], spark)
    assert {r["protid"]: r["StruCluster"] for r in table(spark, path("sc"))} == {"A": "SC0", "B": "SC0", "C": "SC1"}


def test_rows_of_zeros_stay(spark, tmp_path):
    (tmp_path / "matrix.tsv").write_text(
        "protid\tA\tB\tC\tD\nA\t1.0\t0.5\t0.0\t0.0\nB\t0.5\t1.0\t0.0\t0.0\nC\t0.0\t0.0\t0.0\t0.0\n"
    )
    path = lambda name: str(tmp_path / name)
    kept = _scores(spark, path("matrix.tsv")).collect()
    assert {r["query"] for r in kept} == set("ABC") and {r["target"] for r in kept} == set("ABCD")
    assert len(kept) < 12
    main(["reduce", "--input", path("matrix.tsv"), "--output", path("pca")], spark)
    assert {r["protid"] for r in table(spark, path("pca"))} == set("ABC")


def test_plain_layouts_start_from_whole_rows(spark):
    rows = [(q, t, 1.0 if q == t else 0.25) for q in "abcd" for t in "abcd" if q + t != "ad"]
    scores = spark.createDataFrame(rows, "query string, target string, score double")
    found = {r["protid"]: list(r["vector"]) for r in layout.dense_rows(scores).collect()}
    assert found["a"] == [1.0, 0.25, 0.25, 0.0] and found["d"] == [0.25, 0.25, 0.25, 1.0]
    started = []
    try:
        original, layout.reduce_dimensions = layout.reduce_dimensions, lambda rows, mode, *_, **__: started.append((mode, rows))
        for mode in ("tsne", "pca_tsne"):
            layout.score_layout(scores, mode)
    finally:
        layout.reduce_dimensions = original
    (plain, whole), (two_step, components) = started
    assert plain == two_step == "tsne"
    assert "vector" in whole.columns and "coords" in components.columns


def test_run_and_plot_points(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    names = [f"P{i:02d}" for i in range(12)]
    (tmp_path / "scores.txt").write_text(
        "".join(f"{q} {t} {1.0 if q == t else 0.2 + 0.5 * (i % 2 == j % 2)}\n" for i, q in enumerate(names) for j, t in enumerate(names))
    )
    (tmp_path / "features.tsv").write_text(
        "protid\tProtein names\tAnnotation\tFragment\tLength\n"
        + "".join(f"{n}\tkind {i % 2}\t5.0\t\t{100 + i}.0\n" for i, n in enumerate(names))
    )
    (tmp_path / "config.json").write_text('{"mode": "cluster", "key_proteins": ["P00"], "plotting_modes": ["pca"]}')
    options = ["--config", path("config.json"), "--scores", path("scores.txt"), "--metadata", path("features.tsv")]
    main(["run", *options, "--folder", path("out")], spark)
    assert spark.read.parquet(path("out/features")).count() == 12
    assert spark.read.parquet(path("out/plot_pca")).count() > 0
    (tmp_path / "points.tsv").write_text("protid\tPC0\tPC1\n" + "".join(f"{n}\t{i}\t{-i}\n" for i, n in enumerate(names)))
    main(["plot-points", "--dimensions", path("points.tsv"), "--features", path("features.tsv"), "--output", path("plot")], spark)
    assert {r["protid"] for r in table(spark, path("plot"))} == set(names)
