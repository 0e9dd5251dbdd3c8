"""End-to-end runs, resume, incremental ingestion, settings."""

from __future__ import annotations

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from homologrid.plans.runs import Inputs, Run
from homologrid.plans.settings import InputError, Mode, Settings, is_on
from homologrid.schemas import STRUCTURE_HITS
from homologrid.staging import ResumableStages, StageArea, shared_folder
from homologrid.streaming.ingest import start_ingestion, stream_structure_hits
from tests.test_sources import atom, structure_row

GROUPS = 3
SIZE = 24


def names():
    return [f"P{i:02d}" for i in range(SIZE)]


def scores(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i, q in enumerate(names()):
        for j, t in enumerate(names()):
            same = i % GROUPS == j % GROUPS
            if same or rng.random() < 0.2:
                value = 1.0 if i == j else (0.8 if same else 0.3) + 0.05 * rng.random()
                rows.append((q, t, round(float(value), 4)))
    return spark.createDataFrame(rows, "query string, target string, score double")


def metadata(spark):
    rows = [
        (n, f"kinase {'alpha' if i % GROUPS else 'beta'}", 5.0, None, float(100 + 40 * (i % GROUPS) + i))
        for i, n in enumerate(names())
    ]
    return spark.createDataFrame(
        rows,
        "protid string, `Protein names` string, Annotation double, Fragment string, Length double",
    )


def structure_lines(spark):
    rows = [
        (n, k, atom(k + 1, "A", 50.0 + 10 * (i % GROUPS))) for i, n in enumerate(names()) for k in range(3)
    ]
    return spark.createDataFrame(rows, "protid string, line_no int, line string")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "run")


def test_cluster_run(spark, folder):
    settings = Settings().overlaid(
        {
            "mode": "cluster",
            "key_proteins": ["P00"],
            "components": 4,
            "layout_rounds": 3,
            "plotting_modes": ["pca", "pca_umap"],
        }
    )
    inputs = Inputs(scores(spark), metadata(spark), structure_lines(spark))
    run = Run(spark, inputs, settings, folder)
    results = run.all()
    features = results["features"]
    assert features.count() == SIZE
    assert {"LeidenCluster", "StruCluster", "pdb_confidence", "TMscore_v_P00"} <= set(features.columns)
    rows = {r["protid"]: r for r in features.collect()}
    assert len({rows[f"P{i:02d}"]["LeidenCluster"] for i in range(0, SIZE, GROUPS)}) == 1
    assert rows["P00"]["TMscore_v_P00"] == 1.0
    assert results["blocks_leiden"].where("target_cluster = query_cluster").count() >= 2
    assert set(results["plot_pca"].select("feature").distinct().toPandas()["feature"]) >= {
        "LeidenCluster",
        "pdb_confidence",
    }
    assert results["plot_pca_umap"].select("protid").distinct().count() == SIZE
    assert results["markers"].count() > 0
    assert results["words"].where("word = 'kinase'").count() >= 2
    # A second run reads the stages that are there.
    (marker,) = glob.glob(f"{folder}/features-*/_SUCCESS")
    written = os.path.getmtime(marker)
    again = Run(spark, Inputs(scores(spark), metadata(spark)), settings, folder)
    assert again.features().count() == SIZE
    assert os.path.getmtime(marker) == written


def test_search_run_features(spark, folder):
    hits = [structure_row(f"AF-{n}-F1-model_v4 x", 1e-9, fident=40.0).split("\t") for n in names()[:20]]
    hits.append(structure_row("AF-P21-F1-model_v4 x", 0.5).split("\t"))
    raw = spark.createDataFrame(hits, ", ".join(f"{n} string" for n in STRUCTURE_HITS.names))
    table = raw.select(*[F.col(f.name).cast(f.dataType) for f in STRUCTURE_HITS.fields])
    sequence = spark.createDataFrame(
        [(f"NP_{i}", float(i)) for i in range(15, 24)], "sacc string, evalue double"
    )
    mapping = spark.createDataFrame(
        [(f"NP_{i}", f"P{i:02d}") for i in range(24)], "from string, to string"
    )
    settings = Settings(key_proteins=("P00",), components=4, plotting_modes=())
    inputs = Inputs(
        scores(spark),
        metadata(spark),
        structure_hits={"P00": table},
        sequence_hits={"P00": sequence},
        id_mapping=mapping,
        override=spark.createDataFrame([("P03", "renamed")], "protid string, `Protein names` string"),
    )
    run = Run(spark, inputs, settings, folder)
    rows = {r["protid"]: r for r in run.features().collect()}
    assert len(rows) == SIZE
    assert rows["P03"]["Protein names"] == "renamed"
    assert rows["P00"]["source.method"] == "foldseek"
    assert rows["P16"]["source.method"] == "blast+foldseek"
    assert rows["P22"]["source.method"] == "blast"
    assert rows["P01"]["P00.hit"] == 1
    assert rows["P03"]["fident_v_P00"] == pytest.approx(0.4)
    assert rows["P03"]["concordance_v_P00"] == pytest.approx(rows["P03"]["TMscore_v_P00"] - 0.4)
    capped = Run(spark, inputs, Settings(key_proteins=("P00",), max_structures=5), folder + "2")
    assert capped.proteins().count() in (5, 6)


def test_run_checks(spark, folder):
    few = scores(spark).where("query < 'P05'")
    with pytest.raises(InputError, match="at least 10"):
        Run(spark, Inputs(few, metadata(spark)), Settings(mode=Mode.CLUSTER), folder)
    with pytest.raises(InputError, match="key proteins"):
        settings = Settings(mode=Mode.CLUSTER, key_proteins=("nope",))
        Run(spark, Inputs(scores(spark), metadata(spark)), settings, folder)
    with pytest.raises(InputError):
        Settings().overlaid({"unknown": 1})
    with pytest.raises(InputError):
        Settings(min_length=5, max_length=2).checked()
    with pytest.raises(InputError):
        Settings().overlaid({"plotting_modes": ["mds"]})
    assert is_on(" Yes ") and not is_on("0") and not is_on(None)


def test_ingestion_resumes(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.m8").write_text(
        "\n".join(
            [
                structure_row("AF-P1-F1-model_v4 x", 1e-5),
                structure_row("AF-P1-F1-model_v4 x", 1e-9),
                structure_row("AF-P2-F1-model_v4 x", 0.5),
            ]
        )
        + "\n"
    )
    def ingest():
        start_ingestion(stream_structure_hits(spark, str(source)), target).awaitTermination()
        return {r["protid"]: r["evalue"] for r in spark.read.parquet(target).collect()}

    assert ingest() == {"P1": 1e-9}
    (source / "b.m8").write_text(
        structure_row("AF-P1-F1-model_v4 x", 1e-30) + "\n" + structure_row("AF-P3-F1-model_v4 x", 1e-7) + "\n"
    )
    assert ingest() == {"P1": 1e-9, "P3": 1e-7}
    assert ingest() == {"P1": 1e-9, "P3": 1e-7}
    # Another session finds the checkpoint by the table, whatever its shared folder is.
    (source / "c.m8").write_text(structure_row("AF-P4-F1-model_v4 x", 1e-7).replace("\t375\t", "\t375.0\t") + "\n")
    other = spark.newSession()
    start_ingestion(stream_structure_hits(other, str(source)), target).awaitTermination()
    stored = spark.read.parquet(target)
    assert {r["protid"] for r in stored.collect()} == {"P1", "P3", "P4"} and stored.count() == 3


def test_stages_differ_by_what_they_are_given(spark, tmp_path):
    stages = ResumableStages(spark, str(tmp_path / "stages"))
    made = [stages.run("x", lambda n=n: spark.range(n), n) for n in (1, 2, 1)]
    assert [m.count() for m in made] == [1, 2, 1]
    run = Run(spark, Inputs(scores(spark), metadata(spark)), Settings(mode=Mode.CLUSTER, key_proteins=("P00", "P01")), str(tmp_path / "run"))
    first = {r["feature"] for r in run.markers(("Length",)).collect()}
    second = {r["feature"] for r in run.markers(("Annotation",)).collect()}
    assert "Length" in first and "Annotation" in second and "Length" not in second
    assert {r["key"] for r in run.markers(("Length",)).collect()} == {"P00", "P01"}


def test_stages(spark, tmp_path):
    stages = ResumableStages(spark, str(tmp_path / "stages"))
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert stages.run("x", build).count() == 3 and stages.run("x", build).count() == 3
    assert len(calls) == 1
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    area = StageArea(spark, "t")
    stage = area.write(spark.range(5))
    assert stage.count() == 5
    area.forget(stage)
    assert not os.path.exists(stage._stage_path)
