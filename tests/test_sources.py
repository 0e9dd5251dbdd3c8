"""Readers and writers on hand-written files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from homologrid.operators import hits, quality, similarity
from homologrid.sources import (
    id_mapping,
    search_xml,
    sequences,
    structures,
    tabular,
    writers,
)


def structure_row(target, evalue, prob=0.9, fident=50.0, query="Q"):
    cells = [query, target, fident, 100, 1, 0, 1, 100, 1, 100, prob, evalue, 300, 1.0, 1.0]
    cells += ["AAA", "BBB", "0", "CCC", "9606", "Homo sapiens"]
    return "\t".join(str(c) for c in cells)


@pytest.fixture
def structure_files(tmp_path):
    first = tmp_path / "a.m8"
    first.write_text("")
    second = tmp_path / "b.m8"
    second.write_text(
        "\n".join(
            [
                structure_row("AF-P60709-F1-model_v4 Actin", 1e-30),
                structure_row("AF-P60710-fragment Actin", 1e-30),
                structure_row("AF-P60711-F1-model_v4 Actin", 0.01),
                structure_row("AF-P60712-F1-model_v4 Actin", 0.0099),
            ]
        )
        + "\n"
    )
    third = tmp_path / "c.m8"
    third.write_text(
        "\n".join(
            [
                structure_row("AF-P60709-F1-model_v4 Actin", 1e-40, prob=0.5, fident=40.0),
                structure_row("AF-P60712-F1-model_v4 Actin", 0.0099, prob=0.95, fident=20.0),
            ]
        )
        + "\n"
    )
    return [str(first), str(second), str(third)]


def test_structure_hits_extraction(spark, structure_files):
    table = tabular.read_structure_hits(spark, structure_files, with_position=True)
    assert table.count() == 6
    found = hits.extract_structure_hits(table, F.col("pos"))
    assert {r["protid"] for r in found.collect()} == {"P60709", "P60712"}
    capped = hits.extract_structure_hits(table, F.col("pos"), limit=1)
    assert [r["protid"] for r in capped.collect()] == ["P60709"]


def test_best_hit_across_files(spark, structure_files):
    best = hits.identity_features(tabular.read_structure_hits(spark, structure_files), "Q")
    rows = {r["protid"]: r for r in best.collect()}
    assert set(rows) == {"P60709", "P60711", "P60712"}
    assert rows["P60709"]["evalue_v_Q"] == 1e-40
    assert rows["P60709"]["fident_v_Q"] == pytest.approx(0.4)
    # Equal e-values: the higher prob wins.
    assert rows["P60712"]["prob_v_Q"] == 0.95


def test_empty_hits_keep_their_columns(spark, structure_files):
    best = hits.identity_features(tabular.read_structure_hits(spark, structure_files[:1]), "Q")
    assert best.columns == ["protid", "prob_v_Q", "evalue_v_Q", "fident_v_Q"]
    assert best.count() == 0


def test_sequence_hits(spark, tmp_path):
    cells = ["q", "s", "99.0", "375", "0", "0", "1", "375", "1", "375", "0.0", "787"]
    rows = [
        cells + ["NP_1", "NP_1.1", "0", "1", "N/A"],
        cells + ["NP_2", "NP_2.1", "0", "1", "Bos taurus"],
        cells + ["N/A", "x", "0", "1", "N/A"],
        cells + ["NP_1", "NP_1.1", "0", "1", "N/A"],
    ]
    path = tmp_path / "hits.tsv"
    path.write_text("\n".join("\t".join(r) for r in rows) + "\n")
    table = tabular.read_sequence_hits(spark, str(path), with_position=True)
    assert table.where("scomnames is null").count() == 3
    assert table.select("length").first()[0] == 375
    found = hits.extract_sequence_hits(table, F.col("pos"))
    assert [r["sacc"] for r in found.orderBy("pos").collect()] == ["NP_1", "NP_2"]
    assert tabular.columns_of_format("6 qseqid sacc") == ["qseqid", "sacc"]
    with pytest.raises(hits.NoHitsError):
        hits.require_hits(found.where("false"))
    assert hits.require_hits(found.where("false"), allow_empty=True).count() == 0


def xml_hit(name, accession, *segments):
    """A hit of the search XML with its segments, as dictionaries of tag endings."""
    parts = [
        "<Hsp>" + "".join(f"<Hsp_{k}>{v}</Hsp_{k}>" for k, v in segment.items()) + "</Hsp>"
        for segment in segments
    ]
    given = f"<Hit_accession>{accession}</Hit_accession>" if accession else ""
    return f"<Hit><Hit_id>{name}</Hit_id><Hit_def>of a yeast</Hit_def>{given}<Hit_hsps>{''.join(parts)}</Hit_hsps></Hit>"


def search_xml_text(query, *found):
    return (
        "Status: ready\n<?xml version=\"1.0\"?>\n<BlastOutput>\n"
        f" <BlastOutput_query-def>{query} a query</BlastOutput_query-def>\n"
        f" <BlastOutput_iterations><Iteration><Iteration_hits>{''.join(found)}</Iteration_hits>"
        "</Iteration></BlastOutput_iterations>\n</BlastOutput>\n"
    )


def test_search_xml(spark, tmp_path):
    path = tmp_path / "out.xml"
    strong = {"bit-score": 212, "evalue": "3e-60", "query-from": 4, "query-to": 203, "hit-from": 11,
              "hit-to": 208, "identity": 120, "gaps": 8, "align-len": 200}
    weak = {"bit-score": 31, "evalue": "0.2", "identity": 9, "gaps": 1, "align-len": 30}
    path.write_text(
        search_xml_text(
            "Q9ZZ31",
            xml_hit("ref|NP_880417.3|", "NP_880417", strong),
            xml_hit("ref|XP_5521.2|", None, weak, {}),
            xml_hit("sp|O00000|X", "O00000", weak, strong),
        )
    )
    found = search_xml.read_search_xml(spark, str(path)).collect()
    rows = {r["sacc"]: r for r in found}
    first = rows["NP_880417"]
    assert first["qseqid"] == "Q9ZZ31"
    assert first["pident"] == 60.0
    assert first["mismatch"] == 200 - 120 - 8
    assert first["evalue"] == 3e-60
    assert (first["sstart"], first["send"]) == (11, 208)
    assert rows["XP_5521"]["sseqid"] == "ref|XP_5521.2|"
    assert {r["sacc"] for r in found} == {"NP_880417", "XP_5521", "O00000"}
    waiting = tmp_path / "waiting.xml"
    waiting.write_text("<html>waiting</html>")
    assert search_xml.read_search_xml(spark, str(waiting)).count() == 0


def test_id_mapping(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(
        json.dumps(
            {
                "results": [
                    {"from": "NP_1", "to": "P1"},
                    {"from": "NP_1", "to": "P2"},
                    {"from": "NP_2", "to": {"primaryAccession": "P3"}},
                    {"from": "NP_9", "to": "P9"},
                ]
            }
        )
    )
    mapping = id_mapping.read_id_mapping(spark, str(path))
    ids = spark.createDataFrame([("NP_1",), ("NP_2",), ("NP_1",)], "protid string")
    assert {r[0] for r in hits.map_ids(ids, mapping).collect()} == {"P1", "P2", "P3"}


def test_pair_scores_and_conflicts(spark, tmp_path):
    path = tmp_path / "scores.txt"
    path.write_text("A.pdb A.pdb 1.0 x\nA.pdb B.pdb  0.5\nA.pdb B.pdb 0.5\nB.pdb\tB.pdb 1.0\n")
    scores = tabular.read_pair_scores(spark, str(path))
    checked = similarity.check_scores(scores)
    assert {(r["query"], r["target"], r["score"]) for r in checked.collect()} == {
        ("A", "A", 1.0),
        ("A", "B", 0.5),
        ("B", "B", 1.0),
    }
    wide = similarity.wide_matrix(checked, ["A", "B"])
    assert [tuple(r) for r in wide.collect()] == [("A", 1.0, 0.5), ("B", 0.0, 1.0)]
    path.write_text("A.pdb B.pdb 0.9\nA.pdb B.pdb 0.90\n")
    with pytest.raises(Exception, match="conflicting scores"):
        similarity.check_scores(tabular.read_pair_scores(spark, str(path))).collect()


def test_matrix_round_trip(spark, tmp_path):
    scores = spark.createDataFrame(
        [("b.1", "a", 0.25), ("a", "b.1", 0.5)], "query string, target string, score double"
    )
    folder = str(tmp_path / "matrix")
    writers.write_table(similarity.wide_matrix(scores, ["a", "b.1"]).coalesce(1), folder)
    back = tabular.read_matrix(spark, folder)
    assert {tuple(r) for r in back.collect()} == {
        ("a", "a", 0.0),
        ("a", "b.1", 0.5),
        ("b.1", "a", 0.25),
        ("b.1", "b.1", 0.0),
    }


def test_tables_and_lists(spark, tmp_path):
    path = tmp_path / "features.tsv"
    path.write_text("protid\tLength\tOrganism\nP1\t375.0\tN/A\nP2\t\tHomo sapiens\n")
    table = tabular.read_features(spark, str(path), numbers=["Length"])
    rows = {r["protid"]: r for r in table.collect()}
    assert rows["P1"]["Length"] == 375.0 and rows["P1"]["Organism"] is None
    assert rows["P2"]["Length"] is None
    out = str(tmp_path / "out")
    writers.write_table(table.withColumn("tags", F.array(F.lit("A"))), out)
    assert tabular.read_features(spark, out).where("tags = '[\"A\"]'").count() == 2
    empty = str(tmp_path / "empty")
    writers.write_table(table.where("false"), empty)
    assert spark.read.csv(empty, sep="\t", header=True).columns == table.columns
    ids = str(tmp_path / "ids")
    writers.write_ids(table, ids)
    assert {r["protid"] for r in tabular.read_ids(spark, ids).collect()} == {"P1", "P2"}
    members = tmp_path / "members.tsv"
    members.write_text("r.pdb\ta.pdb\nr.pdb\tr.pdb\n")
    assert tabular.read_cluster_members(spark, str(members)).count() == 2


def atom(serial, chain, temp, residue="GLY"):
    return (
        f"ATOM  {serial:5d}  CA  {residue} {chain}{serial:4d}    "
        f"{1.0:8.3f}{2.0:8.3f}{3.0:8.3f}  1.00{temp:6.2f}           C  "
    )


STRUCTURES = {
    "predicted": [
        "TITLE     ALPHAFOLD MONOMER",
        "REMARK   1 ALPHAFOLD DATA",
        atom(1, "A", 35.4),
        atom(2, "A", 90.0),
    ],
    "unit_scale": ["TITLE     ESMFOLD PREDICTION", atom(1, "A", 0.5), atom(2, "A", 0.9)],
    "experimental": [
        "DBREF  1ABC A    1   10  PDB    1ABC     1ABC             1     10",
        "REMARK   1 RCSB ENTRY",
        "EXPDTA    X-RAY DIFFRACTION; NEUTRON",
        atom(1, "B", 20.0),
        atom(2, "A", 20.0),
        atom(3, "B", 20.0),
    ],
    "bare": [atom(1, "A", 40.0), atom(2, "A", 60.0)],
    # A mention and a title for each of two origins: the later name wins.
    "tie": ["TITLE     ALPHAFOLD", "REMARK    ESMFOLD", atom(1, "A", 50.0)],
    "straddle": [atom(1, "A", 0.5), atom(2, "A", 89.5)],
    "failed": ["<Error><Code>NoSuchKey</Code></Error>"],
}


@pytest.fixture
def lines(spark, tmp_path):
    for name, text in STRUCTURES.items():
        (tmp_path / f"{name}.pdb").write_text("\n".join(text) + "\n")
    (tmp_path / "notes.txt").write_text("not a structure")
    return structures.read_structure_lines(spark, str(tmp_path))


def test_structure_assessment(lines):
    rows = {r["protid"]: r for r in quality.assess_structures(lines).collect()}
    assert set(rows) == set(STRUCTURES) - {"failed"}
    found = {name: (r["pdb_origin"], round(r["pdb_confidence"], 6)) for name, r in rows.items()}
    assert found == {
        "predicted": ("AlphaFold", 62.7),
        "unit_scale": ("ESMFold", 70.0),
        "experimental": ("PDB", 100.0),
        "bare": ("Other", 50.0),
        "tie": ("ESMFold", 50.0),
        "straddle": ("Other", 45.0),
    }
    assert rows["experimental"]["pdb_chains"] == ["B", "A"]


def test_structure_records(lines):
    atoms = structures.atoms(lines).where("protid = 'experimental'").orderBy("line_no").collect()
    assert [(a["SERIAL"], a["CHAIN"], a["X"], a["Z"], a["TEMP"]) for a in atoms] == [
        (1, "B", 1.0, 3.0, 20.0),
        (2, "A", 1.0, 3.0, 20.0),
        (3, "B", 1.0, 3.0, 20.0),
    ]
    assert structures.database_references(lines).first()["database"] == "PDB"
    titles = {r["protid"]: r["title"] for r in structures.titles(lines).collect()}
    assert titles["predicted"] == "ALPHAFOLD MONOMER"
    remarks = {r["protid"]: r["remark"] for r in structures.remarks(lines).collect()}
    assert remarks["predicted"] == "1 ALPHAFOLD DATA"
    methods = structures.experiments(lines).first()["methods"]
    assert methods == ["X-RAY DIFFRACTION", " NEUTRON"] or methods == ["X-RAY DIFFRACTION", "NEUTRON"]


def test_sequences(spark, tmp_path):
    (tmp_path / "P1.fasta").write_text(">sp|P1| a protein\nMKV\nLLA\n")
    row = sequences.read_sequences(spark, str(tmp_path)).first()
    assert (row["protid"], row["record_id"], row["sequence"]) == ("P1", "sp|P1|", "MKVLLA")
    assert sequences.foldable(sequences.read_sequences(spark, str(tmp_path)), 5).count() == 0
    (tmp_path / "P2.fasta").write_text(">a\nMK\n>b\nMK\n")
    with pytest.raises(Exception, match="exactly one record"):
        sequences.read_sequences(spark, str(tmp_path)).collect()
