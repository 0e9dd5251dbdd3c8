from __future__ import annotations

import zlib

import numpy as np

from homologrid.llm.common import documents
from homologrid.llm.language import (
    Model,
    features,
    fit_machine,
    has_letters,
    identified,
    op10_language_id,
    train,
    with_language,
)

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in documents(spark, FOLDER).select("doc_id", "lang").collect()}
    got = op10_language_id(spark, FOLDER).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in held)
    assert right >= 0.97 * len(held), (right, len(held))
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"the house of the king and {i}", "en", "x", "y") for i in range(30)]
        + [(100 + i, f"das haus der koenigin und {i}", "de", "x", "y") for i in range(30)]
        + [(200 + i, f"la casa del rey y {i}", "es", "x", "y") for i in range(30)]
        + [(300, None, "en", None, None), (301, "", None, "s", "t"), (302, "123 !!", "zz", "s", "t")]
        + [(None, "das haus " * 60_000, None, "s", "t"), (400, "the king", None, "s", "t"), (400, "the king", None, "s", "t")],
        "doc_id long, text string, lang string, score string, lang_pred string",
    ).repartition(4)
    model = train(docs, per_language=20)
    assert model.languages == ["de", "en", "es"] and model.families == ["germanic", "romance"]
    out = with_language(docs, model, into=("found", "trust"))
    assert out.columns == [*docs.columns, "found", "trust"]
    rows = out.collect()
    assert len(rows) == 96
    assert {(r.doc_id, r.found, r.trust) for r in rows if r.doc_id in (300, 301, 302)} == {
        (i, "und", 0.0) for i in (300, 301, 302)
    }
    assert [r.found for r in rows if r.doc_id is None] == ["de"]
    assert [r.found for r in rows if r.doc_id == 400] == ["en", "en"]
    assert sum(r.found == r.lang for r in rows if r.lang and r.text and has_letters(r.text)) == 90
    kept = identified(docs)
    assert kept.columns == docs.columns and kept.count() == 93
    assert train(docs.limit(0)) is None
    assert with_language(docs.limit(0), None, into=("a", "b")).count() == 0
    assert {r.a for r in with_language(docs, None, into=("a", "b")).collect()} == {"und"}


def test_features_cover_whole_texts():
    import homologrid.llm.language as module

    text = bytes(range(97, 123)) * 40
    whole, module.PIECE = features(text), 50
    try:
        assert np.array_equal(whole, features(text))
    finally:
        module.PIECE = 1 << 20


def test_machines_separate_and_duels_vote():
    rng = np.random.default_rng(0)
    rows = rng.random((60, module_dimensions())).astype(np.float32)
    side = np.where(rows[:, 0] > 0.5, 1.0, -1.0)
    rows[:, 0] += side
    weights = fit_machine(rows, side)
    assert (np.sign(rows @ weights[:-1] + weights[-1]) == side).mean() > 0.95
    labels = ["fr", "es", "it"] * 20
    for i, label in enumerate(labels):
        rows[i] = 0
        rows[i, ord(label[0])] = 1
    model = Model(rows, labels)
    assert model.families == ["romance"] and len(model.duels) == 3
    assert [model.predict(r)[0] for r in rows] == labels


def module_dimensions():
    from homologrid.llm.language import DIMENSIONS

    return DIMENSIONS
