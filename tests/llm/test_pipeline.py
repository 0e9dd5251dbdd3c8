"""Each stage against a brute-force version on its own input."""

from __future__ import annotations

import hashlib

import public_tokenizers

import corpus_pipeline
from homologrid.llm.bpe import RANKS, encoder
from homologrid.llm.common import documents
from homologrid.staging import StageArea
from tests.llm.test_near_copies import brute_survivors

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    area, docs = StageArea(spark, "test"), documents(spark, FOLDER)
    columns, steps = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = area.write(stage(spark, docs, FOLDER), name)
        steps.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    given, identified, exact, near, mixed, coded = steps
    assert sorted(identified) == sorted(r for r in given if any(map(str.isalpha, r.text)))
    largest = {}
    for r in identified:
        largest[r.text] = max(r.doc_id, largest.get(r.text, -1))
    assert sorted(r.doc_id for r in exact) == sorted(largest.values())
    assert {r.doc_id for r in near} == brute_survivors([(r.doc_id, r.text) for r in exact])
    words = {r.doc_id: r.text.split() for r in near}
    total = sum(map(len, words.values()))
    assert abs(sum(len(r.text.split()) for r in mixed) - total) <= len({r.source for r in near})
    for r in mixed:
        assert set(r.text.split()) <= set(words[r.doc_id])
    own = encoder(public_tokenizers.path(RANKS))
    assert sorted(r.text for r in coded) == sorted(r.text for r in mixed)
    assert all(own.decode(_array(r.ids)).decode() == r.text for r in coded)
    ran = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, ran.collect())) == sorted(map(str, coded))


def test_the_last_stage_decodes(spark):
    texts = ["", "é  b\n\n c", "日本 語 x<|endoftext|>y", "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in corpus_pipeline.byte_bpe(spark, docs, FOLDER).collect():
        assert row.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def _array(ids):
    import numpy as np

    return np.array(ids)


def test_an_empty_table_passes_all_stages(spark):
    docs = documents(spark, FOLDER).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
