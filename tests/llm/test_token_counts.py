from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from homologrid.llm.common import documents
from homologrid.llm.token_counts import VOCABULARY, line_bounds, op6_token_counts, section_counts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return out


def plain(text, spans, rule, tokenizer):
    counts, outside = [0] * len(spans), 0
    for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
        if rule == "most":
            shares = [min(b, y) - max(a, x) for x, y in spans]
            at = int(np.argmax(shares)) if shares and max(shares) > 0 else None
        else:
            point = a if rule == "first" else b - 1
            at = next((i for i, (x, y) in enumerate(spans) if x <= point < y), None)
        if at is None:
            outside += 1
        else:
            counts[at] += 1
    rows = [(i, x, y, n) for i, ((x, y), n) in enumerate(zip(spans, counts))]
    return rows + [(-1, -1, -1, outside)] * bool(outside)


def test_lines_of_a_table(spark, tokenizer):
    got = sorted(tuple(r) for r in op6_token_counts(spark, FOLDER).collect())
    want = []
    for r in documents(spark, FOLDER).collect():
        bounds = line_bounds(r.text).tolist()
        want += [(r.doc_id, *x) for x in plain(r.text, list(zip(bounds, bounds[1:])), "first", tokenizer)]
    assert got == sorted(want)


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_given_sections(spark, tokenizer, rule):
    rng = random.Random(0)
    rows = []
    for i in range(300):
        text = "".join(rng.choices(["some ", "words", "é", "日本", "\n\n", "  ", "'s", "\U0001f600"], k=rng.randint(0, 14)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 3))))
        rows.append((i, text, list(zip(cuts[::2], cuts[1::2])), "x"))
    rows += [(400, None, None, None), (401, "text", None, None), (402, "text here", [(0, 4)], None), (402, "text here", [(0, 4)], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,end:int>>, section string")
    got = sorted(tuple(r) for r in section_counts(docs, sections="spans", rule=rule).collect())
    want = [(i, *x) for i, t, s, _ in rows for x in plain(t or "", s or [], rule, tokenizer)]
    assert got == sorted(want)


def test_long_and_missing_texts(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "\n"), (None, "a\nb\n"), (4, "long line " * 30_000 + "\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in section_counts(docs).collect()]
    n = len(tokenizer.encode(rows[4][1], add_special_tokens=False).ids)
    assert {r[:2] for r in got} == {(3, 0), (None, 0), (None, 1), (4, 0), (4, 1)}
    assert sum(r[4] for r in got if r[0] == 4) == n
    assert section_counts(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        section_counts(docs, rule="none")
