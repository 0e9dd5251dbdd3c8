from __future__ import annotations

import math

import numpy as np
import pytest

from homologrid.llm.topk import Lists, top_k


def plain(rows, k=10):
    usable = [
        (number, i, [math.floor(1024 * float(np.float32(x))) for x in v])
        for number, (i, v) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for number, i, v in usable:
        if i is None or i % 100:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for other, j, w in usable if other != number
        )
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("blocks", [64, 4096])
def test_against_brute_force(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(520)]
    rows += [(1000 + i, [0.25] * 8) for i in range(30)]
    rows += [(600, None), (700, [1.0, None]), (800, [float("nan")] * 8), (900, [float("inf")] + [0.0] * 7)]
    rows += [(2000, []), (2100, [0.5, 0.5]), (None, [0.3] * 8), (2200, [0.0] * 8), (2300, [3e4] * 8)]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = top_k(docs.repartition(4), candidate_rows=blocks, query_rows=4)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows))


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema)).count() == 0
    few = [(0, [1.0]), (1, [0.5]), (100, [0.5])]
    assert sorted(tuple(r) for r in top_k(spark.createDataFrame(few, schema)).collect()) == sorted(plain(few))
    same = [(100, [0.5, 0.25]), (100, [0.5, 0.25])]
    assert [tuple(r) for r in top_k(spark.createDataFrame(same, schema)).collect()] == [(100, 1, 100, 512 * 512 + 256 * 256)] * 2


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [3e4, 1.0]), (1, [2.9e4, 1.0]), (2, [2.9e4, 2.0])]
    docs = spark.createDataFrame([(i, [x * 64 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(docs).collect())
    want = [math.floor(1024 * 64 * x) for x in rows[0][1]]
    assert [g[3] for g in got] == sorted(
        (sum(a * math.floor(1024 * 64 * x) for a, x in zip(want, v)) for _, v in rows[1:]), reverse=True
    )


def test_lists_keep_every_best_candidate():
    rng = np.random.default_rng(1)
    values = np.floor(rng.normal(0, 100, (700, 16)))
    values[100:140] = values[99]
    lists = Lists(values)
    for query in np.floor(rng.normal(0, 100, (40, 16))):
        hidden = np.zeros(700, bool)
        hidden[5] = True
        kept = lists.best(query, 10, hidden)
        scores = values @ query
        kth = np.sort(scores[~hidden])[-10]
        assert set(np.flatnonzero((scores >= kth) & ~hidden)) <= set(kept.tolist())
