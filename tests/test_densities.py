"""Densities against direct sums."""

from __future__ import annotations

import math

import numpy as np

from homologrid.operators.densities import cluster_densities


def test_densities_are_direct_sums(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=40).round(1).tolist() * 2, "b": rng.random(15).tolist(), "one": [3.0], "flat": [2.0] * 4}
    rows = [(c, x, "kept") for c, own in values.items() for x in own]
    rows += [("a", None, ""), ("a", float("nan"), ""), (None, 1.0, "")]
    frame = spark.createDataFrame(rows, "cluster string, x double, point string")
    found = cluster_densities(frame, "cluster", "x", points=21).collect()
    assert {r.cluster for r in found} == {"a", "b"} and len(found) == 42
    every = np.concatenate(list(values.values()))
    grid = np.linspace(every.min(), every.max(), 21)
    for r in found:
        own = np.array(values[r.cluster])
        width = 1.06 * own.std(ddof=1) * len(own) ** -0.2
        direct = np.exp(-0.5 * ((grid[r.point] - own) / width) ** 2).sum() / (len(own) * width * math.sqrt(2 * math.pi))
        assert abs(r.density - direct) < 1e-9 and abs(r.at - grid[r.point]) < 1e-9 and r.n == len(own)


def test_no_rows_no_densities(spark):
    frame = spark.createDataFrame([], "cluster string, x double")
    assert cluster_densities(frame, "cluster", "x").count() == 0
