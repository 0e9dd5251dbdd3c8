"""Rank sums, distribution gaps, adjustment and markers against direct computation."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from homologrid.functions import kolmogorov
from homologrid.functions.probability import two_sided_p
from homologrid.operators import statistics
from tests.conftest import as_dict


def direct_u(first, second):
    first, second = np.asarray(first, float), np.asarray(second, float)
    return (first[:, None] > second[None, :]).sum() + 0.5 * (first[:, None] == second[None, :]).sum()


def direct_d(first, second):
    grid = np.unique(np.concatenate([first, second]))
    share = lambda v: np.searchsorted(np.sort(v), grid, side="right") / len(v)
    return np.abs(share(first) - share(second)).max()


def frame(spark, data):
    rows = [(name, float(v)) for name, values in data.items() for v in values]
    return spark.createDataFrame(rows, "cluster string, value double")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(
        st.sampled_from("abcd"),
        st.lists(st.integers(0, 6), min_size=1, max_size=12),
        min_size=2,
        max_size=4,
    )
)
def test_rank_sums_and_gaps(spark, data):
    values = frame(spark, data)
    target = sorted(data)[0]
    for targets in (None, [target]):
        tested = {r["cluster"]: r for r in statistics.rank_sum_test(values, targets).collect()}
        gaps = as_dict(statistics.distribution_gap_test(values, targets), "cluster", "d")
        for name, mine in data.items():
            rest = [v for other, vs in data.items() if other != name for v in vs]
            other = rest if targets is None else data[target]
            assert tested[name]["u"] == direct_u(mine, other)
            assert (tested[name]["n1"], tested[name]["n2"]) == (len(mine), len(other))
            assert 0 <= tested[name]["p"] <= 1
            assert gaps[name] == pytest.approx(direct_d(mine, other))


def test_exact_p_values():
    # Counted by hand: 3 against 3 without overlap, and one swap.
    assert statistics.exact_rank_sum_tail(3, 3, 0.0) == pytest.approx(2 / 20)
    assert statistics.exact_rank_sum_tail(3, 3, 1.0) == pytest.approx(4 / 20)
    assert statistics.exact_rank_sum_tail(1, 4, 2.0) == 1.0
    # Both sides of all arrangements add up.
    assert statistics.exact_rank_sum_tail(5, 7, 35 / 2) == 1.0


def test_exact_is_used_for_small_untied_samples(spark):
    values = frame(spark, {"a": [1, 2, 3], "b": [4, 5, 6]})
    assert as_dict(statistics.rank_sum_test(values), "cluster", "p")["a"] == pytest.approx(0.1)
    tied = frame(spark, {"a": [1, 2, 3, 3], "b": [3, 5, 6]})
    p = as_dict(statistics.rank_sum_test(tied), "cluster", "p")["a"]
    assert p != pytest.approx(statistics.exact_rank_sum_tail(4, 3, 1.0))


def test_all_equal_values_give_no_evidence(spark):
    rows = statistics.rank_sum_test(frame(spark, {"a": [1] * 9, "b": [1] * 9})).collect()
    assert {r["p"] for r in rows} == {1.0}


def test_tail_probabilities(spark):
    points = [0.0, 0.3, 1.0, 1.96, 3.49, 3.51, 5.0, 8.0, 20.0]
    table = spark.createDataFrame([(z,) for z in points], "z double")
    got = [r[0] for r in table.select(two_sided_p(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in points], rel=1e-9)


def largest_gap(order):
    """D of two samples given as the pooled order of their members (1 for the first)."""
    n1, n2 = sum(order), len(order) - sum(order)
    return max(abs(sum(order[:k]) / n1 - (k - sum(order[:k])) / n2) for k in range(len(order) + 1))


def test_kolmogorov_smirnov_p():
    # All orders of two small samples.
    for n1, n2 in ((3, 4), (5, 5), (6, 3), (4, 6)):
        orders = [
            [int(i in chosen) for i in range(n1 + n2)]
            for chosen in itertools.combinations(range(n1 + n2), n1)
        ]
        gaps = [largest_gap(o) for o in orders]
        for d in set(gaps):
            share = sum(g >= d - 1e-12 for g in gaps) / len(gaps)
            assert kolmogorov.two_sample_tail(n1, n2, d) == pytest.approx(share)
    # The value that Marsaglia, Tsang and Wang print, and agreement of independent formulas.
    assert 1 - kolmogorov._inside_exact(10, 0.274) == pytest.approx(1 - 0.6284796154565043)
    for n, d in ((500, 0.05), (2000, 0.02)):
        assert kolmogorov._inside_series(n, d) == pytest.approx(kolmogorov._inside_exact(n, d), abs=1e-7)
    assert kolmogorov.one_sample_tail(3000, 0.03) == pytest.approx(
        1 - kolmogorov._inside_series(3000, 0.03), rel=1e-4
    )
    assert kolmogorov.two_sample_tail(5, 5, 0.0) == 1.0


def test_exact_rank_sums_with_a_large_second_sample():
    # Counting by hand: one value among n has 2 (u + 1) / (n + 1) orders at least as extreme.
    assert statistics.exact_rank_sum_tail(1, 50_000, 3) == pytest.approx(8 / 50_001)
    for small in (2, 3):
        ranks = [sum(c) - small * (small - 1) / 2 for c in itertools.combinations(range(small + 9), small)]
        for u in range(0, 9 * small // 2):
            want = 2 * sum(r <= u for r in ranks) / len(ranks)
            assert statistics.exact_rank_sum_tail(small, 9, u) == pytest.approx(min(1.0, want))


def test_adjustment(spark):
    table = spark.createDataFrame(
        [(0.01,), (0.04,), (0.03,), (0.005,)], "p double"
    )
    got = as_dict(statistics.adjust_p(table), "p", "padj")
    assert {p: round(v, 9) for p, v in got.items()} == {0.01: 0.02, 0.04: 0.04, 0.03: 0.04, 0.005: 0.02}
    rng = np.random.default_rng(1)
    p = np.round(rng.random(300) ** 2, 2)
    order = np.argsort(p, kind="stable")
    raw = p[order] * 300 / np.arange(1, 301)
    want = np.empty(300)
    want[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double")
    got = as_dict(statistics.adjust_p(table), "i", "padj")
    assert [got[i] for i in range(300)] == pytest.approx(list(want))


def test_markers_and_empty_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [("t", float(v)) for v in rng.normal(0, 1, 60)]
    rows += [("low", float(v)) for v in rng.normal(-5, 1, 60)]
    rows += [("high", float(v)) for v in rng.normal(5, 1, 60)]
    rows += [("empty", None), ("empty", None), (None, 3.0)]
    table = spark.createDataFrame(rows, "cluster string, v double").withColumn(
        "protid", F.monotonically_increasing_id().cast("string")
    )
    values = statistics.cluster_values(table, "cluster", "v")
    assert values.where("cluster = 'empty'").collect()[0]["value"] == 0.0
    assert values.where("cluster = 'empty'").count() == 1
    found = as_dict(statistics.marked_clusters(values, ["t"]), "cluster", "marker")
    assert found["low"] == "v" and found["high"] == "^" and found["t"] == "."
    rest = as_dict(statistics.marked_clusters(values), "cluster", "marker")
    assert rest["low"] == "*"
    key = table.where("cluster = 't'").first()["protid"]
    stacked = statistics.column_markers(table, "cluster", ["v", "absent"], [key])
    assert as_dict(stacked, "cluster", "marker") == found
    with pytest.raises(ValueError, match="unknown method"):
        statistics.distribution_test(values, method="T")
    with pytest.raises(ValueError, match="unknown clusters"):
        statistics.distribution_test(values, ["nope"])


def test_row_order_does_not_matter(spark):
    rng = np.random.default_rng(4)
    values = frame(spark, {c: rng.normal(i, 1, 50) for i, c in enumerate("abc")})
    shuffled = values.orderBy(F.rand(3)).repartition(5)
    key = lambda df: sorted((r["cluster"], round(r["u"], 6), round(r["p"], 12)) for r in df.collect())
    assert key(statistics.rank_sum_test(values)) == key(statistics.rank_sum_test(shuffled))
