"""Neighbours, graphs, components, layouts: brute force and invariants."""

from __future__ import annotations

import numpy as np
import pytest

from homologrid.operators import graph, layout, neighbours, reduction, score_blocks, superposition
from homologrid.operators.neighbours import (
    default_neighbours,
    neighbour_lists,
    smallest,
    squared_distances,
)
from homologrid.plans.clustering import communities_of_coordinates
from homologrid.staging import StageArea
from tests.conftest import as_dict
from workload import map_queries


def vector_frame(spark, matrix, name="vector"):
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(matrix)],
        f"protid bigint, {name} array<double>",
    )


@pytest.fixture(scope="module")
def blobs():
    """Separated groups; a third of all rows are copies of one row."""
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 6)) + rng.integers(0, 4, size=(300, 1)) * 6
    points[100:200] = points[7]
    points[250] = points[251]
    return points


@pytest.mark.parametrize("metric, block_rows", [("euclidean", 2048), ("euclidean", 37), ("cosine", 41)])
def test_neighbours_equal_brute_force(spark, blobs, metric, block_rows):
    k = 6
    points = blobs
    scale = 1.0
    if metric == "cosine":
        points = blobs / np.linalg.norm(blobs, axis=1, keepdims=True)
    else:
        scale = (blobs**2).sum(axis=1).max()
    square = squared_distances(points, points, scale)
    np.fill_diagonal(square, np.inf)
    want = smallest(square, k)
    table = vector_frame(spark, blobs).repartition(3)
    rows = neighbour_lists(table, k, metric=metric, block_rows=block_rows).collect()
    assert len(rows) == len(blobs)
    for row in rows:
        assert list(row["targets"]) == list(want[row["query"]])
        expected = np.sqrt(square[row["query"], want[row["query"]]])
        assert row["distances"] == pytest.approx(list(expected), abs=1e-9)


def test_neighbours_write_no_more_for_more_blocks(spark, monkeypatch):
    """Vectors without groups: every query visits most of 60 blocks, and no table grows with their number."""
    points = np.random.default_rng(2).normal(size=(480, 12))
    written = []

    def counted(self, df, *args, write=StageArea.write, **options):
        out = write(self, df, *args, **options)
        written.append(out.count())
        return out

    monkeypatch.setattr(StageArea, "write", counted)
    rows = neighbour_lists(vector_frame(spark, points), 5, metric="euclidean", block_rows=8)
    plan = rows._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and max(written) <= len(points)
    square = squared_distances(points, points, (points**2).sum(axis=1).max())
    np.fill_diagonal(square, np.inf)
    want = smallest(square, 5)
    assert {r["query"]: r["targets"] for r in rows.collect()} == {i: list(w) for i, w in enumerate(want.tolist())}


def test_neighbours_of_equal_distance_and_text_ids(spark):
    """All distances are the same: lists hold the smallest ids, whatever block they are in."""
    ids = [f"p{i:02d}" for i in range(40)]
    frame = spark.createDataFrame([(name, row) for name, row in zip(ids, np.eye(40).tolist())], "protid string, vector array<double>")
    for row in neighbour_lists(frame, 3, block_rows=6).collect():
        assert row["targets"] == [name for name in ids if name != row["query"]][:3]


def test_fewer_rows_than_neighbours(spark):
    rows = neighbour_lists(vector_frame(spark, np.eye(3)), 10).collect()
    assert sorted(len(r["targets"]) for r in rows) == [2, 2, 2]
    assert default_neighbours(4) == 3 and default_neighbours(500) == 10
    assert default_neighbours(500, share=0.1) == 50 and default_neighbours(50, share=0.1) == 10


def test_fuzzy_weights():
    rng = np.random.default_rng(0)
    distances = np.sort(rng.random((5, 8)), axis=1)
    weights = graph.fuzzy_memberships(distances, np.ones((5, 8), bool))
    assert weights[:, 0] == pytest.approx(np.ones(5))
    assert weights.sum(axis=1) == pytest.approx(np.full(5, np.log2(8)), abs=1e-6)


def test_fuzzy_graph_is_symmetric(spark, blobs):
    edges = graph.fuzzy_graph(neighbour_lists(vector_frame(spark, blobs), 5, metric="euclidean"))
    weights = {(r["src"], r["dst"]): r["w"] for r in edges.collect()}
    assert all(weights[(b, a)] == w and 0 < w <= 1 for (a, b), w in weights.items())


def planted(size, groups, inside, between, seed):
    rng = np.random.default_rng(seed)
    labels = np.arange(size) % groups
    odds = np.where(labels[:, None] == labels[None, :], inside, between)
    upper = np.triu(rng.random((size, size)) < odds, 1)
    return labels, np.argwhere(upper | upper.T)


def test_communities(spark):
    labels, pairs = planted(90, 3, 0.5, 0.02, 1)
    edges = spark.createDataFrame(
        [(int(a), int(b), 1.0) for a, b in pairs], "src bigint, dst bigint, w double"
    )
    found = graph.communities(edges)
    members = as_dict(found, "node", "community")
    assert len(members) == 90
    purity = sum(
        max((labels[[n for n, c in members.items() if c == name]] == g).sum() for g in range(3))
        for name in set(members.values())
    )
    assert purity >= 87 and len(set(members.values())) <= 4
    truth = spark.createDataFrame(
        [(i, int(c)) for i, c in enumerate(labels)], "node bigint, community bigint"
    )
    assert graph.modularity(edges, found) >= 0.95 * graph.modularity(edges, truth)
    # Reproducible whatever the partitioning.
    assert as_dict(graph.communities(edges.repartition(5)), "node", "community") == members


def test_communities_of_a_long_path_are_settled(spark):
    n = 60
    pairs = [(i, i + 1) for i in range(n - 1)]
    edges = spark.createDataFrame(
        [(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])], "src bigint, dst bigint, w double"
    )
    found = as_dict(graph.communities(edges), "node", "community")
    total, volume, between = 2 * len(pairs), dict.fromkeys(found.values(), 0), {}
    for a, b in pairs:
        volume[found[a]] += 1
        volume[found[b]] += 1
        if found[a] != found[b]:
            key = tuple(sorted((found[a], found[b])))
            between[key] = between.get(key, 0) + 1
    # No two communities would do better as one.
    assert all(w <= volume[a] * volume[b] / total + 1e-9 for (a, b), w in between.items())


def test_two_cliques_and_a_loner(spark):
    pairs = [(a, b) for s in (0, 10) for a in range(s, s + 5) for b in range(s, s + 5) if a != b]
    pairs += [(0, 10), (10, 0)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15), 99]], "node bigint")
    found = as_dict(graph.communities(edges, nodes), "node", "community")
    assert len({found[i] for i in range(5)}) == 1 and len({found[i] for i in range(10, 15)}) == 1
    assert len(set(found.values())) == 3


def test_set_cover_equals_one_by_one(spark):
    rng = np.random.default_rng(0)
    n = 120
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, size=(160, 2)) if a != b]
    pairs += [(0, i) for i in range(1, 40)]
    around = {i: {i} for i in range(n)}
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    left, want = set(range(n)), {}
    while left:
        best = min(range(n), key=lambda v: (-len(around[v] & left), v))
        for covered in around[best] & left:
            want[covered] = best
        left -= around[best]
    table = spark.createDataFrame(pairs, "src bigint, dst bigint")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    assert as_dict(graph.set_cover(table, nodes), "node", "representative") == want


def direct_scores(matrix, k):
    centred = matrix - matrix.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    return u[:, :k] * s[:k]


def same_up_to_sign(got, want):
    return np.abs(np.abs(got) - np.abs(want)).max() < 1e-6


def coords(df):
    return np.array([r["coords"] for r in sorted(df.collect(), key=lambda r: r["protid"])])


def test_components(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(80, 5)) * [5, 3, 2, 1, 0.5] + 4
    table = vector_frame(spark, vectors)
    assert same_up_to_sign(coords(reduction.principal_components(table, 3)), direct_scores(vectors, 3))
    pairs = vectors @ vectors.T
    assert same_up_to_sign(
        coords(reduction.similarity_components(table, 3)) / 100, direct_scores(pairs, 3) / 100
    )
    assert reduction.explained_variance(table).sum() == pytest.approx(vectors.var(axis=0).sum())
    assert coords(reduction.principal_components(table, 30)).shape == (80, 5)


def test_components_of_a_score_table(spark):
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(30, 4)) @ rng.normal(size=(4, 30))
    dense[np.abs(dense) < 1] = 0
    rows = [(i, j, float(dense[i, j])) for i in range(30) for j in range(30) if dense[i, j] or i == j]
    table = spark.createDataFrame(rows, "query bigint, target bigint, score double")
    got = coords(reduction.score_components(table, 2, tolerance=1e-12))
    assert np.abs(np.abs(got) - np.abs(direct_scores(dense, 2))).max() < 1e-3


def test_components_of_close_variances_take_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    dense = np.where(rng.random((240, 60)) < 0.4, rng.integers(1, 51, (240, 60)), 0).astype(float)
    rows = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    labels, inner = [], StageArea.write
    monkeypatch.setattr(StageArea, "write", lambda self, df, label="stage", **o: labels.append(label) or inner(self, df, label, **o))
    monkeypatch.setattr(reduction, "MOST_COLUMNS", 24)
    got = coords(reduction.score_components(spark.createDataFrame(rows, "query bigint, target bigint, score double"), 2, extra=4))
    direct = direct_scores(dense, 2)
    assert (got**2).sum() >= 0.999 * (direct**2).sum()
    assert np.abs(got.mean(axis=0)).max() < 1e-6
    assert sum(label.startswith("image") for label in labels) <= 12


def test_score_components_with_missing_ids(spark):
    rng = np.random.default_rng(9)
    dense = rng.normal(size=(20, 3)) @ rng.normal(size=(3, 8))
    rows = [(i, j, float(dense[i, j])) for i in range(20) for j in range(8)]
    odd = [(None, 2, 900.0), (3, None, 700.0), (None, None, 5.0)]
    got = reduction.score_components(spark.createDataFrame([*rows, *odd], "query bigint, target bigint, score double"), 2)
    found = {r.protid: r.coords for r in got.collect()}
    assert len(found) == 21
    kept = np.array([found[i] for i in range(20)])
    assert same_up_to_sign(kept - kept.mean(axis=0), direct_scores(dense, 2))


def test_score_components_in_many_blocks(spark, monkeypatch):
    """Text ids, repeated pairs, missing ids and scores, over some blocks; no pass shuffles scores or rows of a thin matrix."""
    rng = np.random.default_rng(12)
    dense = np.where(rng.random((50, 40)) < 0.5, rng.normal(size=(50, 3)) @ rng.normal(size=(3, 40)), 0.0)
    rows = [(f"q{i}", f"t{j}", float(dense[i, j]) / 2) for i, j in zip(*np.nonzero(dense)) for _ in range(2)]
    odd = [(None, "t2", 900.0), ("q3", None, 700.0), ("q4", "t5", None)]
    monkeypatch.setattr(score_blocks, "BLOCK_ROWS", 9)
    monkeypatch.setattr(score_blocks, "TASK_SCORES", 300)
    shuffled = []

    def counted(self, df, label="stage", write=StageArea.write, **options):
        if label.startswith(("image", "draft", "found")):
            shuffled.append(df._jdf.queryExecution().toString().count("Join"))
        return write(self, df, label, **options)

    monkeypatch.setattr(StageArea, "write", counted)
    table = spark.createDataFrame([*rows, *odd], "query string, target string, score double")
    found = {r.protid: r.coords for r in reduction.score_components(table, 2, tolerance=1e-12).collect()}
    assert len(found) == 51 and shuffled and not any(shuffled)
    kept = np.array([found[f"q{i}"] for i in range(50)])
    assert same_up_to_sign(kept - kept.mean(axis=0), direct_scores(dense, 2))


def test_score_table_pca_goes_by_parts(spark, tmp_path):
    """The columns of the table are parts; all lines are of one supplier."""
    rng = np.random.default_rng(13)
    lines = [(order, int(part), 1, float(rng.integers(1, 51))) for order in range(30) for part in rng.choice(12, 5, replace=False)]
    spark.createDataFrame([(order, order % 10) for order in range(30)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    dense = np.zeros((10, 12))
    for order, part, _, quantity in lines:
        dense[order % 10, part] = max(dense[order % 10, part], quantity)
    found = {r.protid: (r.PC0, r.PC1) for r in map_queries.score_table_pca(spark, str(tmp_path)).collect()}
    assert same_up_to_sign(np.array([found[i] for i in range(10)]), direct_scores(dense, 2))


def test_grid_repulsion(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(150, 2)) * 6
    state = spark.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id bigint, y0 double, y1 double"
    )
    squares, z, origin, step, nodes = layout.grid_repulsion(state)
    gap = points[:, None] - points[None]
    kernel = 1 / (1 + (gap**2).sum(axis=2))
    assert z == pytest.approx(kernel.sum() - 150, rel=0.01)
    force = (gap * (kernel**2)[:, :, None]).sum(axis=1)
    got = layout.repulsion_at(points, squares, origin, step, nodes)
    assert np.abs(got - force).max() < 0.02 * np.abs(force).max()


def test_grid_repulsion_of_a_wide_layout(spark):
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(size=(60, 2)) + shift for shift in (0, 130, 260)])
    state = spark.createDataFrame(
        [(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id bigint, y0 double, y1 double"
    )
    squares, z, origin, step, nodes = layout.grid_repulsion(state)
    gap = points[:, None] - points[None]
    kernel = 1 / (1 + (gap**2).sum(axis=2))
    force = (gap * (kernel**2)[:, :, None]).sum(axis=1)
    got = layout.repulsion_at(points, squares, origin, step, nodes)
    assert np.abs(got - force).max() < 0.005 * np.abs(force).max()
    assert z == pytest.approx(kernel.sum() - len(points), rel=0.002)


def test_every_row_draws_its_own_negatives(spark):
    count = 3000
    state = spark.range(count).selectExpr("id", "double(id) AS y0", "0D AS y1", "id AS code", "1D AS degree")
    draws = layout.negative_draws(state, count, 1, 0).collect()
    assert len(draws) == layout.NEGATIVES * count
    # No shared pool: most rows push some other row in every round.
    assert len({r["other"] for r in draws}) > 0.98 * count
    a, b = layout.curve_parameters(0.5)
    got = {r["id"]: r["q0"] for r in layout._pushed(state, layout.negative_draws(state, count, 1, 0), a, b).collect()}
    want = dict.fromkeys(range(count), 0.0)
    for r in draws:
        gap = r["y0"] - r["other"]
        want[r["id"]] += np.clip(2 * b * gap / ((0.001 + gap**2) * (1 + a * (gap**2) ** b)), -4, 4)
    assert got == pytest.approx(want)


def test_curve_parameters():
    a, b = layout.curve_parameters(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=1e-2), pytest.approx(0.895, abs=1e-2))


@pytest.mark.parametrize("mode", ["tsne", "umap"])
def test_layouts_keep_groups_apart(spark, mode):
    rng = np.random.default_rng(5)
    labels = np.arange(60) % 3
    vectors = rng.normal(size=(60, 4)) * 0.2 + np.eye(4)[labels] * 8
    table = vector_frame(spark, vectors)
    found = coords(layout.reduce_dimensions(table, mode, rounds=12))
    assert found.shape == (60, 2) and np.isfinite(found).all()
    centres = np.array([found[labels == g].mean(axis=0) for g in range(3)])
    nearest = ((found[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == labels).mean() > 0.9


def test_registered_layouts_run_all_rounds(spark, monkeypatch):
    ran = {}
    monkeypatch.setattr(layout, "tsne", lambda rows, **given: ran.update(tsne=given) or rows.withColumnRenamed("vector", "coords"))
    monkeypatch.setattr(layout, "umap", lambda rows, **given: ran.update(umap=given) or rows.withColumnRenamed("vector", "coords"))
    map_queries.tsne_layout(spark, "/root/testdata/sf0.001")
    map_queries.umap_layout(spark, "/root/testdata/sf0.001")
    assert set(ran) == {"tsne", "umap"} and all("rounds" not in given for given in ran.values())


def test_small_layouts(spark):
    one = vector_frame(spark, np.ones((1, 3)))
    assert coords(layout.tsne(one)).tolist() == [[0.0, 0.0]]
    two = vector_frame(spark, np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0]]))
    assert coords(layout.umap(two)).shape == (2, 2)
    assert as_dict(communities_of_coordinates(two.withColumnRenamed("vector", "coords")), "protid", "LeidenCluster") == {0: "LC0", 1: "LC0"}
    with pytest.raises(ValueError):
        layout.reduce_dimensions(one, "mds")


def test_tm_scores(spark):
    rng = np.random.default_rng(6)
    base = np.cumsum(rng.normal(size=(40, 3)) * 2, axis=0)
    angle = 0.7
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    shapes = {
        "a": base,
        "moved": base @ turn + [5, -3, 2],
        "noisy": base @ turn + rng.normal(size=(40, 3)),
        "mirror": base * [1, 1, -1],
    }
    rows = [
        (name, k, *[float(v) for v in point])
        for name, points in shapes.items()
        for k, point in enumerate(points)
    ]
    carbons = spark.createDataFrame(rows, "protid string, residue int, x double, y double, z double")
    pairs = spark.createDataFrame([("a", t) for t in shapes], "query string, target string")
    aligned = superposition.index_aligned(pairs, carbons)
    better = as_dict(superposition.tm_scores(aligned), "target", "score")

    def direct(q, t):
        a, b = q - q.mean(axis=0), t - t.mean(axis=0)
        u, _, vt = np.linalg.svd(a.T @ b)
        u[:, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(vt))
        d2 = ((a @ (u @ vt) - b) ** 2).sum(axis=1)
        d0 = 1.24 * (len(t) - 15) ** (1 / 3) - 1.8
        return (1 / (1 + d2 / d0**2)).mean()

    for name, points in shapes.items():
        assert better[name] >= direct(base, points) - 1e-9
    assert better["moved"] == pytest.approx(1.0) and better["mirror"] < 0.9
    # Half of a chain moved on its own: a local start finds the other half.
    bent = base.copy()
    bent[20:] = bent[20:] @ turn + [40, 0, 0]
    assert superposition.best_score(base, bent, 40) >= 0.5
    assert superposition.best_score(base[:3], base[:3] + 1.0, 40) == pytest.approx(3 / 40)


def test_knn_graph_has_a_tenth_of_all_vectors(spark, tmp_path, monkeypatch):
    """The neighbour count grows with the table; short chunks of long lists give the same rows."""
    points = np.random.default_rng(6).normal(size=(155, 8))
    rows = vector_frame(spark, points, "embedding").withColumnRenamed("protid", "vec_id")
    rows.repartition(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(neighbours, "LIST_CELLS", 100)
    assert neighbours.chunk_rows(16) == 6 and neighbours.chunk_rows(1000) == 1
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    square = squared_distances(unit, unit, 1.0)
    np.fill_diagonal(square, np.inf)
    want = smallest(square, 16)
    found = {(r["query"], r["rank"]): r["target"] for r in map_queries.knn_graph(spark, str(tmp_path)).collect()}
    assert found == {(i, place + 1): target for i, row in enumerate(want.tolist()) for place, target in enumerate(row)}
